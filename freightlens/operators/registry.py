"""Registry upkeep as batch table jobs.

The reference changes one user or company per HTTP request.  Here a batch of
requests is applied to the whole table with joins:

* per-key "first/last request wins" is a ``min_by``/``max_by`` aggregate, so
  a hot key (one CPF sent a million times) is pre-aggregated map-side instead
  of being gathered into one window partition;
* existence checks are semi/anti joins on the key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cpf_is_valid, unescape_path

# Outcome labels of an insert batch.
INSERTED = "inserted"
INVALID_CPF = "invalid_cpf"
ALREADY_PRESENT = "already_present"
DUPLICATE_IN_BATCH = "duplicate_in_batch"

#: Repeats of one request that a row stands for while they are spread.
RUN = 10_000

USER_PUBLIC_COLS = ["codusuario", "nomeusuario", "codempresa", "usuarioativo", "cpfusuario", "emailusuario"]
USER_UPDATABLE = ["nomeusuario", "codempresa", "usuarioativo", "emailusuario"]
COMPANY_COLS = ["codempresa", "nomeempresa", "cnpjcpf", "tipobdempresa", "portabd", "ipbd", "caminhobd", "ativa"]
COMPANY_UPDATABLE = ["nomeempresa", "cnpjcpf", "tipobdempresa", "portabd", "ipbd", "caminhobd", "ativa"]


# --------------------------------------------------------------------- N3
def with_cpf_check(users: DataFrame, cpf_col: str = "cpfusuario") -> DataFrame:
    return users.withColumn("cpf_valido", cpf_is_valid(F.col(cpf_col)))


def split_by_cpf(users: DataFrame, cpf_col: str = "cpfusuario") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) users by the CPF rule."""
    checked = with_cpf_check(users, cpf_col)
    return checked.filter("cpf_valido").drop("cpf_valido"), checked.filter("NOT cpf_valido").drop("cpf_valido")


def cpf_quality(users: DataFrame, by: Sequence[str] = ("codempresa",), cpf_col: str = "cpfusuario") -> DataFrame:
    """Users, valid and invalid CPFs per company."""
    return with_cpf_check(users, cpf_col).groupBy(*by).agg(
        F.count(F.lit(1)).alias("usuarios"),
        F.count_if(F.col("cpf_valido")).alias("cpf_validos"),
        F.count_if(~F.col("cpf_valido")).alias("cpf_invalidos"),
    )


# --------------------------------------------------------------------- N4
def insert_outcomes(
    existing: DataFrame,
    batch: DataFrame,
    key: str,
    order_col: str,
    validate=None,
) -> DataFrame:
    """Outcome of each insert request, in the reference's order of checks.

    1. ``validate`` (e.g. the CPF rule) fails -> ``invalid_cpf``;
    2. the key is already in ``existing`` -> ``already_present``;
    3. the first valid request per key (smallest ``order_col``) ->
       ``inserted``; later ones -> ``duplicate_in_batch``.

    The batch's columns must be of types that can be ordered (no maps).
    """
    # A request is told by what it says, not by where it was read: the first one of
    # a key is the smallest (order_col, all columns), and of requests that say the
    # same, counted below, one is inserted.  So neither a source that gives rows in
    # another order when read again nor a retried task can insert a key twice.
    columns = batch.columns
    b = batch.withColumn("__valid", validate if validate is not None else F.lit(True)).withColumn("__says", F.struct(*columns))
    # One row per key of the batch: whether the registry has it, and its first
    # valid request (pre-aggregated, so a hot key costs one row per task).  The
    # registry is only semi-joined with the batch's keys, NULL keys included.
    asked = b.groupBy(F.col(key).alias("__key")).agg(
        F.min(F.when(F.col("__valid"), F.struct(F.col(order_col).alias("o"), F.col("__says").alias("s")))).alias("__first"))
    have = asked.select("__key").join(
        existing.select(F.col(key).alias("__have")), F.col("__key").eqNullSafe(F.col("__have")), "left_semi").withColumn("__present", F.lit(True))
    state = asked.join(have.withColumnRenamed("__key", "__h"), F.col("__key").eqNullSafe(F.col("__h")), "left").drop("__h")
    b = b.join(state, F.col(key).eqNullSafe(F.col("__key")), "left")
    outcome = (
        F.when(~F.col("__valid"), F.lit(INVALID_CPF))
        .when(F.col("__present").isNotNull(), F.lit(ALREADY_PRESENT))
        .when(F.col("__says").eqNullSafe(F.col("__first.s")), F.lit(INSERTED))
        .otherwise(F.lit(DUPLICATE_IN_BATCH))
    )
    told = b.withColumn("outcome", outcome).select(*columns, "outcome")
    first = told.filter(F.col("outcome") == INSERTED).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    # the others that say the same: spread in runs, so a request sent a million times is many small rows
    runs = first.filter("__n > 1").withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 2) div {RUN}"))))
    again = runs.repartition(key, "__run").withColumn(
        "__k", F.explode(F.sequence(F.col("__run") * RUN, F.least(F.col("__n") - 1, (F.col("__run") + 1) * RUN) - 1)))
    return (
        told.filter(F.col("outcome") != INSERTED)
        .unionByName(first.select(*columns, F.lit(INSERTED).alias("outcome")))
        .unionByName(again.select(*columns, F.lit(DUPLICATE_IN_BATCH).alias("outcome")))
    )


def apply_inserts(existing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Registry after the batch: existing rows plus the inserted ones."""
    new = outcomes.filter(F.col("outcome") == INSERTED).select(*existing.columns)
    return existing.unionByName(new)


# --------------------------------------------------------------------- N5
def latest_per_key(changes: DataFrame, key: str, order_col: str) -> DataFrame:
    """Last request per key (largest ``order_col``) as a ``max_by`` aggregate."""
    others = [c for c in changes.columns if c != key]
    pick = F.max_by(F.struct(*others), F.col(order_col)).alias("__c")
    return changes.groupBy(key).agg(pick).select(key, *[F.col(f"__c.{c}").alias(c) for c in others])


def partial_update(
    registry: DataFrame,
    changes: DataFrame,
    key: str,
    fields: Sequence[str],
    order_col: str,
    supplied_col: str = "supplied",
) -> DataFrame:
    """Only the fields listed in ``supplied`` change; an explicit NULL in
    a supplied field is written.  Requests for one key apply in
    ``order_col`` order, so per field the last request that supplied it wins
    (as if the requests ran one after another).

    Per field, ``max_by(struct(value), seq if supplied)``: rows that did not
    supply the field have a NULL ordering and are ignored, and the struct
    wrapper keeps "supplied NULL" apart from "not supplied".
    """
    sup = F.col(supplied_col)
    aggs = [
        F.max_by(F.struct(F.col(f).alias("v")), F.when(F.array_contains(sup, F.lit(f)), F.col(order_col))).alias(
            f"__s_{f}"
        )
        for f in fields
    ]
    upd = changes.groupBy(key).agg(*aggs)
    j = registry.join(upd, on=key, how="left")
    sets = {f: F.when(F.col(f"__s_{f}").isNotNull(), F.col(f"__s_{f}.v")).otherwise(F.col(f)) for f in fields}
    return j.withColumns(sets).select(*registry.columns)


def unknown_keys(requests: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Requests whose key is not in the registry (the reference's 404s)."""
    return requests.join(registry.select(key), on=key, how="left_anti")


# --------------------------------------------------------------------- N6
def full_update(registry: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], order_col: str) -> DataFrame:
    """Every field of a known key is replaced (NULLs included) by its last
    update."""
    last = latest_per_key(updates, key, order_col)
    upd = last.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(f).alias(f"__new_{f}") for f in fields])
    j = registry.join(upd, on=key, how="left")
    sets = {f: F.when(F.col("__hit"), F.col(f"__new_{f}")).otherwise(F.col(f)) for f in fields}
    return j.withColumns(sets).select(*registry.columns)


# --------------------------------------------------------------------- N7
def delete_keys(registry: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Registry without the deleted keys (anti join)."""
    return registry.join(keys.select(key), on=key, how="left_anti")


# --------------------------------------------------------------------- N8
def users_public(users: DataFrame) -> DataFrame:
    """User rows without the password column."""
    return users.select(*USER_PUBLIC_COLS)


def companies_public(companies: DataFrame) -> DataFrame:
    """Company rows with the database path un-escaped."""
    return companies.select(
        *[unescape_path(F.col(c)).alias(c) if c == "caminhobd" else F.col(c) for c in COMPANY_COLS]
    )
