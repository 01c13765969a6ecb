"""Registry jobs over the control tables.

Request batches are derived from the driver's tables, so they grow with them:

* inserts: a sign-up request per customer (CPF sent as digits only) plus a
  second, later request from every inactive customer; a registration per
  supplier as a company, repeated for suppliers with a negative balance;
* partial updates: per market segment, one or two change requests keyed by
  the stored CPF, and one keyed by the digits-only CPF (unknown for the
  punctuated ones);
* full company updates: a new address for one region's companies, and
  updates for codes that do not exist;
* deletes: every inactive user, plus digits-only keys that do not exist; every
  inactive company, plus one region's codes shifted to unknown ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cpf_is_valid, digits_only
from ..operators import registry as R
from ..operators.filters import lookup
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import jdbc, snapshots

#: The company that point lookups ask for.
COMPANY = 7


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tbusuarios(spark, sf_dir)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tbempresas(spark, sf_dir)


# ---------------------------------------------------------------- batches
def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir)
    signup = u.withColumn("seq", F.col("codusuario").cast("bigint") * 2)
    again = u.filter(F.col("usuarioativo") == "N").withColumn("seq", F.col("codusuario").cast("bigint") * 2 + 1)
    return signup.unionByName(again).withColumn("cpfusuario", digits_only(F.col("cpfusuario")))


def company_insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registration request per supplier (tax id = supplier key), and a
    second, later one from every supplier with a negative balance."""
    s = fx._raw(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    base = s.select(
        fx.lpad14(k).alias("cnpjcpf"),
        F.col("s_name").alias("nomeempresa"),
        (k.cast("bigint") * 2).alias("seq"),
        F.col("s_acctbal"),
    )
    again = base.filter(F.col("s_acctbal") < 0).withColumn("seq", F.col("seq") + 1)
    return base.unionByName(again).drop("s_acctbal")


def company_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company_insert_batch`` with all columns of a company: code 1000 + supplier."""
    null_s = F.lit(None).cast("string")
    k = F.col("cnpjcpf").cast("int")
    return company_insert_batch(spark, sf_dir).select(
        (k + 1000).alias("codempresa"), "nomeempresa", "cnpjcpf", F.lit("F").alias("tipobdempresa"), F.lit("3050").alias("portabd"),
        F.concat(F.lit("10.2.0."), k.cast("string")).alias("ipbd"), null_s.alias("caminhobd"), F.lit("S").alias("ativa"), "seq")


def user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir)
    c = fx._raw(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("codusuario"), "c_mktsegment")
    u = u.join(c, "codusuario")
    seq = F.col("codusuario").cast("bigint") * 4
    null_s = F.lit(None).cast("string")
    base = {
        "nomeusuario": null_s,
        "codempresa": F.lit(None).cast("int"),
        "usuarioativo": null_s,
        "emailusuario": null_s,
    }

    def req(seg: str, key, order, supplied: list[str], **vals) -> DataFrame:
        cols = dict(base)
        cols.update(vals)
        return u.filter(F.col("c_mktsegment") == seg).select(
            key.alias("cpfusuario"),
            order.alias("seq"),
            F.array(*[F.lit(s) for s in supplied]).alias("supplied"),
            *[v.alias(k) for k, v in cols.items()],
        )

    cpf = F.col("cpfusuario")
    parts = [
        req("BUILDING", cpf, seq, ["emailusuario"], emailusuario=F.upper(F.col("emailusuario"))),
        req("AUTOMOBILE", cpf, seq, ["nomeusuario", "usuarioativo"], usuarioativo=F.lit("S")),
        req("FURNITURE", cpf, seq, ["usuarioativo", "codempresa"], usuarioativo=F.lit("N"), codempresa=F.lit(0)),
        req("FURNITURE", cpf, seq + 1, ["emailusuario", "usuarioativo"], usuarioativo=F.lit("S")),
        req("MACHINERY", digits_only(cpf), seq, ["codempresa"], codempresa=F.lit(99)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def company_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx._raw(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    rows = n.filter(F.col("n_regionkey").isin(2, 4)).select(
        F.when(F.col("n_regionkey") == 4, k + 100).otherwise(k).cast("int").alias("codempresa"),
        k.cast("bigint").alias("seq"),
        F.col("n_name").alias("nomeempresa"),
        fx.lpad14(k).alias("cnpjcpf"),
        F.lit("F").alias("tipobdempresa"),
        F.lit("3050").alias("portabd"),
        F.concat(F.lit("10.1.0."), k.cast("string")).alias("ipbd"),
        F.lit(None).cast("string").alias("caminhobd"),
        F.lit("N").alias("ativa"),
    )
    return rows


def delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir)
    c = fx._raw(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("codusuario"), "c_mktsegment")
    inactive = u.filter(F.col("usuarioativo") == "N").select("cpfusuario")
    missing = (
        u.join(c, "codusuario").filter(F.col("c_mktsegment") == "MACHINERY").select(digits_only(F.col("cpfusuario")).alias("cpfusuario"))
    )
    return inactive.unionByName(missing)


def company_delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx._raw(spark, sf_dir, "nation").filter(F.col("n_regionkey") == 4)
    inactive = companies(spark, sf_dir).filter(F.col("ativa") == "N").select("codempresa")
    return inactive.unionByName(n.select((F.col("n_nationkey") + 100).cast("int").alias("codempresa")))


# ---------------------------------------------------------------- queries
def cpf_quality(spark, sf_dir) -> DataFrame:
    return R.cpf_quality(users(spark, sf_dir))


def users_insert_new(spark, sf_dir) -> DataFrame:
    out = R.insert_outcomes(
        users(spark, sf_dir), insert_batch(spark, sf_dir), "cpfusuario", "seq", validate=cpf_is_valid(F.col("cpfusuario"))
    )
    return out.select("codusuario", "cpfusuario", "seq", "outcome")


def companies_insert_new(spark, sf_dir) -> DataFrame:
    out = R.insert_outcomes(companies(spark, sf_dir), company_insert_batch(spark, sf_dir), "cnpjcpf", "seq")
    return out.select("cnpjcpf", "seq", "outcome")


def users_partial_update(spark, sf_dir) -> DataFrame:
    upd = R.partial_update(users(spark, sf_dir), user_changes(spark, sf_dir), "cpfusuario", R.USER_UPDATABLE, "seq")
    return R.users_public(upd)


def users_update_unknown(spark, sf_dir) -> DataFrame:
    ch = user_changes(spark, sf_dir).select("cpfusuario", "seq")
    return R.unknown_keys(ch, users(spark, sf_dir), "cpfusuario")


def companies_full_update(spark, sf_dir) -> DataFrame:
    return R.full_update(companies(spark, sf_dir), company_updates(spark, sf_dir), "codempresa", R.COMPANY_UPDATABLE, "seq")


def companies_update_unknown(spark, sf_dir) -> DataFrame:
    upd = company_updates(spark, sf_dir).select("codempresa", "seq")
    return R.unknown_keys(upd, companies(spark, sf_dir), "codempresa")


def users_delete(spark, sf_dir) -> DataFrame:
    return R.users_public(R.delete_keys(users(spark, sf_dir), delete_batch(spark, sf_dir), "cpfusuario"))


def users_delete_unknown(spark, sf_dir) -> DataFrame:
    return R.unknown_keys(delete_batch(spark, sf_dir), users(spark, sf_dir), "cpfusuario")


def companies_delete(spark, sf_dir) -> DataFrame:
    return R.companies_public(R.delete_keys(companies(spark, sf_dir), company_delete_batch(spark, sf_dir), "codempresa"))


def companies_delete_unknown(spark, sf_dir) -> DataFrame:
    return R.unknown_keys(company_delete_batch(spark, sf_dir), companies(spark, sf_dir), "codempresa")


def tenant_source(spark, sf_dir) -> DataFrame:
    """S3 for one company."""
    return jdbc.tenant_source(companies(spark, sf_dir), COMPANY)


def tenant_sources(spark, sf_dir) -> DataFrame:
    """S3 for every active company."""
    return jdbc.tenant_sources(companies(spark, sf_dir))


def company_lookup(spark, sf_dir) -> DataFrame:
    """F12 on the company registry."""
    return lookup(R.companies_public(companies(spark, sf_dir)), "codempresa", COMPANY)


def company_requests(spark, sf_dir) -> DataFrame:
    """S3 and F12 for a batch of requests (a freight document asks for its
    carrier's company): connection attributes per company asked for, and whether
    the registry, registrations included, knows it."""
    have = companies(spark, sf_dir)
    registry = R.apply_inserts(have, R.insert_outcomes(have, company_registrations(spark, sf_dir), "cnpjcpf", "seq"))
    asked = fx._raw(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1000).cast("int").alias("codempresa"))
    return jdbc.requested_sources(asked, registry)


def users_public(spark, sf_dir) -> DataFrame:
    return R.users_public(users(spark, sf_dir))


def companies_public(spark, sf_dir) -> DataFrame:
    return R.companies_public(companies(spark, sf_dir))


def users_published(spark, sf_dir) -> DataFrame:
    """N5 and N7 kept: the users, after the changes, after the deletes; each a
    published version, made from the one before."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/users-{uuid.uuid4().hex}"
    at = snapshots.publish(users(spark, sf_dir), root)
    for change in (
        lambda u: R.partial_update(u, user_changes(spark, sf_dir), "cpfusuario", R.USER_UPDATABLE, "seq"),
        lambda u: R.delete_keys(u, delete_batch(spark, sf_dir), "cpfusuario"),
    ):
        at = snapshots.publish(change(snapshots.read(spark, root, at)), root, at)
    return R.users_public(snapshots.read(spark, root))


def companies_published(spark, sf_dir) -> DataFrame:
    """N4 and N6 kept: the companies, after the registrations, after the updates."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/companies-{uuid.uuid4().hex}"
    at = snapshots.publish(companies(spark, sf_dir), root)
    have = snapshots.read(spark, root, at)
    new = R.insert_outcomes(have, company_registrations(spark, sf_dir), "cnpjcpf", "seq")
    at = snapshots.publish(R.apply_inserts(have, new), root, at)
    have = snapshots.read(spark, root, at)
    updated = R.full_update(have, company_updates(spark, sf_dir), "codempresa", R.COMPANY_UPDATABLE, "seq")
    snapshots.publish(updated, root, at)
    return R.companies_public(snapshots.read(spark, root))


QUERIES = {
    "cpf_quality": cpf_quality,
    "users_insert_new": users_insert_new,
    "companies_insert_new": companies_insert_new,
    "users_partial_update": users_partial_update,
    "users_update_unknown": users_update_unknown,
    "companies_full_update": companies_full_update,
    "companies_update_unknown": companies_update_unknown,
    "users_delete": users_delete,
    "users_delete_unknown": users_delete_unknown,
    "companies_delete": companies_delete,
    "companies_delete_unknown": companies_delete_unknown,
    "tenant_source": tenant_source,
    "tenant_sources": tenant_sources,
    "company_lookup": company_lookup,
    "company_requests": company_requests,
    "users_published": users_published,
    "companies_published": companies_published,
    "users_public": users_public,
    "companies_public": companies_public,
}
