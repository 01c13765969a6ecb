"""Request-audit normalisation (N1) and the audit sink.

Input rows are raw request/response captures (see ``fixtures.audit_events``);
optional ``resp_usuario`` / ``resp_codempresa`` columns carry the claims of a
token returned by ``/login`` (decoded upstream: token handling is not built).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import body_kind, canonical_json, clean_body, parsed_body
from ..session import ensure_checkpoint_dir

#: Columns the audit table declares NOT NULL.
REQUIRED = ("metodo", "endpoint", "status_code", "user_agent")
LOGIN_ENDPOINT = "/login"

AUDIT_COLS = [
    "id", "ts", "usuario", "codempresa", "metodo", "endpoint", "params", "body_request",
    "body_response", "body_response_json", "status_code", "ip_address", "user_agent",
]
#: The audit table as written: fixed, so that an empty one can be read.
AUDIT_TABLE = (
    "id long, ts timestamp_ntz, usuario string, codempresa string, metodo string, endpoint string, params string, "
    "body_request string, body_response string, body_response_json boolean, status_code int, ip_address string, "
    "user_agent string, lote string, dia date"
)


def _opt(df: DataFrame, name: str, dtype: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def normalise(events: DataFrame) -> DataFrame:
    """Effective user/company, cleaned bodies and a required-field flag.

    * user and company come from the request token; for ``/login`` the
      claims of the returned token win when present;
    * ``body_request`` is kept only when it is JSON (else NULL);
    * ``body_response``: the two characters backslash+n removed, outer
      whitespace stripped; ``body_response_json`` tells whether it parses.
    """
    login = (F.col("endpoint") == LOGIN_ENDPOINT) & (
        _opt(events, "resp_usuario", "string").isNotNull() | _opt(events, "resp_codempresa", "string").isNotNull()
    )
    body = clean_body(F.col("body_response"))
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    return events.select(
        "id",
        "ts",
        F.when(login, _opt(events, "resp_usuario", "string")).otherwise(F.col("usuario")).alias("usuario"),
        F.when(login, _opt(events, "resp_codempresa", "string")).otherwise(F.col("codempresa")).alias("codempresa"),
        "metodo",
        "endpoint",
        "params",
        F.when(F.try_parse_json(F.col("body_request")).isNotNull(), F.col("body_request")).alias("body_request"),
        body.alias("body_response"),
        F.try_parse_json(body).isNotNull().alias("body_response_json"),
        "status_code",
        "ip_address",
        "user_agent",
        ok.alias("__ok"),
    )


def accepted(events: DataFrame) -> DataFrame:
    """Rows that satisfy the table's NOT NULL columns."""
    return normalise(events).filter("__ok").drop("__ok")


def rejected(events: DataFrame) -> DataFrame:
    """Rows the audit table would refuse (a required column is NULL)."""
    return normalise(events).filter("NOT __ok").drop("__ok")


def with_parsed_body(rows: DataFrame) -> DataFrame:
    """Normalised rows with ``body_response_variant``: the reference's JSON column,
    which holds the parsed body, or its text where that isn't JSON."""
    return rows.withColumn("body_response_variant", parsed_body("body_response"))


def body_fields(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields of the parsed body: name -> (path, type); NULL where a body has no
    such path or another type of value there."""
    v = F.col("body_response_variant")
    return rows.withColumns({name: F.try_variant_get(v, path, kind) for name, (path, kind) in fields.items()})


#: What ``audit_bodies`` reads from bodies.
BODY_FIELDS = {
    "token": ("$.access_token", "string"),
    "empresa": ("$.empresa", "bigint"),
    "item": ("$.itens[0]", "bigint"),
    "primeiro": ("$[0]", "bigint"),
}


def parsed_bodies(events: DataFrame) -> DataFrame:
    """N1 with E23 in full: kind, canonical text and fields of each parsed body."""
    rows = body_fields(with_parsed_body(accepted(events)), BODY_FIELDS)
    v = F.col("body_response_variant")
    return rows.select("id", "endpoint", "body_response_json", body_kind(v).alias("tipo"), canonical_json(v).alias("texto"), *BODY_FIELDS)


def write_audit(df: DataFrame, path: str, batch: str) -> None:
    """Put the normalised rows of one batch into the audit table (Parquet).

    The table has a folder per batch (``lote``) and day (``dia``), so reads by
    date prune.  A batch's folder is replaced as a whole: a job that is run
    again, also one that was cut off, leaves the table as one run does, and
    other batches are not touched.  ``batch`` names what was read (a source
    file, an hour, a stream's batch id), not the run.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    (
        df.withColumn("dia", F.to_date("ts"))
        .write.mode("overwrite")
        .partitionBy("dia")
        .parquet(f"{path.rstrip('/')}/lote={batch}")
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit table, with its partition columns ``lote`` and ``dia``.  A batch
    without rows leaves a folder without days, which holds no rows to read."""
    return spark.read.schema(AUDIT_TABLE).parquet(path)


def batch_sink_twice(spark: SparkSession, events: DataFrame) -> DataFrame:
    """S4 as a job that is run twice: each half of the months' events is a batch,
    and the second run changes nothing."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/audit-{uuid.uuid4().hex}"
    rows = accepted(events).select(*AUDIT_COLS)
    halves = {"a": F.dayofmonth("ts") <= 15, "b": ~(F.dayofmonth("ts") <= 15) | F.col("ts").isNull()}
    for batch, cond in halves.items():
        write_audit(rows.filter(cond), path, batch)
    for batch, cond in halves.items():
        write_audit(rows.filter(cond), path, batch)
    return read_audit(spark, path).select(*AUDIT_COLS)
