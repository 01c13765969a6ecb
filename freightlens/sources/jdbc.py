"""JDBC readers for the tenant's ERP database and the control database
(S1, S2, S3).  Connection details always come from the caller or from the
company registry; nothing is embedded here.  There is no database in the test
environment, so only the option building is tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

#: JDBC driver classes for the two databases the reference talks to.
FIREBIRD_DRIVER = "org.firebirdsql.jdbc.FBDriver"
POSTGRES_DRIVER = "org.postgresql.Driver"


def firebird_url(host: str, port: str | int, path: str, charset: str = "ISO8859_1") -> str:
    """URL for a tenant database (host, port and file path from the registry)."""
    return f"jdbc:firebirdsql://{host}:{port}/{path}?encoding={charset}"


def postgres_url(host: str, port: str | int, database: str) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def jdbc_options(
    url: str,
    table: str,
    properties: dict[str, str],
    partitioning: dict | None = None,
    fetchsize: int = 10_000,
) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``.

    ``partitioning`` = ``{"partitionColumn", "lowerBound", "upperBound",
    "numPartitions"}`` splits a large table into parallel range reads.
    """
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetchsize)}
    opts.update({k: str(v) for k, v in properties.items()})
    if partitioning:
        need = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
        missing = need - set(partitioning)
        if missing:
            raise ValueError(f"partitioning misses {sorted(missing)}")
        opts.update({k: str(v) for k, v in partitioning.items()})
    return opts


def jdbc_reader(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], partitioning: dict | None = None
) -> DataFrameReader:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, properties, partitioning))


def read_table(spark: SparkSession, name: str, source: dict) -> DataFrame:
    """Read a business or control table.

    ``source`` is either ``{"format": "parquet", "path": ...}`` or
    ``{"format": "jdbc", "url": ..., "properties": {...}, "partitioning": {...}}``.
    """
    fmt = source.get("format", "parquet")
    if fmt == "parquet":
        return spark.read.parquet(f"{source['path'].rstrip('/')}/{name}")
    if fmt == "jdbc":
        return jdbc_reader(spark, source["url"], name, source.get("properties", {}), source.get("partitioning")).load()
    raise ValueError(f"unknown format {fmt!r}")


def tenant_source(companies: DataFrame, codempresa) -> DataFrame:
    """S3: connection attributes of one tenant; empty when unknown."""
    return companies.filter(F.col("codempresa") == F.lit(codempresa)).select("ipbd", "portabd", "caminhobd")


def tenant_sources(companies: DataFrame, active_only: bool = True) -> DataFrame:
    """Connection attributes of every tenant, as a DataFrame."""
    df = companies
    if active_only:
        df = df.filter(F.col("ativa") == "S")
    return df.select("codempresa", "ipbd", "portabd", "caminhobd")


def requested_sources(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """S3 for a batch of requests (column ``codempresa``): a row per company asked
    for, with its requests and connection attributes; ``conhecida`` is false and
    they are NULL where the registry has no such company.  Requests are counted
    before the join, so a company that most of them ask for is one row."""
    asked = requests.groupBy("codempresa").agg(F.count(F.lit(1)).alias("pedidos"))
    known = companies.select("codempresa", "ipbd", "portabd", "caminhobd", F.lit(True).alias("__known"))
    return asked.join(known, "codempresa", "left").select(
        "codempresa", "pedidos", F.col("__known").isNotNull().alias("conhecida"), "ipbd", "portabd", "caminhobd")


def read_control(spark: SparkSession, name: str, source: dict) -> DataFrame:
    """Control tables (companies, users, audit) - same readers as S1,
    pointed at the control database or its Parquet export."""
    return read_table(spark, name, source)


def month_predicates(date_col: str, start, end) -> list[str]:
    """One WHERE predicate per calendar month in [start, end], plus one for
    NULL dates: ``spark.read.jdbc(..., predicates=...)`` then reads every
    month in its own task (parallel, and each task's query can use the
    database's date index)."""
    import datetime as dt

    preds = []
    cur = dt.date(start.year, start.month, 1)
    while cur <= end:
        nxt = dt.date(cur.year + (cur.month == 12), cur.month % 12 + 1, 1)
        preds.append(f"{date_col} >= DATE '{cur.isoformat()}' AND {date_col} < DATE '{nxt.isoformat()}'")
        cur = nxt
    preds.append(f"{date_col} IS NULL OR {date_col} < DATE '{dt.date(start.year, start.month, 1).isoformat()}' "
                 f"OR {date_col} >= DATE '{cur.isoformat()}'")
    return preds


def read_by_months(spark: SparkSession, url: str, table: str, properties: dict[str, str], date_col: str, start, end) -> DataFrame:
    """S1 for a large fact: parallel month-by-month JDBC read (the last
    predicate covers NULL and out-of-range dates, so no row is lost)."""
    props = {k: str(v) for k, v in properties.items()}
    return spark.read.jdbc(url, table, predicates=month_predicates(date_col, start, end), properties=props)
