"""Spark-vs-DuckDB comparison used by the tests (same rules as the driver:
column names, row count, order-insensitive values)."""

from __future__ import annotations

import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(table):
    cols = sorted(table.column_names)
    rows = list(zip(*[table.column(c).to_pylist() for c in cols])) if cols else []
    return cols, sorted((tuple(repr(v) for v in r) for r in rows))


def compare_frames(spark_df, con, sql: str):
    """Return None when equal, else a message.  Types are compared on the
    Arrow schemas, values exactly."""
    a = spark_df.toArrow()
    b = con.sql(sql).to_arrow_table()
    sa = {f.name: str(f.type) for f in a.schema}
    sb = {f.name: str(f.type) for f in b.schema}
    if sa != sb:
        return f"schema {sa} != {sb}"
    if a.num_rows != b.num_rows:
        return f"rows {a.num_rows} != {b.num_rows}"
    ca, ra = _canon(a)
    cb, rb = _canon(b)
    if ra != rb:
        for x, y in zip(ra, rb):
            if x != y:
                return f"value {x} != {y}"
    return None
