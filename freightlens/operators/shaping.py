"""Result shaping (R1-R6): from flat report rows to the reference's response
shapes.

Reports themselves stay flat DataFrames, and so do the map shapes: one row per
entry of the map, so a result of any size is delivered by the executors and no
task holds it whole.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults for missing calendar keys and month names.
MISSING_CALENDAR_KEY = "0"
MISSING_MONTH_NAME = "Indefinido"


def collapse_last_wins(df: DataFrame, key: str | Sequence[str], measure: str, label: str | None = None, *more: Column) -> DataFrame:
    """One row per key, the one the reference's dict keeps.

    Rows arrive sorted by ``measure`` DESC and later rows overwrite earlier
    ones, so the survivor has the smallest measure (NULL sorts last in DESC,
    so a NULL measure survives); ties go to the smallest label.  Written as a
    ``min_by`` aggregate, so a hot key is pre-aggregated map-side.  ``more`` are
    further aggregates over a key's rows, kept under their own names.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(measure), F.col(label)) if label else F.struct(F.col(measure))
    picked = F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("__pick")
    one = df.groupBy(*keys).agg(picked, *more)
    return one.select(*keys, *[F.col(f"__pick.{c}").alias(c) for c in others], *[c for c in one.columns if c not in (*keys, "__pick")])


def default_keys(df: DataFrame, calendar_cols: Sequence[str] = (), month_name_cols: Sequence[str] = ()) -> DataFrame:
    """Calendar keys as strings with NULL -> "0", month names NULL ->
    "Indefinido"."""
    repl = {}
    for c in calendar_cols:
        repl[c] = F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(MISSING_CALENDAR_KEY))
    for c in month_name_cols:
        repl[c] = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_MONTH_NAME))
    return df.withColumns(repl)


def to_entries(df: DataFrame, keys: str | Sequence[str], value_cols: Sequence[str], *keep: str) -> DataFrame:
    """The entries of ``map<key, struct<value_cols>>`` (one key) or of
    ``map<k1, map<k2, struct<value_cols>>>`` (two), a row each: ``chave`` (and
    ``subchave``) as strings, ``valor``, after the columns ``keep``.  Keys should
    be unique (run :func:`collapse_last_wins` first)."""
    names = [keys] if isinstance(keys, str) else list(keys)
    out = [F.col(k).cast("string").alias(a) for k, a in zip(names, ("chave", "subchave"))]
    return df.select(*keep, *out, F.struct(*value_cols).alias("valor"))


def entries_json(entries: DataFrame) -> DataFrame:
    """Entries as JSON text, one object per row, next to ``posicao`` if they
    have one; NULL fields are kept."""
    value = F.col("valor")
    for k in [c for c in ("subchave", "chave") if c in entries.columns]:
        value = F.create_map(F.col(k), value)
    place = [c for c in ("posicao",) if c in entries.columns]
    return entries.select(*place, F.to_json(value, {"ignoreNullFields": "false"}).alias("json"))


def to_json_rows(df: DataFrame) -> DataFrame:
    """Row list (R3) as JSON text per row, for delivery without a driver
    collect; NULL fields are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def one_row(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """A global aggregate already yields exactly one row; replace NULLs
    with the given zero values."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def conform(df: DataFrame, mapping: dict) -> DataFrame:
    """Project onto one conformed schema; ``mapping`` is output name ->
    input column name or Column."""
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()])


def output_types(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Delivery types - codes to STRING, sums to DOUBLE (NULL -> 0.0),
    counts to BIGINT (NULL -> 0); ``schema`` maps column -> 'string' |
    'double' | 'bigint'.  Other columns pass through."""
    out = []
    for c in df.columns:
        kind = schema.get(c)
        if kind == "double":
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        elif kind == "bigint":
            out.append(F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c))
        elif kind == "string":
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
