"""Aggregation building blocks (A1-A9, U*, P4, P5, P11).

All aggregates are plain ``groupBy().agg()`` / global ``agg()`` so Spark runs
a partial (map-side) aggregation before the shuffle: a hot group key costs one
row per map task, not one task holding a third of the data.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def sum_by(df: DataFrame, keys: Sequence[str | Column], measures: Mapping[str, str | Column]) -> DataFrame:
    """Grouped SUM; ``measures`` maps output name -> input column."""
    aggs = [F.sum(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in measures.items()]
    return df.groupBy(*keys).agg(*aggs)


def conditional_totals(df: DataFrame, spec: Mapping[str, tuple], keys: Sequence[str] = ()) -> DataFrame:
    """A3/A4: several KPIs in one pass (one row, or one row per ``keys``).

    ``spec`` maps output name -> ``(condition, column, fn)`` with ``fn`` one of
    ``"sum"``/``"avg"``.  Each KPI only sees the rows where its condition
    holds (``when`` without ``otherwise`` yields NULL, which SUM/AVG skip), so
    overlapping periods are counted in every window they belong to.
    """
    fns = {"sum": F.sum, "avg": F.avg}
    aggs = []
    for name, (cond, col, fn) in spec.items():
        c = F.col(col) if isinstance(col, str) else col
        v = c if cond is None else F.when(cond, c)
        aggs.append(fns[fn](v).alias(name))
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def zero_fill_union(arms: Sequence[tuple[DataFrame, Mapping[str, Column]]], types: Mapping[str, DataType | str]) -> DataFrame:
    """U1-U9 (P4): UNION ALL of projections onto one conformed schema.

    Each arm is ``(df, {output: expr})``; outputs missing from an arm are
    filled with a typed zero for measures in ``types`` or NULL otherwise.
    Filters written above the union are pushed into every arm by Catalyst.
    """
    names: list[str] = []
    for _, m in arms:
        for n in m:
            if n not in names:
                names.append(n)
    out = None
    for df, m in arms:
        cols = []
        for n in names:
            if n in m:
                e = m[n]
            elif n in types:
                e = F.lit(0)
            else:
                e = F.lit(None)
            if n in types:
                e = e.cast(types[n])
            cols.append(e.alias(n))
        part = df.select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def two_roles(df: DataFrame, keep: Sequence[str], role_a: tuple[Column, Mapping[str, Column]], role_b: tuple[Column, Mapping[str, Column]]) -> DataFrame:
    """A row may feed two groups (e.g. its receipt day and its due day).

    One scan: each row emits up to two records, one per role whose condition
    holds (``explode`` of a two-element array, NULL for a role that does not
    apply, then dropped).  Replaces a UNION ALL of two filtered scans of the
    same table (U6, U8); ``explode`` stays inside whole-stage codegen.
    """
    (cond_a, cols_a), (cond_b, cols_b) = role_a, role_b
    sa = F.struct(*[c.alias(n) for n, c in cols_a.items()])
    sb = F.struct(*[c.alias(n) for n, c in cols_b.items()])
    arr = F.array(F.when(cond_a, sa), F.when(cond_b, sb))
    return (
        df.filter(cond_a | cond_b)
        .select(*keep, F.explode(arr).alias("__role"))
        .filter(F.col("__role").isNotNull())
        .select(*keep, "__role.*")
    )


def total(df: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """A1: global SUM of one measure (one row; NULL when no rows)."""
    return df.agg(F.sum(col).alias(alias or col))


def totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A2: global SUM of several measures in one pass."""
    return df.agg(*[F.sum(c).alias(c) for c in cols])


def two_period_totals(
    df: DataFrame,
    date_col: str,
    cur,
    prev,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    prior_suffix: str = "_p",
) -> DataFrame:
    """A3: the same SUMs for the current and the prior period in one pass.

    ``cur``/``prev`` are periods with ``start``/``end``; a row inside both
    windows (periods longer than the shift) counts in both.  With ``keys``
    the totals are per group (e.g. per tenant).
    """
    from .filters import in_period

    d = F.col(date_col)
    in_cur, in_prev = in_period(d, cur), in_period(d, prev)
    aggs = []
    for m in measures:
        aggs.append(F.sum(F.when(in_cur, F.col(m))).alias(m))
        aggs.append(F.sum(F.when(in_prev, F.col(m))).alias(m + prior_suffix))
    rows = df.filter(in_cur | in_prev)
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def mean_of(df: DataFrame, col: str, cond: Column | None = None, alias: str | None = None) -> DataFrame:
    """AVG ignoring NULLs, optionally over the rows where ``cond`` holds."""
    c = F.col(col) if cond is None else F.when(cond, F.col(col))
    return df.agg(F.avg(c).alias(alias or col))


def sorted_by(df: DataFrame, *cols) -> DataFrame:
    """O1-O3: presentation order (calendar keys ascending, measure or due
    date descending).  A global sort is a range-partitioned shuffle, so it
    scales; reports apply it last, on the aggregated rows."""
    return df.orderBy(*cols)
