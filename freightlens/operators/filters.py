"""Report filters.

``ReportFilters`` is the driver-side request object.  Everything that touches
data is a Column predicate, so Catalyst pushes it through unions and outer
lookups down to the fact scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import as_of_date

Scalar = int | str
FilterValue = Scalar | Sequence[Scalar] | None


@dataclass(frozen=True)
class ReportFilters:
    """Request filters (the reference's BI filter body).

    Each code filter takes a scalar or a list (K13 superset); ``None`` and an
    empty list mean "no filter", ``0`` means ``[0]`` (K12).
    """

    data_inicio: dt.date | None = None
    data_fim: dt.date | None = None
    codfilial: FilterValue = None
    codcliente: FilterValue = None
    codcid: FilterValue = None
    regiao: FilterValue = None
    codpro: FilterValue = None
    ano: FilterValue = None
    mes: FilterValue = None
    dia: FilterValue = None
    codfornecedor: FilterValue = None
    codtransacao: FilterValue = None


NO_FILTERS = ReportFilters()


def as_list(value: Any) -> list | None:
    """``None`` -> ``None``; list -> list; scalar -> ``[scalar]``."""
    if value is None:
        return None
    if isinstance(value, (list, tuple, set, frozenset)):
        return list(value)
    return [value]


def active(value: Any) -> list | None:
    """The normalised list when the filter applies (non-empty), else None."""
    lst = as_list(value)
    return lst if lst else None


@dataclass(frozen=True)
class Period:
    start: dt.date
    end: dt.date


def resolve_period(filters: ReportFilters, as_of) -> Period:
    """end defaults to today (``as_of``), start to end - 30 days."""
    end = filters.data_fim or as_of_date(as_of)
    start = filters.data_inicio or (end - dt.timedelta(days=30))
    return Period(start, end)


def prior_period(filters: ReportFilters, as_of) -> Period:
    """Both ends minus 365 days (not one calendar year)."""
    cur = resolve_period(filters, as_of)
    return Period(cur.start - dt.timedelta(days=365), cur.end - dt.timedelta(days=365))


def in_period(col, period: Period) -> Column:
    """inclusive date range (sargable, pushes to Parquet)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(period.start)) & (c <= F.lit(period.end))


def _coerce(values: list, type_name: str) -> list:
    """Filter values in the column's type (a numeric code for a text column
    is compared as text, never by casting the column under ANSI)."""
    if type_name == "string":
        return [None if v is None else str(v) for v in values]
    if type_name in ("integer", "long", "short", "byte"):
        return [None if v is None else int(v) for v in values]
    return values


def isin_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """F2 for one column: ``IN``, whatever the list's length (Spark keeps it as a
    set and pushes it to the scan)."""
    return df.filter(F.col(column).isin(_coerce(values, df.schema[column].dataType.typeName())))


def apply_filters(df: DataFrame, filters: ReportFilters, fields: Mapping[str, str]) -> DataFrame:
    """AND of optional IN-lists.

    ``fields`` maps a filter name (``codfilial``, ``ano`` ...) to the column
    it restricts in ``df``; filters not listed are ignored, as in the
    reference's per-report matrix.
    """
    for name, column in fields.items():
        values = active(getattr(filters, name))
        if values is not None:
            df = isin_list(df, column, values)
    return df


def filter_predicate(filters: ReportFilters, fields: Mapping[str, str]) -> Column | None:
    """The same filters as one predicate (short lists only), for use inside
    conditional aggregates where rows cannot be dropped up front."""
    pred = None
    for name, column in fields.items():
        values = active(getattr(filters, name))
        if values is not None:
            p = F.col(column).isin(values)
            pred = p if pred is None else (pred & p)
    return pred


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """point lookup by key."""
    return df.filter(F.col(key) == F.lit(value))


def needed_filter_columns(filters: ReportFilters, fields: Mapping[str, str]) -> set[str]:
    return {col for name, col in fields.items() if active(getattr(filters, name)) is not None}
