"""Date and time expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Portuguese month names, January to December.
MONTH_NAMES_PT = [
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_name_pt(month_col) -> Column:
    """Month number -> Portuguese name, NULL outside 1..12.

    ``try_element_at`` keeps ANSI mode from raising on a NULL/out-of-range
    month; names are a literal array, so this stays inside codegen.
    """
    names = F.array(*[F.lit(n) for n in MONTH_NAMES_PT])
    return F.try_element_at(names, _c(month_col))


def days_between(end, start) -> Column:
    """``end - start`` in days as INT (E6); NULL if either is NULL."""
    return F.date_diff(_c(end), _c(start))


def as_of_lit(as_of: dt.datetime | dt.date | None) -> Column:
    """The report clock (E14, K21) as a TIMESTAMP_NTZ literal.

    A bare date is midnight (K4).  ``None`` means "now"; reports always pass a
    value so that one request sees one clock.
    """
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if not isinstance(as_of, dt.datetime):
        as_of = dt.datetime(as_of.year, as_of.month, as_of.day)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def as_of_date(as_of: dt.datetime | dt.date | None) -> dt.date:
    """Driver-side "today" for the default period."""
    if as_of is None:
        return dt.date.today()
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    return as_of


def current_month(date_col, as_of: dt.datetime | dt.date | None) -> Column:
    """Date falls in the calendar month of ``as_of`` (F6), as a range so that
    Parquet statistics and date partitions prune."""
    today = as_of_date(as_of)
    first = today.replace(day=1)
    nxt = (first + dt.timedelta(days=32)).replace(day=1)
    d = _c(date_col)
    return (d >= F.lit(first)) & (d < F.lit(nxt))


def since_year(date_col, as_of: dt.datetime | dt.date | None, years_back: int) -> Column:
    """``year(date) >= year(as_of) - years_back`` as a range."""
    y = as_of_date(as_of).year - years_back
    return _c(date_col) >= F.lit(dt.date(y, 1, 1))


def resolve_clock(as_of: dt.datetime | dt.date | None) -> dt.datetime | dt.date:
    """One clock per request.  ``None`` becomes "now" (UTC wall clock,
    matching the UTC session time zone) once, so the default period and the
    status rules cannot disagree around midnight."""
    if as_of is None:
        return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    return as_of


def single_clock(report):
    """Decorator for ``report(tables, filters, as_of)``: resolve ``as_of``
    once before the report builds its plan."""
    import functools

    @functools.wraps(report)
    def run(t, filters=None, as_of=None):
        from ..operators.filters import NO_FILTERS

        return report(t, filters if filters is not None else NO_FILTERS, resolve_clock(as_of))

    return run
