"""Business scalar expressions: region, status, measures, ratios (E3-E5,
E7-E11, E15, E18, E19)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brazilian states (UF) per macro-region.  Anything else,
# including NULL, is "Outros".
REGION_UFS = {
    "Sudeste": ["SP", "RJ", "MG", "ES"],
    "Sul": ["PR", "SC", "RS"],
    "Centro-Oeste": ["MS", "MT", "GO", "DF"],
    "Norte": ["RO", "AC", "AM", "RR", "PA", "TO", "AP"],
    "Nordeste": ["MA", "PI", "CE", "RN", "PB", "PE", "AL", "SE", "BA"],
}
OTHER_REGION = "Outros"

# Status labels.
RECEIVABLE_STATUS_OVERDUE = "Em Atraso"
RECEIVABLE_STATUS_SETTLED = "Recebida"
RECEIVABLE_STATUS_OPEN = "A Receber"
PAYABLE_STATUS_SETTLED = "Pago"
PAYABLE_STATUS_OPEN = "A Pagar"
PAYABLE_STATUS_OVERDUE = "Em Atraso"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def region_of(uf) -> Column:
    """UF -> macro-region (E3); unknown or NULL UF -> 'Outros' (K6)."""
    u = _c(uf)
    expr = None
    for region, ufs in REGION_UFS.items():
        cond = u.isin(ufs)
        expr = F.when(cond, F.lit(region)) if expr is None else expr.when(cond, F.lit(region))
    return expr.otherwise(F.lit(OTHER_REGION))


def city_uf(city, uf) -> Column:
    """``city || '-' || uf``: NULL when either part is NULL."""
    return F.concat(_c(city), F.lit("-"), _c(uf))


def receivable_status(saldo, due_date, as_of: Column) -> Column:
    """K2: overdue first, then settled, else open (NULL/negative saldo and
    NULL due date fall to 'A Receber')."""
    s = _c(saldo)
    due_ts = _c(due_date).cast("timestamp_ntz")
    return (
        F.when((due_ts < as_of) & (s > 0), F.lit(RECEIVABLE_STATUS_OVERDUE))
        .when(s == 0, F.lit(RECEIVABLE_STATUS_SETTLED))
        .otherwise(F.lit(RECEIVABLE_STATUS_OPEN))
    )


def payable_status(saldo, due_date, as_of: Column) -> Column:
    """K3: settled, then open while ``as_of <= due midnight``, else overdue
    (NULL/negative saldo and NULL due date fall to 'Em Atraso')."""
    s = _c(saldo)
    due_ts = _c(due_date).cast("timestamp_ntz")
    return (
        F.when(s == 0, F.lit(PAYABLE_STATUS_SETTLED))
        .when((s > 0) & (as_of <= due_ts), F.lit(PAYABLE_STATUS_OPEN))
        .otherwise(F.lit(PAYABLE_STATUS_OVERDUE))
    )


def tonnes(kg) -> Column:
    """Kilograms -> tonnes, exact on DECIMAL."""
    return _c(kg) * F.lit(Decimal("0.001"))


def row_cost(*cols) -> Column:
    """Plain ``+`` of the cost components: any NULL makes the row NULL."""
    out = _c(cols[0])
    for c in cols[1:]:
        out = out + _c(c)
    return out


def flag(cond: Column) -> Column:
    """1 when ``cond`` holds, else 0 (NULL -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def paid_amount(total, saldo) -> Column:
    """``total - saldo`` on DECIMAL."""
    return _c(total) - _c(saldo)


def as_double(c) -> Column:
    """Aggregate (DECIMAL) -> DOUBLE once, at the output (E17), NULL -> 0.0."""
    return F.coalesce(_c(c).cast("double"), F.lit(0.0))


def as_count(c) -> Column:
    """Integer aggregate -> BIGINT, NULL -> 0."""
    return F.coalesce(_c(c).cast("bigint"), F.lit(0).cast("bigint"))


def safe_ratio(num, den) -> Column:
    """``num / den`` on DOUBLE, 0.0 when ``den`` is 0."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def pct_change(cur, prev) -> Column:
    """``((cur / prev) - 1) * 100`` on DOUBLE, 0.0 when ``prev`` is 0."""
    c, p = _c(cur).cast("double"), _c(prev).cast("double")
    return F.when(p != 0, ((c / p) - F.lit(1.0)) * F.lit(100.0)).otherwise(F.lit(0.0))
