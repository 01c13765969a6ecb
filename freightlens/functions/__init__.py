"""Column expressions: all built-in Spark functions, no UDFs."""

from .business import (
    OTHER_REGION,
    PAYABLE_STATUS_OPEN,
    PAYABLE_STATUS_OVERDUE,
    PAYABLE_STATUS_SETTLED,
    RECEIVABLE_STATUS_OPEN,
    RECEIVABLE_STATUS_OVERDUE,
    RECEIVABLE_STATUS_SETTLED,
    REGION_UFS,
    as_count,
    as_double,
    city_uf,
    flag,
    paid_amount,
    payable_status,
    pct_change,
    receivable_status,
    region_of,
    row_cost,
    safe_ratio,
    tonnes,
)
from .calendar import (
    MONTH_NAMES_PT,
    as_of_date,
    as_of_lit,
    current_month,
    days_between,
    month_name_pt,
    since_year,
)
from .text import body_kind, canonical_json, clean_body, cpf_is_valid, digits_only, parsed_body, unescape_path

__all__ = [n for n in dir() if not n.startswith("_")]
