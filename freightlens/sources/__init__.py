"""Sources and sinks: ERP bundle, fixture mapping, JDBC, control tables."""

from .erp import DIMENSIONS, FACTS, ErpTables, refresh_months, stage, stage_bucketed
from .jdbc import (
    firebird_url,
    jdbc_options,
    month_predicates,
    postgres_url,
    read_by_months,
    read_control,
    read_table,
    tenant_source,
    tenant_sources,
)

__all__ = [
    "DIMENSIONS",
    "FACTS",
    "ErpTables",
    "stage",
    "stage_bucketed",
    "refresh_months",
    "month_predicates",
    "read_by_months",
    "firebird_url",
    "jdbc_options",
    "postgres_url",
    "read_control",
    "read_table",
    "tenant_source",
    "tenant_sources",
]
