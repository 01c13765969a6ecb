"""freightlens: freight revenue, receivables and payables analytics on Spark.

Views and reports are DataFrame functions over an :class:`ErpTables` bundle;
"""

from .operators.filters import ReportFilters
from .sources.erp import ErpTables

__all__ = ["ErpTables", "ReportFilters"]
