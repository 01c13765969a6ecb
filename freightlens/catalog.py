"""Registered queries: every view, report, filtered report and batch job as
``(spark, sf_dir) -> DataFrame``, with the matching DuckDB SQL.

All registered queries read the driver's whole tables through the fixture
mapping, with one fixed clock (``AS_OF``) so results are reproducible.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle_sql as osql
from . import plans
from .operators.filters import NO_FILTERS, ReportFilters
from .operators.shaping import collapse_last_wins
from .plans import audit
from .plans import registry as registry_jobs
from .plans.responses import SHAPES
from .sources import fixtures as fx
from .sources.erp import ErpTables
from .streaming import audit_stream

#: The report clock for registered queries (FIXTURES.md §3).
AS_OF = dt.datetime(2000, 6, 15, 12, 0, 0)

_CLIENTS = [f"{i:014d}" for i in range(200)]
_SUPPLIERS = [f"{i:014d}" for i in range(20)]

#: Filters for the ``<report>_filtered`` variants: each report gets filters
#: from its own honoured set, values from FIXTURES.md §3.
FILTERED: dict[str, ReportFilters] = {
    "big_numbers": ReportFilters(codfilial=[1, 2, 3, 7], regiao=["Sul", "Sudeste"], mes=[5, 6]),
    "kpi_mes_ano": ReportFilters(codfilial=[1, 2, 3, 7], codcid=list(range(40)), ano=2000),
    "kpi_dia_mes_atual": ReportFilters(codfilial=[1, 2, 3, 7], dia=list(range(1, 21))),
    "kpi_filial": ReportFilters(codfilial=[1, 2, 3, 7], codcliente=_CLIENTS, dia=list(range(1, 21))),
    "kpi_regiao": ReportFilters(regiao=["Sul", "Sudeste"], codpro=list(range(1000))),
    "kpi_cidade": ReportFilters(codcid=list(range(40)), mes=[5, 6]),
    "kpi_cliente": ReportFilters(codcliente=_CLIENTS, regiao=["Sul", "Sudeste"]),
    "kpi_produto": ReportFilters(codfilial=[1, 2, 3, 7], codpro=list(range(1000))),
    "tabela_faturamento": ReportFilters(codfilial=[1, 2, 3, 7], regiao=["Sul", "Sudeste"]),
    "big_numbers_contas_receber": ReportFilters(codfilial=[1, 2, 3, 7], codcliente=_CLIENTS),
    "recebimentos_dia_mes_atual": ReportFilters(codfilial=[1, 2, 3, 7], codcliente=_CLIENTS),
    "a_receber_cliente": ReportFilters(codfilial=[1, 2, 3, 7], codcliente=_CLIENTS),
    "tabela_a_receber": ReportFilters(codfilial=[1, 2, 3, 7], codcliente=_CLIENTS),
    "big_numbers_contas_pagar": ReportFilters(codfornecedor=_SUPPLIERS, codtransacao=[1, 2, 6]),
    "contas_pagar_dia_mes_atual": ReportFilters(codfornecedor=_SUPPLIERS, codtransacao=[1, 2, 6]),
    "a_pagar_fornecedor": ReportFilters(codfornecedor=_SUPPLIERS, codtransacao=[1, 2, 6]),
    "tabela_a_pagar": ReportFilters(codfornecedor=_SUPPLIERS, codtransacao=[1, 2, 6]),
}

#: Forward period (K25): open balances only appear when the period ends later
#: than the clock.
FORWARD = ReportFilters(data_inicio=dt.date(2000, 6, 1), data_fim=dt.date(2000, 7, 31))
FORWARD_REPORTS = (
    "big_numbers_contas_receber", "a_receber_cliente", "tabela_a_receber",
    "big_numbers_contas_pagar", "a_pagar_fornecedor", "tabela_a_pagar", "big_numbers",
)

_TABLES: dict = {}


def tables(spark: SparkSession, sf_dir: str, multi_tenant: bool = False) -> ErpTables:
    """One bundle per session and folder, so the dimension size checks run
    once."""
    key = (id(spark), sf_dir, multi_tenant)
    t = _TABLES.get(key)
    if t is None or t.spark is not spark:
        t = ErpTables.from_fixture(spark, sf_dir, multi_tenant=multi_tenant)
        _TABLES[key] = t
    return t


Query = Callable[[SparkSession, str], DataFrame]


def _report(name: str, filters: ReportFilters) -> Query:
    fn = plans.REPORTS[name]
    return lambda spark, sf_dir: fn(tables(spark, sf_dir), filters, AS_OF)


def _list(name: str) -> Query:
    fn = plans.LISTS[name]
    return lambda spark, sf_dir: fn(tables(spark, sf_dir))


def _kpi_cidade_last_wins(spark, sf_dir) -> DataFrame:
    df = plans.kpi_cidade(tables(spark, sf_dir), NO_FILTERS, AS_OF)
    return collapse_last_wins(df, "codcid", "faturamento", "cidade")


def _all_tenants(name: str) -> Query:
    fn = plans.REPORTS[name]
    return lambda spark, sf_dir: fn(tables(spark, sf_dir, multi_tenant=True), NO_FILTERS, AS_OF)


def _response(name: str) -> Query:
    """The report's map entries (R1, R2, R5), values flattened."""
    report = _report(name, NO_FILTERS)

    def run(spark, sf_dir) -> DataFrame:
        entries = plans.response(name, report(spark, sf_dir))
        return entries.select(*[c for c in entries.columns if c != "valor"], "valor.*")

    return run


#: Reports whose entries are registered: all maps, by month, by day and by code.
RESPONSES = tuple(name for name, shape in SHAPES.items() if shape[0] != "rows")


def report_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "vw_tbcid": lambda s, d: plans.city_view_of(tables(s, d)),
        "vw_factrc": lambda s, d: plans.as_output(plans.receivables_view(tables(s, d), AS_OF)),
        "vw_frctrc": lambda s, d: plans.as_output(plans.freight_view(tables(s, d))),
        "vw_cptit": lambda s, d: plans.as_output(plans.payables_view(tables(s, d), AS_OF)),
    }
    for name in plans.REPORTS:
        q[name] = _report(name, NO_FILTERS)
    for name in plans.LISTS:
        q[name] = _list(name)
    for name, f in FILTERED.items():
        q[f"{name}_filtered"] = _report(name, f)
    for name in FORWARD_REPORTS:
        q[f"{name}_forward"] = _report(name, FORWARD)
    q["kpi_cidade_last_wins"] = _kpi_cidade_last_wins
    for name in plans.REPORTS:
        q[f"{name}_all_tenants"] = _all_tenants(name)
    for name in RESPONSES:
        q[f"response_{name}"] = _response(name)
    return q


def report_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    for name, fn in osql.VIEW_SQL.items():
        s[name] = osql.full_sql(fn(), AS_OF)
    for name, fn in osql.REPORT_SQL.items():
        s[name] = osql.full_sql(fn(NO_FILTERS, AS_OF), AS_OF)
    for name, fn in osql.LIST_SQL.items():
        s[name] = osql.full_sql(fn(), AS_OF)
    for name, f in FILTERED.items():
        s[f"{name}_filtered"] = osql.full_sql(osql.REPORT_SQL[name](f, AS_OF), AS_OF)
    for name in FORWARD_REPORTS:
        s[f"{name}_forward"] = osql.full_sql(osql.REPORT_SQL[name](FORWARD, AS_OF), AS_OF)
    s["kpi_cidade_last_wins"] = osql.full_sql(osql.kpi_cidade_last_wins(NO_FILTERS, AS_OF), AS_OF)
    s["kpi_filial_all_tenants"] = osql.full_sql(osql.kpi_filial(NO_FILTERS, AS_OF, tenant=True), AS_OF, multi_tenant=True)
    for name, fn in osql.TENANT_SQL.items():
        s[name] = osql.full_sql(fn(NO_FILTERS, AS_OF), AS_OF, multi_tenant=True)
    for name in RESPONSES:
        _, key, values, measure, label = SHAPES[name]
        keys = [key] if isinstance(key, str) else list(key)
        s[f"response_{name}"] = osql.full_sql(osql.response_entries(name, keys, values, measure, label, NO_FILTERS, AS_OF), AS_OF)
    return s


def control_queries() -> dict[str, Query]:
    q: dict[str, Query] = dict(registry_jobs.QUERIES)
    q["audit_normalised"] = lambda s, d: audit.accepted(fx.audit_events(s, d)).select(*audit.AUDIT_COLS)
    q["audit_rejected"] = lambda s, d: audit.rejected(fx.audit_events(s, d)).select(*audit.AUDIT_COLS)
    q["audit_batch_sink"] = lambda s, d: audit.batch_sink_twice(s, fx.audit_events(s, d))
    q["audit_bodies"] = lambda s, d: audit.parsed_bodies(fx.audit_body_events(s, d))
    q["audit_stream_append"] = lambda s, d: audit_stream.run_audit_stream_once(s, d)
    return q


def all_queries() -> dict[str, Query]:
    return {**report_queries(), **control_queries()}


def all_sql() -> dict[str, str]:
    return {**report_sql(), **{k: fn() for k, fn in osql.CONTROL_SQL.items()}}
