"""Revenue and operations reports Q1-Q9.

``operations`` is the conformed UNION ALL of receivables and freight (U1-U5)
that Q2-Q6 aggregate; filters are written once above it and Catalyst pushes
them into both arms and below the lookups (P1, P2).
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_count, as_double, city_uf, pct_change, safe_ratio
from ..functions.calendar import as_of_date, current_month, since_year, single_clock
from ..operators.aggregates import sum_by, two_period_totals, zero_fill_union
from ..operators.filters import (
    NO_FILTERS,
    ReportFilters,
    apply_filters,
    in_period,
    needed_filter_columns,
    prior_period,
    resolve_period,
)
from ..sources.erp import ErpTables
from .views import freight_view, receivables_view

VOLUME_T = "decimal(21,6)"
MONEY_T = "decimal(17,2)"

# Filter fields honoured per report (column names on the conformed rows).
OPS_FIELDS_FULL = {
    "codfilial": "codfilial", "codcliente": "codcliente", "codcid": "codcid", "regiao": "regiao",
    "codpro": "codpro", "ano": "ano", "mes": "mes_numero", "dia": "dia",
}
OPS_FIELDS_NO_CLIENT = {
    "codfilial": "codfilial", "codcid": "codcid", "regiao": "regiao",
    "ano": "ano", "mes": "mes_numero", "dia": "dia",
}
RECEIVABLE_LIST_FIELDS = {"codfilial": "codfilial", "codcliente": "codcliente", "regiao": "regiao", "codpro": "codpro"}

# Conformed column -> (receivables view column, freight view column).
_CONFORMED = {
    "filial": ("filial", "filial"),
    "codfilial": ("codfilial", "codfilial"),
    "codcliente": ("codcliente", "codcliente"),
    "codcid": ("codcid", "codcid"),
    "cidade": ("cidade", "cidade"),
    "coduf": ("coduf", "coduf"),
    "regiao": ("regiao", "regiao"),
    "codpro": ("codpro", "codpro"),
    "data_operacao": ("datarecbto", "dataemissao"),
    "dia": ("dia_recbto", "dia_emissao"),
    "mes_numero": ("mes_numero", "mes_numero"),
    "mes": ("mes_recbto", "mes_emissao"),
    "ano": ("ano_recbto", "ano_emissao"),
}


def operations(t: ErpTables, as_of, columns: Iterable[str], ranges: list | None = None) -> DataFrame:
    """One row per receivable (faturamento) and per freight document
    (volume, embarques), on the conformed keys in ``columns``.  ``ranges``
    are the ``data_operacao`` ranges the caller filters on (pruning hint)."""
    cols = [c for c in _CONFORMED if c in set(columns)]
    tc = list(t.tenant_cols)
    rec = receivables_view(
        t, as_of, need={_CONFORMED[c][0] for c in cols} | {"vlrrecbto"}, prune=_hint("datarecbto", ranges)
    )
    frt = freight_view(
        t, need={_CONFORMED[c][1] for c in cols} | {"pesofrete_ton", "embarque"}, prune=_hint("dataemissao", ranges)
    )
    rec_map = {c: F.col(c) for c in tc} | {c: F.col(_CONFORMED[c][0]) for c in cols}
    rec_map["faturamento"] = F.col("vlrrecbto")
    frt_map = {c: F.col(c) for c in tc} | {c: F.col(_CONFORMED[c][1]) for c in cols}
    frt_map["volume"] = F.col("pesofrete_ton")
    frt_map["embarques"] = F.col("embarque")
    types = {"volume": VOLUME_T, "embarques": "int", "faturamento": MONEY_T}
    return zero_fill_union([(rec, rec_map), (frt, frt_map)], types)


def _hint(col: str, ranges: list | None) -> dict | None:
    return {col: ranges} if ranges else None


def _month_range(as_of) -> list:
    first = as_of_date(as_of).replace(day=1)
    return [(first, first)]


def _period_range(filters, as_of) -> list:
    p = resolve_period(filters, as_of)
    return [(p.start, p.end)]


def _ops_report(t, as_of, filters, fields, keys, extra_cols=(), period_pred=None, ranges=None) -> DataFrame:
    need = set(keys) | set(extra_cols) | needed_filter_columns(filters, fields) | {"data_operacao"}
    ops = operations(t, as_of, need, ranges)
    if period_pred is not None:
        ops = ops.filter(period_pred)
    ops = apply_filters(ops, filters, fields)
    return ops


def _ops_measures(df: DataFrame, keys: list) -> DataFrame:
    return sum_by(df, keys, {"volume": "volume", "embarques": "embarques", "faturamento": "faturamento"})


def _ops_output() -> list:
    return [
        as_double(F.col("volume")).alias("volume"),
        as_count(F.col("embarques")).alias("embarques"),
        as_double(F.col("faturamento")).alias("faturamento"),
    ]


# ----------------------------------------------------------------------- Q1
@single_clock
def big_numbers(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q1: revenue, volume, shipments, average ticket, costs, tolls and margin
    for the period and the prior period (-365 days), with percent changes.

    One pass per fact (A3, P5): both periods are conditional sums over the
    rows in either window (a period longer than 365 days counts rows in both).
    The same filters, including ``ano/mes/dia``, apply to both periods (K9).
    Always one row (R6).
    """
    cur, prev = resolve_period(filters, as_of), prior_period(filters, as_of)
    fields = OPS_FIELDS_FULL
    fcols = needed_filter_columns(filters, fields)
    tc = list(t.tenant_cols)
    rec_need = {_CONFORMED[c][0] for c in fcols if c in _CONFORMED} | {"datarecbto", "vlrrecbto"}
    frt_need = {_CONFORMED[c][1] for c in fcols if c in _CONFORMED} | {
        "dataemissao", "vlrcusto", "vlrpedagio", "pesofrete_ton", "embarque", "faturado",
    }
    both = [(cur.start, cur.end), (prev.start, prev.end)]
    rec = receivables_view(t, as_of, need=rec_need, prune=_hint("datarecbto", both))
    frt = freight_view(t, need=frt_need, prune=_hint("dataemissao", both))
    keymap_r = {c: F.col(c) for c in tc} | {c: F.col(_CONFORMED[c][0]) for c in fcols}
    keymap_f = {c: F.col(c) for c in tc} | {c: F.col(_CONFORMED[c][1]) for c in fcols}
    rows = zero_fill_union(
        [
            (rec, keymap_r | {"data_operacao": F.col("datarecbto"), "fat": F.col("vlrrecbto")}),
            (
                frt,
                keymap_f
                | {
                    "data_operacao": F.col("dataemissao"),
                    "custo": F.col("vlrcusto"),
                    "pedagio": F.col("vlrpedagio"),
                    "volume": F.col("pesofrete_ton"),
                    "embarque": F.col("embarque"),
                    "faturado": F.col("faturado"),
                },
            ),
        ],
        types={},
    )
    rows = apply_filters(rows, filters, fields)
    tot = two_period_totals(
        rows, "data_operacao", cur, prev, ["fat", "custo", "pedagio", "volume", "embarque", "faturado"], keys=tc
    )
    keys = tc

    # totals as DOUBLE / BIGINT once (NULL -> 0), then the KPIs over them
    tot = tot.select(
        *keys,
        *[as_double(F.col(c)).alias(c) for c in ("fat", "fat_p", "custo", "custo_p", "pedagio", "pedagio_p",
                                                 "volume", "volume_p")],
        *[as_count(F.col(c)).alias(c) for c in ("embarque", "embarque_p", "faturado", "faturado_p")],
    )
    fat, fat_p = F.col("fat"), F.col("fat_p")
    cus, cus_p = F.col("custo"), F.col("custo_p")
    ped, ped_p = F.col("pedagio"), F.col("pedagio_p")
    vol, vol_p = F.col("volume"), F.col("volume_p")
    emb, emb_p = F.col("embarque"), F.col("embarque_p")
    ftd, ftd_p = F.col("faturado"), F.col("faturado_p")

    ticket = safe_ratio(fat, ftd)
    ticket_p_ok = (ftd != 0) & (ftd_p != 0) & (fat_p != 0)
    ticket_chg = F.when(
        ticket_p_ok,
        (((fat / ftd.cast("double")) / (fat_p / ftd_p.cast("double"))) - F.lit(1.0)) * F.lit(100.0),
    ).otherwise(F.lit(0.0))
    margin = F.when(fat != 0, ((fat - cus) / fat) * F.lit(100.0)).otherwise(F.lit(0.0))
    prior_margin = (fat_p - cus_p) / fat_p
    # A prior margin of exactly zero would divide by zero; 0.0 instead.
    margin_ok = (fat != 0) & (fat_p != 0) & (F.when(fat_p != 0, prior_margin) != 0)
    margin_chg = F.when(
        margin_ok, ((((fat - cus) / fat) / F.when(fat_p != 0, prior_margin)) - F.lit(1.0)) * F.lit(100.0)
    ).otherwise(F.lit(0.0))
    return tot.select(
        *keys,
        fat.alias("faturamento"),
        pct_change(fat, fat_p).alias("faturamento_ano_anterior"),
        vol.alias("volumes"),
        pct_change(vol, vol_p).alias("volumes_ano_anterior"),
        emb.alias("embarques"),
        pct_change(emb, emb_p).alias("embarques_ano_anterior"),
        ticket.alias("ticket_medio"),
        ticket_chg.alias("ticket_medio_ano_anterior"),
        cus.alias("custos"),
        pct_change(cus, cus_p).alias("custos_ano_anterior"),
        ped.alias("pedagios"),
        pct_change(ped, ped_p).alias("pedagios_ano_anterior"),
        margin.alias("margem"),
        margin_chg.alias("margem_ano_anterior"),
    )


# ----------------------------------------------------------------------- Q2
@single_clock
def kpi_mes_ano(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q2: volume, shipments and revenue by year/month, from two years before
    ``as_of`` onwards (F7, K19; later years pass)."""
    tc = list(t.tenant_cols)
    keys = tc + ["ano", "mes", "mes_numero"]
    ops = _ops_report(
        t, as_of, filters, OPS_FIELDS_NO_CLIENT, keys,
        period_pred=since_year(F.col("data_operacao"), as_of, 2),
        ranges=[(dt.date(as_of_date(as_of).year - 2, 1, 1), None)],
    )
    agg = _ops_measures(ops, keys)
    return agg.select(*tc, "ano", "mes_numero", "mes", *_ops_output()).orderBy(*tc, "ano", "mes_numero")


# ----------------------------------------------------------------------- Q3
@single_clock
def kpi_dia_mes_atual(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q3: volume, shipments and revenue by day of the current month."""
    tc = list(t.tenant_cols)
    keys = tc + ["dia"]
    ops = _ops_report(
        t, as_of, filters, OPS_FIELDS_NO_CLIENT, keys,
        period_pred=current_month(F.col("data_operacao"), as_of),
        ranges=_month_range(as_of),
    )
    agg = _ops_measures(ops, keys)
    return agg.select(*tc, "dia", *_ops_output()).orderBy(*tc, "dia")


# ------------------------------------------------------------------- Q4-Q6
@single_clock
def kpi_filial(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q4: volume, shipments and revenue by branch in the period."""
    tc = list(t.tenant_cols)
    keys = tc + ["codfilial", "filial"]
    ops = _ops_report(
        t, as_of, filters, OPS_FIELDS_FULL, keys,
        period_pred=in_period("data_operacao", resolve_period(filters, as_of)),
        ranges=_period_range(filters, as_of),
    )
    agg = _ops_measures(ops, keys)
    return agg.select(
        *tc, F.col("codfilial").cast("string").alias("codfilial"), "filial", *_ops_output()
    ).orderBy(*tc, F.desc("faturamento"), "codfilial", "filial")


@single_clock
def kpi_regiao(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q5: volume, shipments and revenue by macro-region in the period."""
    tc = list(t.tenant_cols)
    keys = tc + ["regiao"]
    ops = _ops_report(
        t, as_of, filters, OPS_FIELDS_FULL, keys,
        period_pred=in_period("data_operacao", resolve_period(filters, as_of)),
        ranges=_period_range(filters, as_of),
    )
    agg = _ops_measures(ops, keys)
    return agg.select(*tc, "regiao", *_ops_output()).orderBy(*tc, F.desc("faturamento"), "regiao")


@single_clock
def kpi_cidade(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q6: by city code and ``cidade-UF`` (A7).  Receivables take the code
    from the destination city but the name from the payment city (K1), so one
    code can have many labels; all groups are returned (see
    ``collapse_last_wins`` for the reference's one-per-code shape)."""
    tc = list(t.tenant_cols)
    ops = _ops_report(
        t, as_of, filters, OPS_FIELDS_NO_CLIENT, ["codcid"], extra_cols=["cidade", "coduf"],
        period_pred=in_period("data_operacao", resolve_period(filters, as_of)),
        ranges=_period_range(filters, as_of),
    )
    ops = ops.withColumn("cidade_uf", city_uf(F.col("cidade"), F.col("coduf")))
    keys = tc + ["codcid", "cidade_uf"]
    agg = _ops_measures(ops, keys)
    return agg.select(
        *tc,
        F.col("codcid").cast("string").alias("codcid"),
        F.col("cidade_uf").alias("cidade"),
        *_ops_output(),
    ).orderBy(*tc, F.desc("faturamento"), "codcid", "cidade")


# ------------------------------------------------------------------- Q7-Q9
def _receivable_period_rows(t, filters, as_of, need) -> DataFrame:
    fields = RECEIVABLE_LIST_FIELDS
    need = set(need) | needed_filter_columns(filters, fields) | {"datarecbto"}
    rec = receivables_view(t, as_of, need=need, prune=_hint("datarecbto", _period_range(filters, as_of)))
    rec = rec.filter(in_period("datarecbto", resolve_period(filters, as_of)))
    return apply_filters(rec, filters, fields)


@single_clock
def kpi_cliente(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q7: revenue by customer in the period (receipt date)."""
    tc = list(t.tenant_cols)
    rows = _receivable_period_rows(t, filters, as_of, {"codcliente", "cliente", "vlrrecbto"})
    agg = sum_by(rows, tc + ["codcliente", "cliente"], {"faturamento": "vlrrecbto"})
    return agg.select(
        *tc, F.col("codcliente").cast("string").alias("codcliente"), "cliente",
        as_double(F.col("faturamento")).alias("faturamento"),
    ).orderBy(*tc, F.desc("faturamento"), "codcliente", "cliente")


@single_clock
def kpi_produto(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q8: revenue by product in the period (receipt date)."""
    tc = list(t.tenant_cols)
    rows = _receivable_period_rows(t, filters, as_of, {"codpro", "produto", "vlrrecbto"})
    agg = sum_by(rows, tc + ["codpro", "produto"], {"faturamento": "vlrrecbto"})
    return agg.select(
        *tc, F.col("codpro").cast("string").alias("codpro"), "produto",
        as_double(F.col("faturamento")).alias("faturamento"),
    ).orderBy(*tc, F.desc("faturamento"), "codpro", "produto")


@single_clock
def tabela_faturamento(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q9: receivable detail rows received in the period (no order, R3)."""
    tc = list(t.tenant_cols)
    cols = ["nrofatura", "anofatura", "datarecbto", "vlrrecbto", "filial", "cliente", "cidade", "coduf", "produto"]
    rows = _receivable_period_rows(t, filters, as_of, cols)
    return rows.select(
        *tc,
        F.col("nrofatura").cast("string").alias("nrofatura"),
        F.col("anofatura").cast("string").alias("anofatura"),
        F.col("datarecbto").cast("string").alias("datarecbto"),
        as_double(F.col("vlrrecbto")).alias("faturamento"),
        "filial", "cliente", "cidade", "coduf", "produto",
    )
