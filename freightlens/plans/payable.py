"""Payables reports Q18-Q21."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import PAYABLE_STATUS_OPEN, PAYABLE_STATUS_OVERDUE, as_double
from ..functions.calendar import as_of_date, current_month, single_clock
from ..operators.aggregates import conditional_totals, sum_by, two_roles
from ..operators.filters import NO_FILTERS, ReportFilters, apply_filters, in_period, needed_filter_columns, resolve_period
from ..sources.erp import OPEN_BALANCE, ErpTables
from .views import payables_view

FIELDS = {"codfornecedor": "codfornecedor", "codtransacao": "codtransacao"}


def _rows(t: ErpTables, filters: ReportFilters, as_of, need, prune=None) -> DataFrame:
    need = set(need) | needed_filter_columns(filters, FIELDS)
    return apply_filters(payables_view(t, as_of, need=need, prune=prune), filters, FIELDS)


@single_clock
def big_numbers_contas_pagar(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q18: paid in the period (movement date), open and due in the period,
    everything overdue (no period, K18) and their total; one scan."""
    tc = list(t.tenant_cols)
    p = resolve_period(filters, as_of)
    rows = _rows(
        t, filters, as_of, {"datamovto", "datavencto", "vlrpago", "vlrsaldo", "condicao_fatura"},
        prune={"datamovto": [(p.start, p.end)], OPEN_BALANCE: True},
    )
    status = F.col("condicao_fatura")
    paid = in_period("datamovto", p)
    open_due = (status == PAYABLE_STATUS_OPEN) & in_period("datavencto", p)
    overdue = status == PAYABLE_STATUS_OVERDUE
    rows = rows.filter(paid | open_due | overdue)
    spec = {
        "pago": (paid, "vlrpago", "sum"),
        "a_pagar": (open_due, "vlrsaldo", "sum"),
        "em_atraso": (overdue, "vlrsaldo", "sum"),
    }
    tot = conditional_totals(rows, spec, keys=tc)
    a_pagar, atraso = as_double(F.col("a_pagar")), as_double(F.col("em_atraso"))
    return tot.select(
        *tc,
        as_double(F.col("pago")).alias("pago"),
        a_pagar.alias("a_pagar"),
        atraso.alias("em_atraso"),
        (a_pagar + atraso).alias("a_pagar_total"),
    )


@single_clock
def contas_pagar_dia_mes_atual(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q19 (U8): by day of the current month, payments on their movement day
    and open balances on their due day; one scan."""
    tc = list(t.tenant_cols)
    first = as_of_date(as_of).replace(day=1)
    rows = _rows(
        t, filters, as_of,
        {"datamovto", "datavencto", "dia_movto", "dia_vencto", "vlrpago", "vlrsaldo", "condicao_fatura"},
        prune={"datamovto": [(first, first)], OPEN_BALANCE: True},
    )
    # Implied by the two roles but free of the computed status (pushable).
    rows = rows.filter(current_month("datamovto", as_of) | current_month("datavencto", as_of))
    zero = F.lit(0).cast("decimal(16,2)")
    roles = two_roles(
        rows,
        tc,
        (current_month("datamovto", as_of), {"dia": F.col("dia_movto"), "pago": F.col("vlrpago").cast("decimal(16,2)"), "a_pagar": zero}),
        (
            current_month("datavencto", as_of) & (F.col("condicao_fatura") == PAYABLE_STATUS_OPEN),
            {"dia": F.col("dia_vencto"), "pago": zero, "a_pagar": F.col("vlrsaldo").cast("decimal(16,2)")},
        ),
    )
    agg = sum_by(roles, tc + ["dia"], {"pago": "pago", "a_pagar": "a_pagar"})
    return agg.select(
        *tc, "dia",
        as_double(F.col("pago")).alias("pago"),
        as_double(F.col("a_pagar")).alias("a_pagar"),
    ).orderBy(*tc, "dia")


@single_clock
def a_pagar_fornecedor(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q20 (U9, P11): open balance due in the period plus every overdue
    balance, by supplier; disjoint arms -> one filter, one scan."""
    tc = list(t.tenant_cols)
    p = resolve_period(filters, as_of)
    # only open or overdue titles count: settled history is skipped when staged
    rows = _rows(
        t, filters, as_of, {"codfornecedor", "fornecedor", "vlrsaldo", "datavencto", "condicao_fatura"},
        prune={OPEN_BALANCE: True},
    )
    status = F.col("condicao_fatura")
    rows = rows.filter(((status == PAYABLE_STATUS_OPEN) & in_period("datavencto", p)) | (status == PAYABLE_STATUS_OVERDUE))
    agg = sum_by(rows, tc + ["codfornecedor", "fornecedor"], {"a_pagar": "vlrsaldo"})
    return agg.select(
        *tc, F.col("codfornecedor").cast("string").alias("codfornecedor"), "fornecedor",
        as_double(F.col("a_pagar")).alias("a_pagar"),
    ).orderBy(*tc, F.desc("a_pagar"), "codfornecedor", "fornecedor")


@single_clock
def tabela_a_pagar(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q21: balance by due date, supplier, transaction type and account for
    titles due in the period, whatever their status (K17); newest first."""
    tc = list(t.tenant_cols)
    p = resolve_period(filters, as_of)
    keys = ["datavencto", "fornecedor", "transacao", "conta"]
    rows = _rows(t, filters, as_of, set(keys) | {"vlrsaldo"}, prune={"datavencto": [(p.start, p.end)]})
    rows = rows.filter(in_period("datavencto", p))
    agg = sum_by(rows, tc + keys, {"a_pagar": "vlrsaldo"})
    return agg.select(
        *tc,
        F.col("datavencto").cast("string").alias("datavencto"),
        "fornecedor", "transacao",
        as_double(F.col("a_pagar")).alias("a_pagar"),
        "conta",
    ).orderBy(*tc, F.desc("datavencto"))
