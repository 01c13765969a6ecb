"""Receivables reports Q12-Q15."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import RECEIVABLE_STATUS_OPEN, RECEIVABLE_STATUS_OVERDUE, as_double
from ..functions.calendar import as_of_date, current_month, single_clock
from ..operators.aggregates import conditional_totals, sum_by, two_roles
from ..operators.filters import NO_FILTERS, ReportFilters, apply_filters, in_period, needed_filter_columns, resolve_period
from ..sources.erp import OPEN_BALANCE, ErpTables
from .views import receivables_view

FIELDS = {"codfilial": "codfilial", "codcliente": "codcliente"}


def _rows(t: ErpTables, filters: ReportFilters, as_of, need, prune=None) -> DataFrame:
    need = set(need) | needed_filter_columns(filters, FIELDS)
    return apply_filters(receivables_view(t, as_of, need=need, prune=prune), filters, FIELDS)


@single_clock
def big_numbers_contas_receber(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q12: received in the period (receipt date), open and due in the period,
    everything overdue (no period, K18), their total, and the mean days to
    receive.  One scan, conditional aggregates (P5); always one row."""
    tc = list(t.tenant_cols)
    p = resolve_period(filters, as_of)
    rows = _rows(
        t, filters, as_of,
        {"datarecbto", "datavencto", "vlrrecbto", "vlrsaldo", "condicao_fatura", "dias_recebimento"},
        prune={"datarecbto": [(p.start, p.end)], OPEN_BALANCE: True},
    )
    status = F.col("condicao_fatura")
    received = in_period("datarecbto", p)
    open_due = (status == RECEIVABLE_STATUS_OPEN) & in_period("datavencto", p)
    overdue = status == RECEIVABLE_STATUS_OVERDUE
    rows = rows.filter(received | open_due | overdue)
    spec = {
        "faturamento": (received, "vlrrecbto", "sum"),
        "a_receber": (open_due, "vlrsaldo", "sum"),
        "em_atraso": (overdue, "vlrsaldo", "sum"),
        "prazo_medio": (received & F.col("dias_recebimento").isNotNull(), "dias_recebimento", "avg"),
    }
    tot = conditional_totals(rows, spec, keys=tc)
    a_rec, atraso = as_double(F.col("a_receber")), as_double(F.col("em_atraso"))
    return tot.select(
        *tc,
        as_double(F.col("faturamento")).alias("faturamento"),
        a_rec.alias("a_receber"),
        atraso.alias("em_atraso"),
        (a_rec + atraso).alias("a_receber_total"),
        as_double(F.col("prazo_medio")).alias("prazo_medio"),
    )


@single_clock
def recebimentos_dia_mes_atual(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q13 (U6): by day of the current month, receipts on their receipt day
    and open balances on their due day; one scan, a row may feed both."""
    tc = list(t.tenant_cols)
    first = as_of_date(as_of).replace(day=1)
    rows = _rows(
        t, filters, as_of,
        {"datarecbto", "datavencto", "dia_recbto", "dia_vencto", "vlrrecbto", "vlrsaldo", "condicao_fatura"},
        prune={"datarecbto": [(first, first)], OPEN_BALANCE: True},
    )
    # Implied by the two roles but free of the computed status, so Parquet can
    # skip row groups on the two date ranges.
    rows = rows.filter(current_month("datarecbto", as_of) | current_month("datavencto", as_of))
    zero = F.lit(0).cast("decimal(15,2)")
    roles = two_roles(
        rows,
        tc,
        (current_month("datarecbto", as_of), {"dia": F.col("dia_recbto"), "faturamento": F.col("vlrrecbto"), "a_receber": zero}),
        (
            current_month("datavencto", as_of) & (F.col("condicao_fatura") == RECEIVABLE_STATUS_OPEN),
            {"dia": F.col("dia_vencto"), "faturamento": zero, "a_receber": F.col("vlrsaldo")},
        ),
    )
    agg = sum_by(roles, tc + ["dia"], {"faturamento": "faturamento", "a_receber": "a_receber"})
    return agg.select(
        *tc, "dia",
        as_double(F.col("faturamento")).alias("faturamento"),
        as_double(F.col("a_receber")).alias("a_receber"),
    ).orderBy(*tc, "dia")


@single_clock
def a_receber_cliente(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q14 (U7, P11): open balance due in the period plus every overdue
    balance, by customer.  The two arms are disjoint by status, so one
    filter over one scan replaces the UNION ALL."""
    tc = list(t.tenant_cols)
    p = resolve_period(filters, as_of)
    # only open or overdue titles count: settled history is skipped when staged
    rows = _rows(
        t, filters, as_of, {"codcliente", "cliente", "vlrsaldo", "datavencto", "condicao_fatura"},
        prune={OPEN_BALANCE: True},
    )
    status = F.col("condicao_fatura")
    rows = rows.filter(
        ((status == RECEIVABLE_STATUS_OPEN) & in_period("datavencto", p)) | (status == RECEIVABLE_STATUS_OVERDUE)
    )
    agg = sum_by(rows, tc + ["codcliente", "cliente"], {"a_receber": "vlrsaldo"})
    return agg.select(
        *tc, F.col("codcliente").cast("string").alias("codcliente"), "cliente",
        as_double(F.col("a_receber")).alias("a_receber"),
    ).orderBy(*tc, F.desc("a_receber"), "codcliente", "cliente")


@single_clock
def tabela_a_receber(t: ErpTables, filters: ReportFilters = NO_FILTERS, as_of=None) -> DataFrame:
    """Q15: balance by due date, customer, city, UF, product and account for
    titles due in the period, whatever their status (K17); newest first."""
    tc = list(t.tenant_cols)
    p = resolve_period(filters, as_of)
    keys = ["datavencto", "cliente", "cidade", "coduf", "produto", "conta"]
    rows = _rows(t, filters, as_of, set(keys) | {"vlrsaldo"}, prune={"datavencto": [(p.start, p.end)]})
    rows = rows.filter(in_period("datavencto", p))
    agg = sum_by(rows, tc + keys, {"a_receber": "vlrsaldo"})
    return agg.select(
        *tc,
        F.col("datavencto").cast("string").alias("datavencto"),
        "cliente", "cidade", "coduf", "produto",
        as_double(F.col("a_receber")).alias("a_receber"),
        "conta",
    ).orderBy(*tc, F.desc("datavencto"))
