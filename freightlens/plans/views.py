"""Semantic views V1-V4 as DataFrame functions.

Each view is fact -> LEFT lookups -> computed columns, like the SQL views, but
takes ``need``: the set of output columns the caller will use.  Lookups that
serve none of them are not joined at all (Catalyst keeps an unused LEFT join
under SUM, because a duplicate dimension key would fan out rows).  ``None``
means every column.

``prune`` carries the caller's date ranges as partition-pruning hints for
month-partitioned warehouses (``ErpTables.prune``); the caller still applies
the exact date filter.

Dimension sides go through ``ErpTables.lookup_side`` and ``large_side``.  In
the multi-tenant layout every join also matches on the tenant column.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    city_uf,
    days_between,
    flag,
    month_name_pt,
    paid_amount,
    payable_status,
    receivable_status,
    region_of,
    row_cost,
    tonnes,
)
from ..functions.calendar import as_of_lit
from ..sources.erp import ErpTables

CITY_VIEW_COLS = ["codcid", "cidade", "coduf", "cidade_uf", "regiao"]

RECEIVABLE_VIEW_COLS = [
    "nrofatura", "anofatura", "cliente", "codcliente", "filial", "codfilial", "codcid",
    "cidade", "coduf", "regiao", "codpro", "produto", "datavencto", "datarecbto",
    "mes_recbto", "mes_numero", "ano_recbto", "dia_recbto", "dia_vencto",
    "mes_numero_vencto", "ano_vencto", "dias_recebimento", "vlrrecbto", "vlrsaldo",
    "condicao_fatura", "contareduz", "conta",
]

FREIGHT_VIEW_COLS = [
    "nroctrc", "ufctrc", "dataemissao", "mes_emissao", "ano_emissao", "mes_numero",
    "dia_emissao", "situacao", "indctetpcte", "filial", "codfilial", "cliente",
    "codcliente", "codcid", "regiao", "cidade", "coduf", "codpro", "pesofrete_ton",
    "vlrpedagio", "vlrcusto", "embarque", "faturado",
]

PAYABLE_VIEW_COLS = [
    "nrocontrole", "anocontrole", "codfornecedor", "fornecedor", "codtransacao",
    "transacao", "vlrpago", "vlrsaldo", "datamovto", "datavencto", "dia_movto",
    "mes_numero_movto", "ano_movto", "dia_vencto", "mes_numero_vencto", "ano_vencto",
    "condicao_fatura", "contareduz", "conta",
]


def _wanted(need: Iterable[str] | None, cols: list[str]) -> list[str]:
    if need is None:
        return list(cols)
    need = set(need)
    return [c for c in cols if c in need]


def _uses(need: set[str] | None, *cols: str) -> bool:
    return need is None or any(c in need for c in cols)


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str,
    columns: dict[str, str],
    tenant_cols: tuple[str, ...] = (),
) -> DataFrame:
    """LEFT equi lookup fact -> dimension.

    ``columns`` maps dimension column -> output name.  Dimension columns are
    renamed before the join so that no name is ambiguous.
    """
    k = f"__k_{dim_key}"
    tcols = {t: f"__t_{t}" for t in tenant_cols}
    d = dim.select(
        F.col(dim_key).alias(k),
        *[F.col(t).alias(a) for t, a in tcols.items()],
        *[F.col(c).alias(o) for c, o in columns.items()],
    )
    cond = fact[fact_key] == d[k]
    for t, a in tcols.items():
        cond = cond & (fact[t] == d[a])
    return fact.join(d, cond, "left").drop(k, *tcols.values())


def _large_lookup(t: ErpTables, fact: DataFrame, fact_key: str, name: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """A lookup of a dimension that grows with the business."""
    side, more = t.large_side(name, fact)
    return lookup(fact, side, fact_key, dim_key, columns, t.tenant_cols + more)


def city_view(tbcid: DataFrame, tenant_cols: tuple[str, ...] = ()) -> DataFrame:
    """V1: city with ``cidade_uf`` and macro-region."""
    return tbcid.select(
        *tenant_cols,
        F.col("codcid"),
        F.col("nome").alias("cidade"),
        F.col("coduf"),
        city_uf(F.col("nome"), F.col("coduf")).alias("cidade_uf"),
        region_of(F.col("coduf")).alias("regiao"),
    )


def city_view_of(t: ErpTables) -> DataFrame:
    return city_view(t.table("tbcid"), t.tenant_cols)


def _city_side(t: ErpTables) -> DataFrame:
    side = t._sides.get("vwtbcid")
    if side is None:
        side = city_view(t.lookup_side("tbcid"), t.tenant_cols)
        t._sides["vwtbcid"] = side
    return side


def receivables_view(
    t: ErpTables, as_of: dt.datetime | dt.date | None, need: Iterable[str] | None = None, prune: dict | None = None
) -> DataFrame:
    """V2: receivables (invoices) with branch, customer, payment city (K1),
    product and account lookups, date parts, day count and status (K2)."""
    need = set(need) if need is not None else None
    tc = t.tenant_cols
    f = t.prune("factrc", t.table("factrc"), prune)
    if _uses(need, "filial"):
        f = lookup(f, t.lookup_side("tbfil"), "codfilfatur", "codfil", {"nome": "filial"}, tc)
    if _uses(need, "cliente"):
        f = _large_lookup(t, f, "cgccpffatura", "tbcli", "cgccpfcli", {"nomefantasia": "cliente"})
    if _uses(need, "cidade", "coduf", "regiao"):
        f = lookup(
            f, _city_side(t), "codcidpagto", "codcid",
            {"cidade": "cidade", "coduf": "coduf", "regiao": "regiao"}, tc,
        )
    if _uses(need, "produto"):
        f = lookup(f, t.lookup_side("tbpro"), "codpro", "codpro", {"nome": "produto"}, tc)
    if _uses(need, "conta"):
        f = lookup(f, t.lookup_side("tbcta"), "contareduz", "contareduz", {"nomeconta": "conta"}, tc)

    rec, due = F.col("datarecbto"), F.col("datavencto")
    # built only for the selected columns (each expression costs driver calls)
    exprs = {
        "cliente": lambda: F.col("cliente"),
        "codcliente": lambda: F.col("cgccpffatura"),
        "filial": lambda: F.col("filial"),
        "codfilial": lambda: F.col("codfilfatur"),
        "codcid": lambda: F.col("codciddes"),
        "mes_recbto": lambda: month_name_pt(F.month(rec)),
        "mes_numero": lambda: F.month(rec),
        "ano_recbto": lambda: F.year(rec),
        "dia_recbto": lambda: F.dayofmonth(rec),
        "dia_vencto": lambda: F.dayofmonth(due),
        "mes_numero_vencto": lambda: F.month(due),
        "ano_vencto": lambda: F.year(due),
        "dias_recebimento": lambda: days_between(rec, F.col("dataemissao")),
        "condicao_fatura": lambda: receivable_status(F.col("vlrsaldo"), due, as_of_lit(as_of)),
    }
    cols = _wanted(need, RECEIVABLE_VIEW_COLS)
    return f.select(*tc, *[exprs[c]().alias(c) if c in exprs else F.col(c) for c in cols])


def freight_view(t: ErpTables, need: Iterable[str] | None = None, prune: dict | None = None) -> DataFrame:
    """V3: freight documents in status N/F with branch, destination customer
    and destination city lookups, tonnes, NULL-propagating cost (K5), flags."""
    need = set(need) if need is not None else None
    tc = t.tenant_cols
    fact_need = None if need is None else ({"cgccpfdestina"} if _uses(need, "codcliente", "cliente") else set())
    f = t.prune("frctrc", t.table("frctrc", need=fact_need), prune).filter(F.col("situacao").isin("N", "F"))
    if _uses(need, "filial"):
        f = lookup(f, t.lookup_side("tbfil"), "codfilemite", "codfil", {"nome": "filial"}, tc)
    if _uses(need, "cliente"):
        f = _large_lookup(t, f, "cgccpfdestina", "tbcli", "cgccpfcli", {"nomefantasia": "cliente"})
    if _uses(need, "cidade", "coduf", "regiao"):
        f = lookup(
            f, _city_side(t), "codciddes", "codcid",
            {"cidade": "cidade", "coduf": "coduf", "regiao": "regiao"}, tc,
        )
    em = F.col("dataemissao")
    exprs = {
        "mes_emissao": lambda: month_name_pt(F.month(em)),
        "ano_emissao": lambda: F.year(em),
        "mes_numero": lambda: F.month(em),
        "dia_emissao": lambda: F.dayofmonth(em),
        "codfilial": lambda: F.col("codfilemite"),
        "codcliente": lambda: F.col("cgccpfdestina"),
        "codcid": lambda: F.col("codciddes"),
        "pesofrete_ton": lambda: tonnes(F.col("totalpeso")),
        "vlrcusto": lambda: row_cost(
            "vlrcarreto", "vlrseguromerca", "vlrpis", "vlriapas", "vlricmsst", "vlricms"
        ),
        "embarque": lambda: flag(F.col("indctetpcte") == 0),
        "faturado": lambda: flag(F.col("situacao") == "F"),
    }
    cols = _wanted(need, FREIGHT_VIEW_COLS)
    return f.select(*tc, *[exprs[c]().alias(c) if c in exprs else F.col(c) for c in cols])


def payables_view(
    t: ErpTables, as_of: dt.datetime | dt.date | None, need: Iterable[str] | None = None, prune: dict | None = None
) -> DataFrame:
    """V4: payable titles with supplier, transaction type and account lookups,
    paid amount, date parts and status (K3)."""
    need = set(need) if need is not None else None
    tc = t.tenant_cols
    f = t.prune("cptit", t.table("cptit"), prune)
    if _uses(need, "fornecedor"):
        f = _large_lookup(t, f, "cgccpfforne", "tbfor", "cgccpfforne", {"nomefantasia": "fornecedor"})
    if _uses(need, "transacao"):
        f = lookup(f, t.lookup_side("tbhis"), "codtransacao", "codtransacao", {"descricao": "transacao"}, tc)
    if _uses(need, "conta"):
        f = lookup(f, t.lookup_side("tbcta"), "contareduz", "contareduz", {"nomeconta": "conta"}, tc)
    mv, due = F.col("datamovto"), F.col("datavencto")
    exprs = {
        "codfornecedor": lambda: F.col("cgccpfforne"),
        "vlrpago": lambda: paid_amount(F.col("vlrtotal"), F.col("vlrsaldo")),
        "dia_movto": lambda: F.dayofmonth(mv),
        "mes_numero_movto": lambda: F.month(mv),
        "ano_movto": lambda: F.year(mv),
        "dia_vencto": lambda: F.dayofmonth(due),
        "mes_numero_vencto": lambda: F.month(due),
        "ano_vencto": lambda: F.year(due),
        "condicao_fatura": lambda: payable_status(F.col("vlrsaldo"), due, as_of_lit(as_of)),
    }
    cols = _wanted(need, PAYABLE_VIEW_COLS)
    return f.select(*tc, *[exprs[c]().alias(c) if c in exprs else F.col(c) for c in cols])


def as_output(df: DataFrame) -> DataFrame:
    """View rows for delivery: DECIMAL -> DOUBLE, everything else unchanged."""
    out = []
    for fld in df.schema.fields:
        if fld.dataType.typeName() == "decimal":
            out.append(F.col(fld.name).cast("double").alias(fld.name))
        else:
            out.append(F.col(fld.name))
    return df.select(*out)
