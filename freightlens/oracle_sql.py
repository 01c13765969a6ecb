"""Independent DuckDB SQL for every registered query (the correctness oracle).

Plain SQL over the driver's tables: the fixture mapping (FIXTURES.md) and
the semantic views as CTEs, then one statement per report.  Multi-KPI reports
are separate aggregates combined at the end, and two-role reports are UNION
ALLs, while the Spark side uses single scans with conditional aggregates, so
agreement is a real check.  Output columns are aliased and cast to the Spark
output types.
"""

from __future__ import annotations

import datetime as dt
from typing import Mapping

from .operators.filters import ReportFilters, active

# Two-letter state codes by nation key (0 to 24).
UF_BY_NATION = ["SP", "RJ", "MG", "ES", "PR", "SC", "RS", "MS", "MT", "GO", "DF", "RO", "AC",
                "AM", "RR", "PA", "TO", "AP", "MA", "PI", "CE", "RN", "PB", "PE", "EX"]


def _lpad14(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 14, '0')"


def _d2(x: str) -> str:
    return f"CAST({x} AS DECIMAL(15,2))"


def prelude(as_of: dt.datetime, multi_tenant: bool = False) -> str:
    """CTEs: fixture tables and the views, with ``as_of`` as CURRENT_TIMESTAMP."""
    now = f"TIMESTAMP '{as_of:%Y-%m-%d %H:%M:%S}'"
    # Portuguese month names, January to December.
    names = ("['Janeiro', 'Fevereiro', 'Março', 'Abril', 'Maio', 'Junho', 'Julho', 'Agosto', "
             "'Setembro', 'Outubro', 'Novembro', 'Dezembro']")

    def month_name(d: str) -> str:
        return f"{names}[month({d})]"

    i = lambda e: f"CAST({e} AS INTEGER)"
    # multi-tenant: dims repeated for tenants 0,1,2; facts carry branch % 3
    tdim = ", UNNEST([0, 1, 2]) AS codempresa" if multi_tenant else ""
    tjoin = ""

    def on(a: str, b: str) -> str:
        return f" AND {a}.codempresa = {b}.codempresa" if multi_tenant else ""

    tf_rec = ", CAST((o_orderkey % 25) % 3 AS INTEGER) AS codempresa" if multi_tenant else ""
    tf_frt = ", CAST((l_suppkey % 25) % 3 AS INTEGER) AS codempresa" if multi_tenant else ""
    tf_pay = ", CAST(l_suppkey % 3 AS INTEGER) AS codempresa" if multi_tenant else ""
    sel_r = "inv.codempresa, " if multi_tenant else ""
    sel_d = "doc.codempresa, " if multi_tenant else ""
    sel_p = "tit.codempresa, " if multi_tenant else ""
    return f"""
WITH
tbfil AS (SELECT CAST(n_nationkey AS INTEGER) AS codfil, n_name AS nome{tdim} FROM nation{tjoin}),
tbcli AS (SELECT {_lpad14('c_custkey')} AS cgccpfcli, c_name AS nomefantasia{tdim} FROM customer{tjoin}),
tbcid AS (SELECT CAST(s_suppkey AS INTEGER) AS codcid, s_name AS nome,
                 list_extract({UF_BY_NATION}, CAST(s_nationkey AS INTEGER) + 1) AS coduf{tdim} FROM supplier{tjoin}),
tbpro AS (SELECT CAST(p_partkey AS INTEGER) AS codpro, p_name AS nome{tdim} FROM part{tjoin}),
tbcta AS (SELECT CAST(r_regionkey AS INTEGER) AS contareduz, r_name AS nomeconta{tdim} FROM region{tjoin}),
tbfor AS (SELECT {_lpad14('s_suppkey')} AS cgccpfforne, s_name AS nomefantasia{tdim} FROM supplier{tjoin}),
tbhis0 AS (SELECT DISTINCT CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS codtransacao,
                  substring(o_orderpriority, 3) AS descricao FROM orders),
tbhis AS (SELECT tbhis0.*{tdim} FROM tbhis0{tjoin}),
factrc AS (
  SELECT o_orderkey AS nrofatura,
         {i('year(CAST(o_orderdate AS DATE))')} AS anofatura,
         {_lpad14('o_custkey')} AS cgccpffatura,
         CAST(o_orderkey % 25 AS INTEGER) AS codfilfatur,
         CAST(o_custkey % 120 AS INTEGER) AS codciddes,
         CAST(o_orderkey % 120 AS INTEGER) AS codcidpagto,
         CAST(o_orderkey % 2100 AS INTEGER) AS codpro,
         CAST(o_orderdate AS DATE) AS dataemissao,
         CAST(o_orderdate AS DATE) + 30 AS datavencto,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS datarecbto,
         CAST(CASE o_orderstatus WHEN 'F' THEN {_d2('o_totalprice')}
                                 WHEN 'P' THEN {_d2('o_totalprice')} - 1000
                                 WHEN 'O' THEN 0 END AS DECIMAL(15,2)) AS vlrrecbto,
         CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1000
                                 WHEN 'O' THEN {_d2('o_totalprice')} END AS DECIMAL(15,2)) AS vlrsaldo,
         CAST(o_orderkey % 6 AS INTEGER) AS contareduz{tf_rec}
  FROM orders),
frctrc AS (
  SELECT l_orderkey * 10 + l_linenumber AS nroctrc, 'SP' AS ufctrc,
         CAST(l_shipdate AS DATE) AS dataemissao,
         CASE l_returnflag WHEN 'N' THEN 'N' WHEN 'R' THEN 'F' ELSE 'C' END AS situacao,
         CAST(l_linenumber - 1 AS INTEGER) AS indctetpcte,
         CAST(l_suppkey % 25 AS INTEGER) AS codfilemite,
         {_lpad14('o_custkey')} AS cgccpfdestina,
         CAST(l_suppkey AS INTEGER) AS codciddes,
         CAST(l_partkey AS INTEGER) AS codpro,
         CAST(CAST(l_quantity AS DECIMAL(15,3)) * 100 AS DECIMAL(15,3)) AS totalpeso,
         {_d2('l_quantity')} AS vlrpedagio,
         {_d2('l_extendedprice')} AS vlrcarreto,
         {_d2('l_quantity')} AS vlrseguromerca,
         CAST(1.65 AS DECIMAL(15,2)) AS vlrpis,
         CAST(0 AS DECIMAL(15,2)) AS vlriapas,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(0 AS DECIMAL(15,2)) END AS vlricmsst,
         CAST({_d2('l_tax')} * 100 AS DECIMAL(15,2)) AS vlricms{tf_frt}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cptit AS (
  SELECT l_orderkey * 10 + l_linenumber AS nrocontrole,
         {i('year(CAST(l_shipdate AS DATE))')} AS anocontrole,
         {_lpad14('l_suppkey')} AS cgccpfforne,
         CAST(l_linenumber AS INTEGER) AS codtransacao,
         {_d2('l_extendedprice')} AS vlrtotal,
         CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 100
                                WHEN 'N' THEN {_d2('l_extendedprice')} END AS DECIMAL(15,2)) AS vlrsaldo,
         CAST(l_shipdate AS DATE) AS datamovto,
         CAST(l_shipdate AS DATE) + 30 AS datavencto,
         CAST(l_partkey % 6 AS INTEGER) AS contareduz{tf_pay}
  FROM lineitem),
vwtbcid_bi AS (
  SELECT {"codempresa, " if multi_tenant else ""}codcid, nome AS cidade, coduf, nome || '-' || coduf AS cidade_uf,
         CASE WHEN coduf IN ('SP','RJ','MG','ES') THEN 'Sudeste'
              WHEN coduf IN ('PR','SC','RS') THEN 'Sul'
              WHEN coduf IN ('MS','MT','GO','DF') THEN 'Centro-Oeste'
              WHEN coduf IN ('RO','AC','AM','RR','PA','TO','AP') THEN 'Norte'
              WHEN coduf IN ('MA','PI','CE','RN','PB','PE','AL','SE','BA') THEN 'Nordeste'
              ELSE 'Outros' END AS regiao
  FROM tbcid),
vwfactrc_bi AS (
  SELECT {sel_r}inv.nrofatura, inv.anofatura, cust.nomefantasia AS cliente, inv.cgccpffatura AS codcliente,
         br.nome AS filial, inv.codfilfatur AS codfilial, inv.codciddes AS codcid,
         pay.cidade, pay.coduf, pay.regiao, inv.codpro, prod.nome AS produto,
         inv.datavencto, inv.datarecbto,
         {month_name('inv.datarecbto')} AS mes_recbto,
         {i('month(inv.datarecbto)')} AS mes_numero,
         {i('year(inv.datarecbto)')} AS ano_recbto,
         {i('day(inv.datarecbto)')} AS dia_recbto,
         {i('day(inv.datavencto)')} AS dia_vencto,
         {i('month(inv.datavencto)')} AS mes_numero_vencto,
         {i('year(inv.datavencto)')} AS ano_vencto,
         {i('date_diff(\'day\', inv.dataemissao, inv.datarecbto)')} AS dias_recebimento,
         inv.vlrrecbto, inv.vlrsaldo,
         CASE WHEN inv.vlrsaldo > 0 AND {now} > CAST(inv.datavencto AS TIMESTAMP) THEN 'Em Atraso'
              WHEN inv.vlrsaldo = 0 THEN 'Recebida'
              ELSE 'A Receber' END AS condicao_fatura,
         inv.contareduz, acc.nomeconta AS conta
  FROM factrc inv
  LEFT JOIN tbcta acc ON inv.contareduz = acc.contareduz{on('acc', 'inv')}
  LEFT JOIN tbpro prod ON inv.codpro = prod.codpro{on('prod', 'inv')}
  LEFT JOIN vwtbcid_bi pay ON inv.codcidpagto = pay.codcid{on('pay', 'inv')}
  LEFT JOIN tbcli cust ON inv.cgccpffatura = cust.cgccpfcli{on('cust', 'inv')}
  LEFT JOIN tbfil br ON inv.codfilfatur = br.codfil{on('br', 'inv')}),
vwfrctrc_bi AS (
  SELECT {sel_d}doc.nroctrc, doc.ufctrc, doc.dataemissao,
         {month_name('doc.dataemissao')} AS mes_emissao,
         {i('year(doc.dataemissao)')} AS ano_emissao,
         {i('month(doc.dataemissao)')} AS mes_numero,
         {i('day(doc.dataemissao)')} AS dia_emissao,
         doc.situacao, doc.indctetpcte, br.nome AS filial, doc.codfilemite AS codfilial,
         cust.nomefantasia AS cliente, doc.cgccpfdestina AS codcliente, doc.codciddes AS codcid,
         dest.regiao, dest.cidade, dest.coduf, doc.codpro,
         doc.totalpeso * 0.001 AS pesofrete_ton,
         doc.vlrpedagio,
         doc.vlricms + doc.vlricmsst + doc.vlriapas + doc.vlrpis + doc.vlrseguromerca + doc.vlrcarreto AS vlrcusto,
         CAST(COALESCE(doc.indctetpcte = 0, false) AS INTEGER) AS embarque,
         CAST(COALESCE(doc.situacao = 'F', false) AS INTEGER) AS faturado
  FROM frctrc doc
  LEFT JOIN vwtbcid_bi dest ON doc.codciddes = dest.codcid{on('dest', 'doc')}
  LEFT JOIN tbcli cust ON doc.cgccpfdestina = cust.cgccpfcli{on('cust', 'doc')}
  LEFT JOIN tbfil br ON doc.codfilemite = br.codfil{on('br', 'doc')}
  WHERE doc.situacao = 'N' OR doc.situacao = 'F'),
vwcptit_bi AS (
  SELECT {sel_p}tit.nrocontrole, tit.anocontrole, tit.cgccpfforne AS codfornecedor, sup.nomefantasia AS fornecedor,
         tit.codtransacao, kind.descricao AS transacao,
         tit.vlrtotal - tit.vlrsaldo AS vlrpago, tit.vlrsaldo, tit.datamovto, tit.datavencto,
         {i('day(tit.datamovto)')} AS dia_movto,
         {i('month(tit.datamovto)')} AS mes_numero_movto,
         {i('year(tit.datamovto)')} AS ano_movto,
         {i('day(tit.datavencto)')} AS dia_vencto,
         {i('month(tit.datavencto)')} AS mes_numero_vencto,
         {i('year(tit.datavencto)')} AS ano_vencto,
         CASE WHEN tit.vlrsaldo = 0 THEN 'Pago'
              WHEN tit.vlrsaldo > 0 AND CAST(tit.datavencto AS TIMESTAMP) >= {now} THEN 'A Pagar'
              ELSE 'Em Atraso' END AS condicao_fatura,
         tit.contareduz, acc.nomeconta AS conta
  FROM cptit tit
  LEFT JOIN tbcta acc ON tit.contareduz = acc.contareduz{on('acc', 'tit')}
  LEFT JOIN tbhis kind ON tit.codtransacao = kind.codtransacao{on('kind', 'tit')}
  LEFT JOIN tbfor sup ON tit.cgccpfforne = sup.cgccpfforne{on('sup', 'tit')})
"""


# ------------------------------------------------------------------ helpers
def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(int(v))


def where_filters(filters: ReportFilters, fields: Mapping[str, str]) -> str:
    """`` AND col IN (...)`` for every active filter among ``fields``."""
    out = ""
    for name, col in fields.items():
        vals = active(getattr(filters, name))
        if vals is not None:
            out += f" AND {col} IN ({', '.join(_lit(v) for v in vals)})"
    return out


def _period(filters: ReportFilters, as_of: dt.datetime) -> tuple[str, str]:
    end = filters.data_fim or as_of.date()
    start = filters.data_inicio or (end - dt.timedelta(days=30))
    return f"DATE '{start}'", f"DATE '{end}'"


def _prior(filters: ReportFilters, as_of: dt.datetime) -> tuple[str, str]:
    end = (filters.data_fim - dt.timedelta(days=365)) if filters.data_fim else (as_of.date() - dt.timedelta(days=365))
    start = (filters.data_inicio - dt.timedelta(days=365)) if filters.data_inicio else (end - dt.timedelta(days=30))
    return f"DATE '{start}'", f"DATE '{end}'"


DBL = "CAST(COALESCE({}, 0) AS DOUBLE)"


def _dbl(e: str) -> str:
    return DBL.format(e)


def _cnt(e: str) -> str:
    return f"CAST(COALESCE({e}, 0) AS BIGINT)"


# ------------------------------------------------------------------ views
def vw_tbcid() -> str:
    return "SELECT codcid, cidade, coduf, cidade_uf, regiao FROM vwtbcid_bi"


def vw_factrc() -> str:
    return """SELECT nrofatura, anofatura, cliente, codcliente, filial, codfilial, codcid, cidade, coduf, regiao,
       codpro, produto, datavencto, datarecbto, mes_recbto, mes_numero, ano_recbto, dia_recbto, dia_vencto,
       mes_numero_vencto, ano_vencto, dias_recebimento, CAST(vlrrecbto AS DOUBLE) AS vlrrecbto,
       CAST(vlrsaldo AS DOUBLE) AS vlrsaldo, condicao_fatura, contareduz, conta FROM vwfactrc_bi"""


def vw_frctrc() -> str:
    return """SELECT nroctrc, ufctrc, dataemissao, mes_emissao, ano_emissao, mes_numero, dia_emissao, situacao,
       indctetpcte, filial, codfilial, cliente, codcliente, codcid, regiao, cidade, coduf, codpro,
       CAST(pesofrete_ton AS DOUBLE) AS pesofrete_ton, CAST(vlrpedagio AS DOUBLE) AS vlrpedagio,
       CAST(vlrcusto AS DOUBLE) AS vlrcusto, embarque, faturado FROM vwfrctrc_bi"""


def vw_cptit() -> str:
    return """SELECT nrocontrole, anocontrole, codfornecedor, fornecedor, codtransacao, transacao,
       CAST(vlrpago AS DOUBLE) AS vlrpago, CAST(vlrsaldo AS DOUBLE) AS vlrsaldo, datamovto, datavencto,
       dia_movto, mes_numero_movto, ano_movto, dia_vencto, mes_numero_vencto, ano_vencto, condicao_fatura,
       contareduz, conta FROM vwcptit_bi"""


# ------------------------------------------------------------------ reports
def big_numbers(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    pa, pb = _prior(f, as_of)
    fr = where_filters(f, {"codfilial": "codfilial", "codcliente": "codcliente", "codcid": "codcid",
                           "regiao": "regiao", "codpro": "codpro", "ano": "ano_recbto",
                           "mes": "mes_numero", "dia": "dia_recbto"})
    ff = where_filters(f, {"codfilial": "codfilial", "codcliente": "codcliente", "codcid": "codcid",
                           "regiao": "regiao", "codpro": "codpro", "ano": "ano_emissao",
                           "mes": "mes_numero", "dia": "dia_emissao"})

    def rec(x, y):
        return f"SELECT CAST(SUM(vlrrecbto) AS DOUBLE) AS fat FROM vwfactrc_bi WHERE datarecbto >= {x} AND datarecbto <= {y}{fr}"

    def frt(x, y):
        return (f"SELECT CAST(SUM(vlrcusto) AS DOUBLE) AS cus, CAST(SUM(vlrpedagio) AS DOUBLE) AS ped, "
                f"CAST(SUM(pesofrete_ton) AS DOUBLE) AS vol, CAST(SUM(embarque) AS BIGINT) AS emb, "
                f"CAST(SUM(faturado) AS BIGINT) AS ftd FROM vwfrctrc_bi "
                f"WHERE dataemissao >= {x} AND dataemissao <= {y}{ff}")

    pct = lambda c, p: f"CASE WHEN {p} <> 0 THEN ((CAST({c} AS DOUBLE) / CAST({p} AS DOUBLE)) - 1) * 100 ELSE 0.0 END"
    return f""",
r AS ({rec(a, b)}), rp AS ({rec(pa, pb)}), q AS ({frt(a, b)}), qp AS ({frt(pa, pb)}),
v AS (
  SELECT COALESCE((SELECT fat FROM r), 0.0) AS fat, COALESCE((SELECT fat FROM rp), 0.0) AS fat_p,
         COALESCE((SELECT cus FROM q), 0.0) AS cus, COALESCE((SELECT cus FROM qp), 0.0) AS cus_p,
         COALESCE((SELECT ped FROM q), 0.0) AS ped, COALESCE((SELECT ped FROM qp), 0.0) AS ped_p,
         COALESCE((SELECT vol FROM q), 0.0) AS vol, COALESCE((SELECT vol FROM qp), 0.0) AS vol_p,
         COALESCE((SELECT emb FROM q), 0) AS emb, COALESCE((SELECT emb FROM qp), 0) AS emb_p,
         COALESCE((SELECT ftd FROM q), 0) AS ftd, COALESCE((SELECT ftd FROM qp), 0) AS ftd_p)
SELECT fat AS faturamento, {pct('fat', 'fat_p')} AS faturamento_ano_anterior,
       vol AS volumes, {pct('vol', 'vol_p')} AS volumes_ano_anterior,
       emb AS embarques, {pct('emb', 'emb_p')} AS embarques_ano_anterior,
       CASE WHEN ftd <> 0 THEN fat / CAST(ftd AS DOUBLE) ELSE 0.0 END AS ticket_medio,
       CASE WHEN ftd <> 0 AND ftd_p <> 0 AND fat_p <> 0
            THEN (((fat / CAST(ftd AS DOUBLE)) / (fat_p / CAST(ftd_p AS DOUBLE))) - 1) * 100 ELSE 0.0 END
         AS ticket_medio_ano_anterior,
       cus AS custos, {pct('cus', 'cus_p')} AS custos_ano_anterior,
       ped AS pedagios, {pct('ped', 'ped_p')} AS pedagios_ano_anterior,
       CASE WHEN fat <> 0 THEN ((fat - cus) / fat) * 100 ELSE 0.0 END AS margem,
       CASE WHEN fat <> 0 AND fat_p <> 0 AND (fat_p - cus_p) / fat_p <> 0
            THEN ((((fat - cus) / fat) / ((fat_p - cus_p) / fat_p)) - 1) * 100 ELSE 0.0 END
         AS margem_ano_anterior
FROM v"""


def _ops_cte(tenant: bool = False) -> str:
    """Conformed operations: one row per invoice (revenue) and per freight
    document (tonnes, shipments)."""
    t = "codempresa, " if tenant else ""
    return f""",
ops AS (
  SELECT {t}codfilial, filial, codcliente, codcid, cidade, coduf, regiao, codpro,
         datarecbto AS d_op, dia_recbto AS d_dia, mes_numero AS d_mes, mes_recbto AS d_mes_nome,
         ano_recbto AS d_ano, CAST(0 AS DECIMAL(18, 6)) AS vol, 0 AS emb, vlrrecbto AS fat
  FROM vwfactrc_bi
  UNION ALL
  SELECT {t}codfilial, filial, codcliente, codcid, cidade, coduf, regiao, codpro,
         dataemissao, dia_emissao, mes_numero, mes_emissao, ano_emissao, pesofrete_ton, embarque,
         CAST(0 AS DECIMAL(15, 2))
  FROM vwfrctrc_bi)"""


def _ops_measures() -> str:
    return (f"{_dbl('SUM(vol)')} AS volume, {_cnt('SUM(emb)')} AS embarques, "
            f"{_dbl('SUM(fat)')} AS faturamento")


_OPS_FULL = {"codfilial": "codfilial", "codcliente": "codcliente", "codcid": "codcid", "regiao": "regiao",
             "codpro": "codpro", "ano": "d_ano", "mes": "d_mes", "dia": "d_dia"}
_OPS_NOCLI = {"codfilial": "codfilial", "codcid": "codcid", "regiao": "regiao",
              "ano": "d_ano", "mes": "d_mes", "dia": "d_dia"}


def kpi_mes_ano(f: ReportFilters, as_of: dt.datetime, tenant: bool = False) -> str:
    w = where_filters(f, _OPS_NOCLI)
    return _ops_cte() + f"""
SELECT d_ano AS ano, d_mes AS mes_numero, d_mes_nome AS mes, {_ops_measures()}
FROM ops WHERE d_ano >= {as_of.year - 2}{w}
GROUP BY d_ano, d_mes_nome, d_mes"""


def kpi_dia_mes_atual(f: ReportFilters, as_of: dt.datetime) -> str:
    w = where_filters(f, _OPS_NOCLI)
    return _ops_cte() + f"""
SELECT d_dia AS dia, {_ops_measures()}
FROM ops WHERE d_ano = {as_of.year} AND d_mes = {as_of.month}{w}
GROUP BY d_dia"""


def _in_period_ops(f: ReportFilters, as_of: dt.datetime, fields) -> str:
    a, b = _period(f, as_of)
    return f"d_op BETWEEN {a} AND {b}{where_filters(f, fields)}"


def kpi_filial(f: ReportFilters, as_of: dt.datetime, tenant: bool = False) -> str:
    t = "codempresa, " if tenant else ""
    return _ops_cte(tenant) + f"""
SELECT {t}CAST(codfilial AS VARCHAR) AS codfilial, filial, {_ops_measures()}
FROM ops WHERE {_in_period_ops(f, as_of, _OPS_FULL)}
GROUP BY {t}codfilial, filial"""


def kpi_regiao(f: ReportFilters, as_of: dt.datetime) -> str:
    return _ops_cte() + f"""
SELECT regiao, {_ops_measures()} FROM ops WHERE {_in_period_ops(f, as_of, _OPS_FULL)} GROUP BY regiao"""


def _kpi_cidade_body(f: ReportFilters, as_of: dt.datetime) -> str:
    return f"""
SELECT CAST(codcid AS VARCHAR) AS codcid, cidade || '-' || coduf AS cidade, {_ops_measures()}
FROM ops WHERE {_in_period_ops(f, as_of, _OPS_NOCLI)}
GROUP BY codcid, cidade || '-' || coduf"""


def kpi_cidade(f: ReportFilters, as_of: dt.datetime) -> str:
    return _ops_cte() + _kpi_cidade_body(f, as_of)


def kpi_cidade_last_wins(f: ReportFilters, as_of: dt.datetime) -> str:
    """One row per city code: the group the reference's dict keeps (rows
    sorted by revenue DESC, later ones overwrite -> smallest revenue, then
    smallest label)."""
    return _ops_cte() + f""",
g AS ({_kpi_cidade_body(f, as_of)})
SELECT codcid, cidade, volume, embarques, faturamento FROM (
  SELECT *, row_number() OVER (PARTITION BY codcid ORDER BY faturamento ASC NULLS FIRST, cidade ASC NULLS FIRST) AS rn
  FROM g) WHERE rn = 1"""


_RECLIST = {"codfilial": "codfilial", "codcliente": "codcliente", "regiao": "regiao", "codpro": "codpro"}


def kpi_cliente(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _RECLIST)
    return f"""
SELECT CAST(codcliente AS VARCHAR) AS codcliente, cliente, {_dbl('SUM(vlrrecbto)')} AS faturamento
FROM vwfactrc_bi WHERE datarecbto >= {a} AND datarecbto <= {b}{w} GROUP BY codcliente, cliente"""


def kpi_produto(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _RECLIST)
    return f"""
SELECT CAST(codpro AS VARCHAR) AS codpro, produto, {_dbl('SUM(vlrrecbto)')} AS faturamento
FROM vwfactrc_bi WHERE datarecbto >= {a} AND datarecbto <= {b}{w} GROUP BY codpro, produto"""


def tabela_faturamento(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _RECLIST)
    return f"""
SELECT CAST(nrofatura AS VARCHAR) AS nrofatura, CAST(anofatura AS VARCHAR) AS anofatura,
       CAST(datarecbto AS VARCHAR) AS datarecbto, {_dbl('vlrrecbto')} AS faturamento,
       filial, cliente, cidade, coduf, produto
FROM vwfactrc_bi WHERE datarecbto >= {a} AND datarecbto <= {b}{w}"""


def filtro_filial() -> str:
    return "SELECT CAST(codfil AS VARCHAR) AS codfilial, nome AS filial FROM tbfil"


def filtro_cliente() -> str:
    return "SELECT cgccpfcli AS codcliente, nomefantasia AS cliente FROM tbcli"


def filtro_fornecedor() -> str:
    return "SELECT cgccpfforne AS codfornecedor, nomefantasia AS fornecedor FROM tbfor"


def filtro_transacao() -> str:
    return "SELECT CAST(codtransacao AS VARCHAR) AS codtransacao, descricao AS transacao FROM tbhis"


_REC = {"codfilial": "codfilial", "codcliente": "codcliente"}
_PAY = {"codfornecedor": "codfornecedor", "codtransacao": "codtransacao"}


def big_numbers_contas_receber(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _REC)
    return f""",
q1 AS (SELECT COALESCE(SUM(vlrrecbto), 0) AS faturamento FROM vwfactrc_bi
       WHERE datarecbto >= {a} AND datarecbto <= {b}{w}),
q2 AS (SELECT COALESCE(SUM(vlrsaldo), 0) AS a_receber FROM vwfactrc_bi
       WHERE condicao_fatura = 'A Receber' AND datavencto >= {a} AND datavencto <= {b}{w}),
q3 AS (SELECT COALESCE(SUM(vlrsaldo), 0) AS em_atraso FROM vwfactrc_bi WHERE condicao_fatura = 'Em Atraso'{w}),
q4 AS (SELECT COALESCE(AVG(dias_recebimento), 0) AS prazo_medio FROM vwfactrc_bi
       WHERE datarecbto >= {a} AND datarecbto <= {b} AND dias_recebimento IS NOT NULL{w})
SELECT CAST((SELECT faturamento FROM q1) AS DOUBLE) AS faturamento,
       CAST((SELECT a_receber FROM q2) AS DOUBLE) AS a_receber,
       CAST((SELECT em_atraso FROM q3) AS DOUBLE) AS em_atraso,
       CAST((SELECT a_receber FROM q2) AS DOUBLE) + CAST((SELECT em_atraso FROM q3) AS DOUBLE) AS a_receber_total,
       CAST((SELECT prazo_medio FROM q4) AS DOUBLE) AS prazo_medio"""


def recebimentos_dia_mes_atual(f: ReportFilters, as_of: dt.datetime) -> str:
    w = where_filters(f, _REC)
    y, m = as_of.year, as_of.month
    return f""",
got AS (SELECT dia_recbto AS dia, vlrrecbto AS amount FROM vwfactrc_bi
        WHERE ano_recbto = {y} AND mes_numero = {m}{w}),
due AS (SELECT dia_vencto AS dia, vlrsaldo AS amount FROM vwfactrc_bi
        WHERE condicao_fatura = 'A Receber' AND ano_vencto = {y} AND mes_numero_vencto = {m}{w}),
both_roles AS (SELECT dia, amount AS f, NULL AS r FROM got UNION ALL SELECT dia, NULL, amount FROM due)
SELECT dia, {_dbl('SUM(f)')} AS faturamento, {_dbl('SUM(r)')} AS a_receber FROM both_roles GROUP BY dia"""


def a_receber_cliente(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _REC)
    return f""",
open_due AS (SELECT codcliente, cliente, vlrsaldo FROM vwfactrc_bi
             WHERE condicao_fatura = 'A Receber' AND datavencto BETWEEN {a} AND {b}{w}),
late AS (SELECT codcliente, cliente, vlrsaldo FROM vwfactrc_bi WHERE condicao_fatura = 'Em Atraso'{w})
SELECT CAST(codcliente AS VARCHAR) AS codcliente, cliente, {_dbl('SUM(vlrsaldo)')} AS a_receber
FROM (SELECT * FROM open_due UNION ALL SELECT * FROM late) x GROUP BY codcliente, cliente"""


def tabela_a_receber(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _REC)
    return f"""
SELECT CAST(datavencto AS VARCHAR) AS datavencto, cliente, cidade, coduf, produto,
       {_dbl('SUM(vlrsaldo)')} AS a_receber, conta
FROM vwfactrc_bi WHERE datavencto >= {a} AND datavencto <= {b}{w}
GROUP BY datavencto, cliente, cidade, coduf, produto, conta"""


def big_numbers_contas_pagar(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _PAY)
    return f""",
q1 AS (SELECT COALESCE(SUM(vlrpago), 0) AS pago FROM vwcptit_bi WHERE datamovto >= {a} AND datamovto <= {b}{w}),
q2 AS (SELECT COALESCE(SUM(vlrsaldo), 0) AS a_pagar FROM vwcptit_bi
       WHERE condicao_fatura = 'A Pagar' AND datavencto >= {a} AND datavencto <= {b}{w}),
q3 AS (SELECT COALESCE(SUM(vlrsaldo), 0) AS em_atraso FROM vwcptit_bi WHERE condicao_fatura = 'Em Atraso'{w})
SELECT CAST((SELECT pago FROM q1) AS DOUBLE) AS pago, CAST((SELECT a_pagar FROM q2) AS DOUBLE) AS a_pagar,
       CAST((SELECT em_atraso FROM q3) AS DOUBLE) AS em_atraso,
       CAST((SELECT a_pagar FROM q2) AS DOUBLE) + CAST((SELECT em_atraso FROM q3) AS DOUBLE) AS a_pagar_total"""


def contas_pagar_dia_mes_atual(f: ReportFilters, as_of: dt.datetime) -> str:
    w = where_filters(f, _PAY)
    y, m = as_of.year, as_of.month
    return f""",
paid AS (SELECT dia_movto AS dia, vlrpago AS amount FROM vwcptit_bi
         WHERE ano_movto = {y} AND mes_numero_movto = {m}{w}),
due AS (SELECT dia_vencto AS dia, vlrsaldo AS amount FROM vwcptit_bi
        WHERE condicao_fatura = 'A Pagar' AND ano_vencto = {y} AND mes_numero_vencto = {m}{w}),
both_roles AS (SELECT dia, amount AS p, NULL AS o FROM paid UNION ALL SELECT dia, NULL, amount FROM due)
SELECT dia, {_dbl('SUM(p)')} AS pago, {_dbl('SUM(o)')} AS a_pagar FROM both_roles GROUP BY dia"""


def a_pagar_fornecedor(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _PAY)
    return f""",
open_due AS (SELECT codfornecedor, fornecedor, vlrsaldo FROM vwcptit_bi
             WHERE condicao_fatura = 'A Pagar' AND datavencto BETWEEN {a} AND {b}{w}),
late AS (SELECT codfornecedor, fornecedor, vlrsaldo FROM vwcptit_bi WHERE condicao_fatura = 'Em Atraso'{w})
SELECT CAST(codfornecedor AS VARCHAR) AS codfornecedor, fornecedor, {_dbl('SUM(vlrsaldo)')} AS a_pagar
FROM (SELECT * FROM open_due UNION ALL SELECT * FROM late) x GROUP BY codfornecedor, fornecedor"""


def tabela_a_pagar(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _PAY)
    return f"""
SELECT CAST(datavencto AS VARCHAR) AS datavencto, fornecedor, transacao, {_dbl('SUM(vlrsaldo)')} AS a_pagar, conta
FROM vwcptit_bi WHERE datavencto >= {a} AND datavencto <= {b}{w}
GROUP BY datavencto, fornecedor, transacao, conta"""


REPORT_SQL = {
    "big_numbers": big_numbers,
    "kpi_mes_ano": kpi_mes_ano,
    "kpi_dia_mes_atual": kpi_dia_mes_atual,
    "kpi_filial": kpi_filial,
    "kpi_regiao": kpi_regiao,
    "kpi_cidade": kpi_cidade,
    "kpi_cliente": kpi_cliente,
    "kpi_produto": kpi_produto,
    "tabela_faturamento": tabela_faturamento,
    "big_numbers_contas_receber": big_numbers_contas_receber,
    "recebimentos_dia_mes_atual": recebimentos_dia_mes_atual,
    "a_receber_cliente": a_receber_cliente,
    "tabela_a_receber": tabela_a_receber,
    "big_numbers_contas_pagar": big_numbers_contas_pagar,
    "contas_pagar_dia_mes_atual": contas_pagar_dia_mes_atual,
    "a_pagar_fornecedor": a_pagar_fornecedor,
    "tabela_a_pagar": tabela_a_pagar,
}

LIST_SQL = {
    "filtro_filial": filtro_filial,
    "filtro_cliente": filtro_cliente,
    "filtro_fornecedor": filtro_fornecedor,
    "filtro_transacao": filtro_transacao,
}

VIEW_SQL = {"vw_tbcid": vw_tbcid, "vw_factrc": vw_factrc, "vw_frctrc": vw_frctrc, "vw_cptit": vw_cptit}


def full_sql(body: str, as_of: dt.datetime, multi_tenant: bool = False) -> str:
    """Prelude + body.  A body starting with ',' adds more CTEs."""
    pre = prelude(as_of, multi_tenant)
    body = body.strip()
    if body.startswith(","):
        return pre + body
    return pre + body


# ------------------------------------------------------------ control tables
_BS = chr(92)


def control_prelude() -> str:
    path = f"'C:{_BS * 2}dados{_BS * 2}' || n_name || '.FDB'"
    return f"""
WITH
tbusuarios AS (
  SELECT CAST(c_custkey AS INTEGER) AS codusuario, c_name AS nomeusuario, 'x' AS senhausuario,
         CAST(c_nationkey AS INTEGER) AS codempresa,
         CASE WHEN c_acctbal < 0 THEN 'N' ELSE 'S' END AS usuarioativo,
         CASE WHEN c_custkey % 2 = 0 THEN r
              ELSE substr(r, 1, 3) || '.' || substr(r, 4, 3) || '.' || substr(r, 7, 3) || '-' || substr(r, 10, 2)
         END AS cpfusuario,
         lower(replace(c_name, '#', '')) || '@example.com' AS emailusuario,
         c_mktsegment
  FROM (SELECT *, lpad(CAST(c_custkey * 7919 + 123456 AS VARCHAR), 9, '0')
                  || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS r FROM customer)),
tbempresas AS (
  SELECT CAST(n_nationkey AS INTEGER) AS codempresa, n_name AS nomeempresa,
         lpad(CAST(n_nationkey AS VARCHAR), 14, '0') AS cnpjcpf, 'F' AS tipobdempresa, '3050' AS portabd,
         '10.0.0.' || CAST(n_nationkey AS VARCHAR) AS ipbd, {path} AS caminhobd,
         CASE WHEN n_nationkey % 5 = 0 THEN 'N' ELSE 'S' END AS ativa, n_regionkey
  FROM nation)"""


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def cpf_valid_sql(x: str) -> str:
    d = _digits(x)
    dig = lambda i: f"CAST(substr({d}, {i}, 1) AS INTEGER)"
    s1 = " + ".join(f"{dig(i)} * {11 - i}" for i in range(1, 10))
    s2 = " + ".join(f"{dig(i)} * {12 - i}" for i in range(1, 11))
    return (
        f"(CASE WHEN {x} IS NULL OR length({d}) <> 11 THEN false "
        f"WHEN {d} = repeat(substr({d}, 1, 1), 11) THEN false "
        f"ELSE ((({s1}) * 10) % 11) % 10 = {dig(10)} AND ((({s2}) * 10) % 11) % 10 = {dig(11)} END)"
    )


def cpf_quality() -> str:
    v = cpf_valid_sql("cpfusuario")
    return control_prelude() + f"""
SELECT codempresa, CAST(count(*) AS BIGINT) AS usuarios,
       CAST(count_if({v}) AS BIGINT) AS cpf_validos, CAST(count_if(NOT {v}) AS BIGINT) AS cpf_invalidos
FROM tbusuarios GROUP BY codempresa"""


def users_insert_new() -> str:
    v = cpf_valid_sql("cpfusuario")
    return control_prelude() + f""",
batch AS (
  SELECT codusuario, {_digits('cpfusuario')} AS cpfusuario, CAST(codusuario AS BIGINT) * 2 AS seq FROM tbusuarios
  UNION ALL
  SELECT codusuario, {_digits('cpfusuario')} AS cpfusuario, CAST(codusuario AS BIGINT) * 2 + 1 AS seq
  FROM tbusuarios WHERE usuarioativo = 'N'),
b AS (SELECT batch.*, {v} AS ok,
             EXISTS (SELECT 1 FROM tbusuarios u WHERE u.cpfusuario = batch.cpfusuario) AS present
      FROM batch),
firsts AS (SELECT cpfusuario, min(seq) AS first_seq FROM b WHERE ok AND NOT present GROUP BY cpfusuario)
SELECT b.codusuario, b.cpfusuario, b.seq,
       CASE WHEN NOT b.ok THEN 'invalid_cpf' WHEN b.present THEN 'already_present'
            WHEN b.seq = firsts.first_seq THEN 'inserted' ELSE 'duplicate_in_batch' END AS outcome
FROM b LEFT JOIN firsts ON firsts.cpfusuario = b.cpfusuario"""


def companies_insert_new() -> str:
    return control_prelude() + """,
reqs AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cnpjcpf, CAST(s_suppkey AS BIGINT) * 2 AS seq FROM supplier
  UNION ALL
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0'), CAST(s_suppkey AS BIGINT) * 2 + 1 FROM supplier WHERE s_acctbal < 0),
known AS (SELECT DISTINCT cnpjcpf FROM tbempresas),
ranked AS (
  SELECT reqs.*, known.cnpjcpf IS NOT NULL AS present,
         row_number() OVER (PARTITION BY reqs.cnpjcpf ORDER BY reqs.seq) AS pos
  FROM reqs LEFT JOIN known ON known.cnpjcpf = reqs.cnpjcpf)
SELECT cnpjcpf, seq,
       CASE WHEN present THEN 'already_present' WHEN pos = 1 THEN 'inserted' ELSE 'duplicate_in_batch' END AS outcome
FROM ranked"""


def _user_changes() -> str:
    seq = "CAST(codusuario AS BIGINT) * 4"
    n = "CAST(NULL AS VARCHAR)"
    ni = "CAST(NULL AS INTEGER)"
    return f""",
ch AS (
  SELECT cpfusuario, {seq} AS seq, ['emailusuario'] AS supplied,
         {n} AS nomeusuario, {ni} AS codempresa, {n} AS usuarioativo, upper(emailusuario) AS emailusuario
  FROM tbusuarios WHERE c_mktsegment = 'BUILDING'
  UNION ALL
  SELECT cpfusuario, {seq}, ['nomeusuario', 'usuarioativo'], {n}, {ni}, 'S', {n}
  FROM tbusuarios WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL
  SELECT cpfusuario, {seq}, ['usuarioativo', 'codempresa'], {n}, 0, 'N', {n}
  FROM tbusuarios WHERE c_mktsegment = 'FURNITURE'
  UNION ALL
  SELECT cpfusuario, {seq} + 1, ['emailusuario', 'usuarioativo'], {n}, {ni}, 'S', {n}
  FROM tbusuarios WHERE c_mktsegment = 'FURNITURE'
  UNION ALL
  SELECT {_digits('cpfusuario')}, {seq}, ['codempresa'], {n}, 99, {n}, {n}
  FROM tbusuarios WHERE c_mktsegment = 'MACHINERY')"""


_USER_FIELDS = ["nomeusuario", "codempresa", "usuarioativo", "emailusuario"]


def users_partial_update() -> str:
    ctes = ""
    joins = ""
    sets = []
    for f in _USER_FIELDS:
        ctes += f""",
last_{f} AS (
  SELECT cpfusuario, v FROM (
    SELECT cpfusuario, {f} AS v, row_number() OVER (PARTITION BY cpfusuario ORDER BY seq DESC) AS rn
    FROM ch WHERE list_contains(supplied, '{f}')) WHERE rn = 1)"""
        joins += f" LEFT JOIN last_{f} ON last_{f}.cpfusuario = u.cpfusuario"
        sets.append(f"CASE WHEN last_{f}.cpfusuario IS NOT NULL THEN last_{f}.v ELSE u.{f} END AS {f}")
    return control_prelude() + _user_changes() + ctes + f"""
SELECT u.codusuario, {sets[0]}, {sets[1]}, {sets[2]}, u.cpfusuario, {sets[3]}
FROM tbusuarios u{joins}"""


def users_update_unknown() -> str:
    return control_prelude() + _user_changes() + """
SELECT cpfusuario, seq FROM ch
WHERE NOT EXISTS (SELECT 1 FROM tbusuarios u WHERE u.cpfusuario = ch.cpfusuario)"""


def _company_updates() -> str:
    return """,
upd AS (
  SELECT CAST(CASE WHEN n_regionkey = 4 THEN n_nationkey + 100 ELSE n_nationkey END AS INTEGER) AS codempresa,
         CAST(n_nationkey AS BIGINT) AS seq, n_name AS nomeempresa,
         lpad(CAST(n_nationkey AS VARCHAR), 14, '0') AS cnpjcpf, 'F' AS tipobdempresa, '3050' AS portabd,
         '10.1.0.' || CAST(n_nationkey AS VARCHAR) AS ipbd, CAST(NULL AS VARCHAR) AS caminhobd, 'N' AS ativa
  FROM nation WHERE n_regionkey IN (2, 4)),
lastu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY codempresa ORDER BY seq DESC) AS rn FROM upd)
          WHERE rn = 1)"""


def companies_full_update() -> str:
    cols = ["nomeempresa", "cnpjcpf", "tipobdempresa", "portabd", "ipbd", "caminhobd", "ativa"]
    sets = ", ".join(f"CASE WHEN l.codempresa IS NOT NULL THEN l.{c} ELSE e.{c} END AS {c}" for c in cols)
    return control_prelude() + _company_updates() + f"""
SELECT e.codempresa, {sets} FROM tbempresas e LEFT JOIN lastu l ON l.codempresa = e.codempresa"""


def companies_update_unknown() -> str:
    return control_prelude() + _company_updates() + """
SELECT codempresa, seq FROM upd WHERE NOT EXISTS (SELECT 1 FROM tbempresas e WHERE e.codempresa = upd.codempresa)"""


def _deletes() -> str:
    return f""",
del AS (
  SELECT cpfusuario FROM tbusuarios WHERE usuarioativo = 'N'
  UNION ALL
  SELECT {_digits('cpfusuario')} AS cpfusuario FROM tbusuarios WHERE c_mktsegment = 'MACHINERY')"""


_USER_PUBLIC = "codusuario, nomeusuario, codempresa, usuarioativo, cpfusuario, emailusuario"


def users_delete() -> str:
    return control_prelude() + _deletes() + f"""
SELECT {_USER_PUBLIC} FROM tbusuarios u WHERE NOT EXISTS (SELECT 1 FROM del d WHERE d.cpfusuario = u.cpfusuario)"""


def users_delete_unknown() -> str:
    return control_prelude() + _deletes() + """
SELECT cpfusuario FROM del d WHERE NOT EXISTS (SELECT 1 FROM tbusuarios u WHERE u.cpfusuario = d.cpfusuario)"""


def _company_deletes() -> str:
    return """,
del AS (
  SELECT codempresa FROM tbempresas WHERE ativa = 'N'
  UNION ALL
  SELECT codempresa + 100 FROM tbempresas WHERE n_regionkey = 4)"""


def companies_delete() -> str:
    return companies_public().replace("\nSELECT", _company_deletes() + "\nSELECT", 1) + """ e
WHERE NOT EXISTS (SELECT 1 FROM del d WHERE d.codempresa = e.codempresa)"""


def companies_delete_unknown() -> str:
    return control_prelude() + _company_deletes() + """
SELECT codempresa FROM del d WHERE NOT EXISTS (SELECT 1 FROM tbempresas e WHERE e.codempresa = d.codempresa)"""


def tenant_source() -> str:
    return control_prelude() + "\nSELECT ipbd, portabd, caminhobd FROM tbempresas WHERE codempresa = 7"


def tenant_sources() -> str:
    return control_prelude() + "\nSELECT codempresa, ipbd, portabd, caminhobd FROM tbempresas WHERE ativa = 'S'"


def company_lookup() -> str:
    return companies_public() + " WHERE codempresa = 7"


def users_public() -> str:
    return control_prelude() + f"\nSELECT {_USER_PUBLIC} FROM tbusuarios"


def companies_public() -> str:
    return control_prelude() + f"""
SELECT codempresa, nomeempresa, cnpjcpf, tipobdempresa, portabd, ipbd,
       replace(caminhobd, '{_BS * 2}', '{_BS}') AS caminhobd, ativa FROM tbempresas"""


# ------------------------------------------------------------------ audit
_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F ]"


def audit_normalised(rejected: bool = False) -> str:
    body = f"regexp_replace(replace(body_response, '{_BS}n', ''), '^{_WS}+|{_WS}+$', '', 'g')"
    return f"""
WITH ev AS (
  SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, 'user_' || CAST(user_id AS VARCHAR) AS usuario,
         CAST(user_id % 25 AS VARCHAR) AS codempresa,
         CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS metodo,
         CASE WHEN event_type = 'click' THEN '/login' ELSE '/bi/' || event_type END AS endpoint,
         props AS params, props AS body_request,
         CASE WHEN event_id % 7 = 0 THEN '  plain{_BS}n text ' ELSE ' ' || props || '{_BS}n' END AS body_response,
         CAST(CASE WHEN value > 300 THEN 501 ELSE 200 END AS INTEGER) AS status_code,
         CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'agent/' || CAST(user_id % 3 AS VARCHAR) END AS user_agent,
         '10.0.0.1' AS ip_address
  FROM events)
SELECT id, ts, usuario, codempresa, metodo, endpoint, params,
       CASE WHEN json_valid(body_request) THEN body_request END AS body_request,
       {body} AS body_response, json_valid({body}) AS body_response_json,
       status_code, ip_address, user_agent
FROM ev
WHERE {"NOT " if rejected else ""}(metodo IS NOT NULL AND endpoint IS NOT NULL AND status_code IS NOT NULL
       AND user_agent IS NOT NULL)"""


def audit_bodies() -> str:
    """E23 in full: kind, canonical text and fields of bodies of every kind."""
    body = f"regexp_replace(replace(raw, '{_BS}n', ''), '^{_WS}+|{_WS}+$', '', 'g')"
    whole = lambda path: f"CASE WHEN json_type(j, '{path}') IN ('UBIGINT', 'BIGINT') THEN CAST(j ->> '{path}' AS BIGINT) END"
    return f"""
WITH ev AS (
  SELECT event_id AS id, CASE WHEN event_type = 'click' THEN '/login' ELSE '/bi/' || event_type END AS endpoint,
         CASE event_id % 9
           WHEN 0 THEN '{{"access_token":"t' || event_id || '","empresa":' || user_id || ',"itens":[' || event_id || ',"' || event_type || '",null]}}'
           WHEN 1 THEN '[' || event_id || ',"x",{{"a":true}}]'
           WHEN 2 THEN CAST(event_id AS VARCHAR)
           WHEN 3 THEN '"user ' || user_id || '"'
           WHEN 4 THEN '{{ "z" : ' || user_id || ' , "a" : [ 1 , 2 ] }}{_BS}n'
           WHEN 5 THEN '{{"empresa": ' || event_id
           WHEN 6 THEN '  plain ' || event_id
           WHEN 7 THEN '-12.5' END AS raw
  FROM events WHERE event_id % 50 <> 0),
cleaned AS (SELECT id, endpoint, {body} AS body FROM ev),
parsed AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) ELSE to_json(body) END AS j FROM cleaned)
SELECT id, endpoint, coalesce(json_valid(body), false) AS body_response_json,
       CASE json_type(j) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'DOUBLE' THEN 'DECIMAL' ELSE json_type(j) END AS tipo,
       CASE json_type(j) WHEN 'OBJECT' THEN
         '{{' || array_to_string(list_transform(list_sort(json_keys(j)), lambda k: to_json(k) || ':' || CAST(json(j -> ('$.' || k)) AS VARCHAR)), ',') || '}}'
       ELSE CAST(json(j) AS VARCHAR) END AS texto,
       CASE WHEN json_type(j, '$.access_token') = 'VARCHAR' THEN j ->> '$.access_token' END AS token,
       {whole('$.empresa')} AS empresa, {whole('$.itens[0]')} AS item, {whole('$[0]')} AS primeiro
FROM parsed"""


def users_published() -> str:
    """The deletes after the changes; keys don't change, so the two don't mix."""
    return f"""
SELECT {_USER_PUBLIC} FROM ({users_partial_update()}) u
WHERE NOT EXISTS (SELECT 1 FROM ({control_prelude()}{_deletes()} SELECT cpfusuario FROM del) d WHERE d.cpfusuario = u.cpfusuario)"""


_COMPANY = "codempresa, nomeempresa, cnpjcpf, tipobdempresa, portabd, ipbd, caminhobd, ativa"


def _registered() -> str:
    """The company registry after the registrations."""
    return f""",
registered AS (
  SELECT {_COMPANY} FROM tbempresas
  UNION ALL
  SELECT CAST(s_suppkey + 1000 AS INTEGER), s_name, lpad(CAST(s_suppkey AS VARCHAR), 14, '0'), 'F', '3050',
         '10.2.0.' || CAST(s_suppkey AS VARCHAR), CAST(NULL AS VARCHAR), 'S'
  FROM supplier WHERE NOT EXISTS (SELECT 1 FROM tbempresas e WHERE e.cnpjcpf = lpad(CAST(s_suppkey AS VARCHAR), 14, '0')))"""


def companies_published() -> str:
    cols = ["nomeempresa", "cnpjcpf", "tipobdempresa", "portabd", "ipbd", "caminhobd", "ativa"]
    sets = [f"CASE WHEN l.codempresa IS NOT NULL THEN l.{c} ELSE e.{c} END" for c in cols]
    sets[5] = f"replace({sets[5]}, '{_BS * 2}', '{_BS}')"
    return control_prelude() + _registered() + _company_updates() + f"""
SELECT e.codempresa, {", ".join(f"{x} AS {c}" for x, c in zip(sets, cols))}
FROM registered e LEFT JOIN lastu l ON l.codempresa = e.codempresa"""


def company_requests() -> str:
    return control_prelude() + _registered() + """,
asked AS (SELECT CAST(1000 + l_suppkey AS INTEGER) AS codempresa, count(*) AS pedidos FROM lineitem GROUP BY l_suppkey)
SELECT a.codempresa, pedidos, e.codempresa IS NOT NULL AS conhecida, ipbd, portabd, caminhobd
FROM asked a LEFT JOIN registered e ON e.codempresa = a.codempresa"""


CONTROL_SQL = {
    "audit_bodies": audit_bodies,
    "users_published": users_published,
    "companies_published": companies_published,
    "company_requests": company_requests,
    "cpf_quality": cpf_quality,
    "users_insert_new": users_insert_new,
    "companies_insert_new": companies_insert_new,
    "users_partial_update": users_partial_update,
    "users_update_unknown": users_update_unknown,
    "companies_full_update": companies_full_update,
    "companies_update_unknown": companies_update_unknown,
    "users_delete": users_delete,
    "users_delete_unknown": users_delete_unknown,
    "companies_delete": companies_delete,
    "companies_delete_unknown": companies_delete_unknown,
    "tenant_source": tenant_source,
    "tenant_sources": tenant_sources,
    "company_lookup": company_lookup,
    "users_public": users_public,
    "companies_public": companies_public,
    "audit_normalised": audit_normalised,
    "audit_stream_append": audit_normalised,
    "audit_batch_sink": audit_normalised,
    "audit_rejected": lambda: audit_normalised(rejected=True),
}


# ------------------------------------------------------------ all tenants
def big_numbers_all_tenants(f: ReportFilters, as_of: dt.datetime) -> str:
    """Q1 per tenant: the four statements grouped by tenant, outer-combined
    over every tenant that has rows in either period."""
    a, b = _period(f, as_of)
    pa, pb = _prior(f, as_of)

    def rec(x, y):
        return (f"SELECT codempresa, CAST(SUM(vlrrecbto) AS DOUBLE) AS fat FROM vwfactrc_bi "
                f"WHERE datarecbto >= {x} AND datarecbto <= {y} GROUP BY codempresa")

    def frt(x, y):
        return (f"SELECT codempresa, CAST(SUM(vlrcusto) AS DOUBLE) AS cus, CAST(SUM(vlrpedagio) AS DOUBLE) AS ped, "
                f"CAST(SUM(pesofrete_ton) AS DOUBLE) AS vol, CAST(SUM(embarque) AS BIGINT) AS emb, "
                f"CAST(SUM(faturado) AS BIGINT) AS ftd FROM vwfrctrc_bi "
                f"WHERE dataemissao >= {x} AND dataemissao <= {y} GROUP BY codempresa")

    pct = lambda c, p: f"CASE WHEN {p} <> 0 THEN ((CAST({c} AS DOUBLE) / CAST({p} AS DOUBLE)) - 1) * 100 ELSE 0.0 END"
    return f""",
r AS ({rec(a, b)}), rp AS ({rec(pa, pb)}), q AS ({frt(a, b)}), qp AS ({frt(pa, pb)}),
ten AS (SELECT codempresa FROM r UNION SELECT codempresa FROM rp UNION SELECT codempresa FROM q
        UNION SELECT codempresa FROM qp),
v AS (
  SELECT ten.codempresa, COALESCE(r.fat, 0.0) AS fat, COALESCE(rp.fat, 0.0) AS fat_p,
         COALESCE(q.cus, 0.0) AS cus, COALESCE(qp.cus, 0.0) AS cus_p,
         COALESCE(q.ped, 0.0) AS ped, COALESCE(qp.ped, 0.0) AS ped_p,
         COALESCE(q.vol, 0.0) AS vol, COALESCE(qp.vol, 0.0) AS vol_p,
         COALESCE(q.emb, 0) AS emb, COALESCE(qp.emb, 0) AS emb_p,
         COALESCE(q.ftd, 0) AS ftd, COALESCE(qp.ftd, 0) AS ftd_p
  FROM ten LEFT JOIN r ON r.codempresa = ten.codempresa LEFT JOIN rp ON rp.codempresa = ten.codempresa
  LEFT JOIN q ON q.codempresa = ten.codempresa LEFT JOIN qp ON qp.codempresa = ten.codempresa)
SELECT codempresa, fat AS faturamento, {pct('fat', 'fat_p')} AS faturamento_ano_anterior,
       vol AS volumes, {pct('vol', 'vol_p')} AS volumes_ano_anterior,
       emb AS embarques, {pct('emb', 'emb_p')} AS embarques_ano_anterior,
       CASE WHEN ftd <> 0 THEN fat / CAST(ftd AS DOUBLE) ELSE 0.0 END AS ticket_medio,
       CASE WHEN ftd <> 0 AND ftd_p <> 0 AND fat_p <> 0
            THEN (((fat / CAST(ftd AS DOUBLE)) / (fat_p / CAST(ftd_p AS DOUBLE))) - 1) * 100 ELSE 0.0 END
         AS ticket_medio_ano_anterior,
       cus AS custos, {pct('cus', 'cus_p')} AS custos_ano_anterior,
       ped AS pedagios, {pct('ped', 'ped_p')} AS pedagios_ano_anterior,
       CASE WHEN fat <> 0 THEN ((fat - cus) / fat) * 100 ELSE 0.0 END AS margem,
       CASE WHEN fat <> 0 AND fat_p <> 0 AND (fat_p - cus_p) / fat_p <> 0
            THEN ((((fat - cus) / fat) / ((fat_p - cus_p) / fat_p)) - 1) * 100 ELSE 0.0 END
         AS margem_ano_anterior
FROM v"""


def a_pagar_fornecedor_all_tenants(f: ReportFilters, as_of: dt.datetime) -> str:
    a, b = _period(f, as_of)
    w = where_filters(f, _PAY)
    return f""",
owed AS (SELECT codempresa, codfornecedor, fornecedor, vlrsaldo FROM vwcptit_bi
         WHERE (condicao_fatura = 'A Pagar' AND datavencto BETWEEN {a} AND {b}) OR condicao_fatura = 'Em Atraso')
SELECT codempresa, CAST(codfornecedor AS VARCHAR) AS codfornecedor, fornecedor,
       {_dbl('SUM(vlrsaldo)')} AS a_pagar
FROM owed WHERE true{w} GROUP BY codempresa, codfornecedor, fornecedor"""


#: The fixture's tenants (FIXTURES.md).
TENANTS = (0, 1, 2)
_TENANT_VIEWS = ("vwfactrc_bi", "vwfrctrc_bi", "vwcptit_bi")


def per_tenant(report):
    """SQL of ``report`` for all tenants: the single-company statement once per
    tenant, over views that hold only that tenant's rows."""

    def sql(f: ReportFilters, as_of: dt.datetime) -> str:
        body = report(f, as_of).strip()
        every = "".join(f",\nall_{v} AS (SELECT * FROM {v})" for v in _TENANT_VIEWS)
        arms = []
        for k in TENANTS:
            views = ", ".join(f"{v} AS (SELECT * EXCLUDE (codempresa) FROM all_{v} WHERE codempresa = {k})" for v in _TENANT_VIEWS)
            arms.append(f"SELECT CAST({k} AS INTEGER) AS codempresa, x.* FROM (WITH {views}\n{body}) x")
        return every + "\n" + "\nUNION ALL\n".join(arms)

    return sql


TENANT_SQL = {f"{name}_all_tenants": per_tenant(fn) for name, fn in REPORT_SQL.items() if name != "kpi_filial"} | {
    "big_numbers_all_tenants": big_numbers_all_tenants,
    "a_pagar_fornecedor_all_tenants": a_pagar_fornecedor_all_tenants,
}


# ------------------------------------------------------------ response shapes
def response_entries(name: str, keys: list[str], values: list[str], measure: str | None, label: str | None,
                     f: ReportFilters, as_of: dt.datetime) -> str:
    """Entries of the report's map: place, keys as strings, values flat.  A code's
    entry has the values of its last row (smallest measure, then label) and stands
    where its first row (largest measure) does."""
    body = REPORT_SQL[name](f, as_of).strip()
    head, rows = (body[:body.rindex("\nSELECT ")], body[body.rindex("\nSELECT "):]) if body.startswith(",") else ("", body)
    chave = [f"COALESCE(CAST({k} AS VARCHAR), '{'0' if k in ('ano', 'mes_numero', 'dia') else 'null'}') AS {a}"
             for k, a in zip(keys, ("chave", "subchave"))]
    cols = [f"COALESCE({v}, 'Indefinido') AS {v}" if v == "mes" else v for v in values]
    if measure is None:
        place = ", ".join(f"{k} NULLS FIRST" for k in keys)
        return f"{head},\nflat AS ({rows})\nSELECT {', '.join(chave + cols)}, row_number() OVER (ORDER BY {place}) AS posicao FROM flat"
    last = f"{measure} NULLS FIRST" + (f", {label} NULLS FIRST" if label else "")
    return f"""{head},
flat AS ({rows}),
named AS (SELECT *, {', '.join(chave)} FROM flat),
ends AS (SELECT *, max({measure}) OVER (PARTITION BY chave) AS top, row_number() OVER (PARTITION BY chave ORDER BY {last}) AS from_last FROM named)
SELECT chave, {', '.join(cols)}, row_number() OVER (ORDER BY top DESC NULLS LAST, chave) AS posicao FROM ends WHERE from_last = 1"""
