"""Logical plans: semantic views (V1-V4) and the 21 reports (Q1-Q21)."""

from .lists import filtro_cliente, filtro_filial, filtro_fornecedor, filtro_transacao
from .payable import a_pagar_fornecedor, big_numbers_contas_pagar, contas_pagar_dia_mes_atual, tabela_a_pagar
from .receivable import a_receber_cliente, big_numbers_contas_receber, recebimentos_dia_mes_atual, tabela_a_receber
from .revenue import (
    big_numbers,
    kpi_cidade,
    kpi_cliente,
    kpi_dia_mes_atual,
    kpi_filial,
    kpi_mes_ano,
    kpi_produto,
    kpi_regiao,
    operations,
    tabela_faturamento,
)
from .responses import response, response_json
from .views import as_output, city_view, city_view_of, freight_view, payables_view, receivables_view

#: Reports that take (tables, filters, as_of), by their reference name.
REPORTS = {
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

#: Lists that take only the tables.
LISTS = {
    "filtro_filial": filtro_filial,
    "filtro_cliente": filtro_cliente,
    "filtro_fornecedor": filtro_fornecedor,
    "filtro_transacao": filtro_transacao,
}
