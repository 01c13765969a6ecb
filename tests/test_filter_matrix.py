"""SURVEY §2.4 filter matrix: for every report, each honoured filter field
changes the result and every other field leaves it unchanged."""

import datetime as dt

import pytest

from freightlens import ErpTables, ReportFilters, plans
from freightlens.catalog import AS_OF
from tests.conftest import SF_SMALL

ALL8 = ["codfilial", "codcliente", "codcid", "regiao", "codpro", "ano", "mes", "dia"]
NO_CLIENT6 = ["codfilial", "codcid", "regiao", "ano", "mes", "dia"]
LIST4 = ["codfilial", "codcliente", "regiao", "codpro"]
REC2 = ["codfilial", "codcliente"]
PAY2 = ["codfornecedor", "codtransacao"]

HONOURED = {
    "big_numbers": ALL8, "kpi_mes_ano": NO_CLIENT6, "kpi_dia_mes_atual": NO_CLIENT6,
    "kpi_filial": ALL8, "kpi_regiao": ALL8, "kpi_cidade": NO_CLIENT6,
    "kpi_cliente": LIST4, "kpi_produto": LIST4, "tabela_faturamento": LIST4,
    "big_numbers_contas_receber": REC2, "recebimentos_dia_mes_atual": REC2,
    "a_receber_cliente": REC2, "tabela_a_receber": REC2,
    "big_numbers_contas_pagar": PAY2, "contas_pagar_dia_mes_atual": PAY2,
    "a_pagar_fornecedor": PAY2, "tabela_a_pagar": PAY2,
}

# one restrictive value per field (codes that exist in the test data)
VALUES = {
    "codfilial": [1], "codcliente": ["00000000000001", "00000000000002", "00000000000004"], "codcid": [1, 2],
    "regiao": ["Sul"], "codpro": [1, 2, 3, 4, 5], "ano": [1999], "mes": [3], "dia": [5],
    "codfornecedor": ["00000000000001"], "codtransacao": [1],
}
PERIOD = dict(data_inicio=dt.date(1995, 1, 1), data_fim=dt.date(2000, 6, 15))


@pytest.fixture(scope="module")
def t(spark):
    return ErpTables.from_fixture(spark, SF_SMALL)


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(HONOURED))
def test_filter_matrix(t, name):
    fn = plans.REPORTS[name]
    base = _rows(fn(t, ReportFilters(**PERIOD), AS_OF))
    assert base
    for field, values in VALUES.items():
        got = _rows(fn(t, ReportFilters(**PERIOD, **{field: values}), AS_OF))
        if field in HONOURED[name]:
            assert got != base, (name, field)
        else:
            assert got == base, (name, field)
