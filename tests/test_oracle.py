"""Every registered query equals its DuckDB SQL (values and Arrow types) on
the smallest test data; the anchor values of FIXTURES.md hold at sf0.01."""

import pytest

import __spark_entry__ as E
from freightlens import catalog
from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_compare import compare_frames

ALL, SQL = E.queries(), E.oracle_sql()
QUERIES = {k: ALL[k] for k in catalog.all_queries()}


def test_every_query_has_sql():
    assert set(QUERIES) == set(catalog.all_sql()) and set(SQL) <= set(ALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert compare_frames(df, duck_small, SQL[name]) is None


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["codfilial", "filial", "volume", "embarques", "faturamento"]
    assert df.count() > 0


def _one(spark, name):
    return QUERIES[name](spark, SF_MID).collect()


def test_anchor_view_counts(spark):
    for name, n in {"vw_tbcid": 100, "vw_factrc": 15000, "vw_frctrc": 39972, "vw_cptit": 60000}.items():
        assert QUERIES[name](spark, SF_MID).count() == n


def test_anchor_big_numbers(spark):
    r = _one(spark, "big_numbers")[0]
    assert r.faturamento == pytest.approx(36731815.90)
    assert r.custos == pytest.approx(23241584.69)
    assert r.pedagios == pytest.approx(12034.00)
    assert r.volumes == pytest.approx(1203.4)
    assert (r.embarques, ) == (77, )


def test_anchor_receivables_and_payables(spark):
    q12 = _one(spark, "big_numbers_contas_receber")[0]
    assert q12.a_receber == 0.0 and q12.em_atraso == pytest.approx(1028854810.87)
    fwd = _one(spark, "big_numbers_contas_receber_forward")[0]
    assert fwd.a_receber == pytest.approx(25722493.46)
    q18 = _one(spark, "big_numbers_contas_pagar")[0]
    assert q18.pago == pytest.approx(26080610.35)
    assert q18.a_pagar == 0.0 and q18.em_atraso == pytest.approx(834609735.52)


def test_anchor_kpi_filial(spark):
    rows = {r.codfilial: r for r in _one(spark, "kpi_filial")}
    assert len(rows) == 25
    b0 = rows["0"]
    assert (b0.volume, b0.embarques) == (pytest.approx(56.8), 7)
    assert b0.faturamento == pytest.approx(1956334.28)


def test_anchor_users_and_audit(spark):
    q = {r.codempresa: r for r in _one(spark, "cpf_quality")}
    assert sum(r.usuarios for r in q.values()) == 1500
    assert sum(r.cpf_validos for r in q.values()) == 12
    assert QUERIES["audit_normalised"](spark, SF_MID).count() == 10000 - 200


def test_anchor_city_groups(spark):
    """Receivables carry the destination city code but the payment
    city's name, so codes have many labels."""
    from pyspark.sql import functions as F

    from freightlens import plans
    from freightlens.catalog import AS_OF, tables

    rv = plans.receivables_view(tables(spark, SF_MID), AS_OF, need={"codcid", "cidade", "coduf"})
    g = rv.select("codcid", F.concat("cidade", F.lit("-"), "coduf").alias("c")).distinct()
    assert g.count() == 7921
    assert g.select("codcid").distinct().count() == 120
