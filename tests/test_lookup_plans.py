"""How lookups are planned where a dimension's files don't tell its size."""

import datetime as dt

from freightlens import ErpTables, ReportFilters, plans
from tests.conftest import SF_MID

AS_OF = dt.datetime(2000, 6, 15, 12)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_transactions_do_not_shuffle_the_titles(spark):
    # tbhis is an aggregate of the large orders: a few rows, whose size Spark must see
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        t = ErpTables.from_fixture(spark, SF_MID)
        for tables in (t, ErpTables.from_fixture(spark, SF_MID, multi_tenant=True)):
            view = plans.payables_view(tables, AS_OF, need={"nrocontrole", "transacao", "conta"})
            assert "SortMergeJoin" not in _plan(view) and "hashpartitioning" not in _plan(view)
        got = {tuple(r) for r in t.table("tbhis").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    orders = spark.read.parquet(f"{SF_MID}/orders.parquet").select("o_orderpriority").distinct().collect()
    assert got == {(int(r[0][0]), r[0][2:]) for r in orders}


def test_customers_of_all_tenants_are_not_held_whole_by_a_task(spark):
    multi = ErpTables.from_fixture(spark, SF_MID, multi_tenant=True)
    held = ErpTables.from_fixture(spark, SF_MID, multi_tenant=True, broadcast_policy={"tbcli": True})
    got, want = (plans.tabela_faturamento(t, ReportFilters(), AS_OF) for t in (multi, held))
    assert "SortMergeJoin" in _plan(got) and "SortMergeJoin" not in _plan(want)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    one = ErpTables.from_fixture(spark, SF_MID)
    assert "SortMergeJoin" not in _plan(plans.tabela_faturamento(one, ReportFilters(), AS_OF))
