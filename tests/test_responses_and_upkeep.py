"""Order of map responses, places, the audit sink's batches, request identity,
registry snapshots, parsed bodies, bucketed and shared warehouses."""

import pytest
from pyspark.sql import functions as F

from freightlens import plans
from freightlens.catalog import AS_OF
from freightlens.operators.filters import ReportFilters
from freightlens.operators.ranking import with_place
from freightlens.operators.registry import insert_outcomes
from freightlens.plans import audit
from freightlens.plans.responses import SHAPES, response, response_json
from freightlens.sources import ErpTables
from freightlens.sources import fixtures as fx
from tests.conftest import SF_SMALL

BY_CODE = [n for n, s in SHAPES.items() if s[0] == "map" and s[1] != "dia"]


@pytest.fixture(scope="module")
def t(spark):
    return ErpTables.from_fixture(spark, SF_SMALL)


def dict_of(rows, key, measure, label):
    """The reference's dict in plain Python: rows by the measure DESC (ties: code
    ascending, label descending), a later row of a code overwrites its entry."""
    none_last = lambda r: (r[measure] is not None, r[measure] or 0)
    out = {}
    by_label = sorted(rows, key=lambda r: (label and r[label]) or "", reverse=True)
    by_code = sorted(by_label, key=lambda r: "null" if r[key] is None else str(r[key]))
    for r in sorted(by_code, key=none_last, reverse=True):
        out["null" if r[key] is None else str(r[key])] = r
    return out


def test_seven_reports_by_code():
    assert len(BY_CODE) == 7


@pytest.mark.parametrize("name", BY_CODE)
def test_entries_in_dict_order(t, name):
    _, key, values, measure, label = SHAPES[name]
    flat = plans.REPORTS[name](t, ReportFilters(), AS_OF)
    want = dict_of(flat.collect(), key, measure, label)
    got = response(name, flat).orderBy("posicao").collect()
    assert [r.posicao for r in got] == list(range(1, len(want) + 1))
    assert [r.chave for r in got] == list(want)
    assert [[r.valor[c] for c in values] for r in got] == [[r[c] for c in values] for r in want.values()]
    assert [r.posicao for r in response_json(name, flat).orderBy("posicao").collect()] == [r.posicao for r in got]


@pytest.mark.parametrize("name", ["kpi_cidade", "kpi_cliente"])
def test_place_of_a_code_with_several_rows(spark, name):
    """The entry stands at the code's first row and has the values of its last."""
    _, key, values, measure, label = SHAPES[name]
    rows = [("1", "x", 9.0), ("1", "y", 1.0), ("2", "z", 5.0), (None, "n", 7.0), ("3", "u", None), ("4", "v", 5.0), ("2", "w", None)]
    flat = spark.createDataFrame(rows, f"{key} string, {label} string, {measure} double")
    for c in values:
        if c not in flat.columns:
            flat = flat.withColumn(c, F.lit(0))
    got = response(name, flat.repartition(4)).orderBy("posicao").collect()
    assert [(r.chave, r.valor[label]) for r in got] == [("1", "y"), ("null", "n"), ("2", "w"), ("4", "v"), ("3", "u")]


@pytest.mark.parametrize("name", ["kpi_mes_ano", "kpi_dia_mes_atual", "recebimentos_dia_mes_atual", "contas_pagar_dia_mes_atual"])
def test_calendar_entries_in_order(t, name):
    keys = ["chave", "subchave"] if SHAPES[name][0] == "nested" else ["chave"]
    got = response(name, plans.REPORTS[name](t, ReportFilters(), AS_OF)).orderBy("posicao").collect()
    assert got and [tuple(int(r[k]) for k in keys) for r in got] == sorted(tuple(int(r[k]) for k in keys) for r in got)


def test_places(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("same"))
    got = with_place(df.repartition(6), ["same", F.desc("v")], "p", partitions=7).collect()
    assert sorted((r.p, r.v) for r in got) == [(k, 4999 - k) for k in range(5000)]
    # a tie that holds all rows is cut over ranges and still gets each place once
    tied = with_place(df.select("same"), ["same"], "p", partitions=5)
    assert sorted(r.p for r in tied.collect()) == list(range(5000))
    assert with_place(df.limit(0), ["v"], "p").count() == 0


# ---------------------------------------------------------------- audit sink

def test_audit_rerun_leaves_the_table(spark, tmp_path):
    rows = audit.accepted(fx.audit_events(spark, SF_SMALL)).select(*audit.AUDIT_COLS)
    path, n = str(tmp_path / "audit"), rows.count()
    early, late = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    audit.write_audit(early, path, "file-0")
    audit.write_audit(late, path, "file-1")
    once = sorted(audit.read_audit(spark, path).collect())
    for _ in range(2):
        audit.write_audit(late, path, "file-1")
        assert sorted(audit.read_audit(spark, path).collect()) == once and len(once) == n
    # a batch that shrinks leaves no day of its earlier run behind
    audit.write_audit(late.limit(1), path, "file-1")
    assert audit.read_audit(spark, path).count() == early.count() + 1
    audit.write_audit(late.limit(0), path, "file-1")
    assert audit.read_audit(spark, path).count() == early.count()
    for bad in ("", "a/b", "../x", "lote=1"):
        with pytest.raises(ValueError):
            audit.write_audit(late, path, bad)


# ---------------------------------------------------------------- request identity

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_insert_per_key_from_an_unordered_source(spark, seed):
    rows = [(f"k{i % 40}", i % 3, f"n{i % 5}") for i in range(2000)] + [("hot", 0, "same")] * 500 + [(None, 1, "x")] * 3
    have = spark.createDataFrame([("k1",), (None,)], "k string")
    # rand() orders the rows anew in every evaluation
    batch = spark.createDataFrame(rows, "k string, seq int, name string").repartition(5).orderBy(F.rand())
    out = insert_outcomes(have, batch, "k", "seq").collect()
    by = {}
    for r in out:
        by.setdefault((r.k, r.outcome), []).append(r)
    assert len(out) == len(rows) and sorted(map(str, ((r.k, r.seq, r.name) for r in out))) == sorted(map(str, rows))
    keys = {k for k, _, _ in rows} - {"k1", None}
    assert {k for k, o in by if o == "inserted"} == keys and all(len(by[k, "inserted"]) == 1 for k in keys)
    assert all(by[k, "inserted"][0][1:3] == min((s, n) for kk, s, n in rows if kk == k) for k in keys)
    assert len(by["hot", "duplicate_in_batch"]) == 499 and len(by[None, "already_present"]) == 3


def test_a_request_sent_many_times_is_spread(spark, monkeypatch):
    from freightlens.operators import registry

    monkeypatch.setattr(registry, "RUN", 16)
    batch = spark.range(333).select(F.lit("k").alias("k"), F.lit(1).alias("seq"))
    got = [r.outcome for r in insert_outcomes(batch.select("k").limit(0), batch, "k", "seq").collect()]
    assert got.count("inserted") == 1 and got.count("duplicate_in_batch") == 332


# ---------------------------------------------------------------- published versions

def test_published_versions(spark, tmp_path):
    from freightlens.sources import snapshots as S

    root = str(tmp_path / "users")
    assert S.current(spark, root) == 0
    one, two = spark.range(3), spark.range(10, 15)
    assert S.publish(one, root) == 1 and S.read(spark, root).count() == 3
    before = S.read(spark, root)
    # a job that dies after its data, before its pointer: readers still see the old version
    S.write_data(two, root)
    assert S.current(spark, root) == 1 and S.read(spark, root).count() == 3
    # a job that dies while it writes: a folder without its success marker
    (tmp_path / "users" / "data-dead").mkdir()
    (tmp_path / "users" / "data-dead" / "part-0.parquet").write_bytes(b"PAR1")
    assert S.read(spark, root).count() == 3
    # a version is made from the one before, read while the new one appears
    assert S.publish(before.unionByName(two), root, 1) == 2
    assert before.count() == 3 and S.read(spark, root).count() == 8 and S.read(spark, root, 1).count() == 3
    # a job that began with an old version is refused, by the check and by the rename alike
    with pytest.raises(S.Conflict):
        S.publish(one, root, 1)
    with pytest.raises(S.Conflict):
        S.point(spark, root, S.write_data(one, root), 1)
    assert S.versions(spark, root) == [1, 2] and S.read(spark, root).count() == 8
    assert not [f for f in (tmp_path / "users" / "_pointers").iterdir() if f.name.startswith("draft")]


# ---------------------------------------------------------------- parsed bodies

def test_parsed_bodies(spark, tmp_path):
    texts = {1: '{"b":1,"a":[1, 2.50,null]}', 2: "[3]", 3: "7", 4: '{"a":', 5: "plain", 6: None, 7: "null", 8: '"s"', 9: "", 10: '{"access_token":5,"empresa":"x"}'}
    rows = spark.createDataFrame(list(texts.items()), "id long, body_response string")
    got = audit.body_fields(audit.with_parsed_body(rows), audit.BODY_FIELDS)
    from freightlens.functions import body_kind, canonical_json

    out = {r.id: r for r in got.select("id", body_kind("body_response_variant").alias("k"), canonical_json("body_response_variant").alias("t"), *audit.BODY_FIELDS).collect()}
    assert {i: r.k for i, r in out.items()} == {1: "OBJECT", 2: "ARRAY", 3: "BIGINT", 4: "STRING", 5: "STRING", 6: None, 7: "VOID", 8: "STRING", 9: "STRING", 10: "OBJECT"}
    assert out[1].t == '{"a":[1,2.5,null],"b":1}' and out[4].t == '"{\\"a\\":"' and out[7].t == "null" and out[9].t == '""'
    assert out[2].primeiro == 3 and out[10].empresa is None and out[1].token is None and out[5].item is None
    got.select("id", "body_response_variant").write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.schema["body_response_variant"].dataType.typeName() == "variant"
    assert {r.id: r.t for r in back.select("id", canonical_json("body_response_variant").alias("t")).collect()} == {i: r.t for i, r in out.items()}


# ---------------------------------------------------------------- warehouses

def _sorted(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def bucketed(spark, t, tmp_path_factory):
    from freightlens.sources import stage_bucketed

    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed_test")
    stage_bucketed(t, "bucketed_test", str(tmp_path_factory.mktemp("bucketed")), buckets=4, slices=3)
    yield ErpTables.from_tables(spark, "bucketed_test")
    spark.sql("DROP DATABASE bucketed_test CASCADE")


def test_bucketed_reports_are_the_same(t, bucketed):
    for name, report in plans.REPORTS.items():
        f = ReportFilters()
        assert _sorted(report(bucketed, f, AS_OF)) == _sorted(report(t, f, AS_OF)), name
    for name, rows in plans.LISTS.items():
        assert _sorted(rows(bucketed)) == _sorted(rows(t)), name


def test_large_lookups_move_no_fact(spark, bucketed):
    """Above the broadcast threshold, nothing is exchanged below the join with customers or suppliers."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        views = [plans.receivables_view(bucketed, AS_OF, need={"cliente", "vlrrecbto"}), plans.freight_view(bucketed, need={"cliente", "totalpeso"}),
                 plans.payables_view(bucketed, AS_OF, need={"fornecedor", "vlrtotal"})]
        for df in views:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
            assert df.count() > 0
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_customer_lies_in_several_buckets(spark, bucketed):
    facts = bucketed.table("factrc").groupBy("cgccpffatura").agg(F.countDistinct("fatia").alias("s"), F.count("*").alias("n"))
    most = facts.orderBy(F.desc("n")).first()
    assert most["n"] > 6 and most["s"] == 3


def test_shared_warehouse_plan_does_not_grow_with_tenants(spark, tmp_path):
    from freightlens.sources import stage
    from freightlens.sources.erp import DIMENSIONS, FACTS

    full = ErpTables.from_fixture(spark, SF_SMALL)
    few = ErpTables.from_frames(spark, {n: full.table(n).limit(20).coalesce(1) for n in (*DIMENSIONS, *FACTS)})
    sizes, reports = {}, {}
    for n, codes in ((2, (1, 2)), (12, range(3, 13))):
        for code in codes:
            stage(few, str(tmp_path / "w"), tenant=code)
        w = ErpTables.from_parquet(spark, str(tmp_path / "w"), ("codempresa",))
        df = plans.a_receber_cliente(w, ReportFilters(), AS_OF)
        sizes[n] = len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
        reports[n] = df.groupBy("codempresa").count().collect()
    assert sizes[2] == sizes[12]
    assert len({r["count"] for r in reports[12]}) <= 1 and len(reports[12]) in (0, 12)
    one = plans.tabela_a_receber(w.for_tenant(7), ReportFilters(), AS_OF)
    assert _sorted(one) == _sorted(plans.tabela_a_receber(ErpTables.from_parquet(spark, str(tmp_path / "w"), ("codempresa",)).for_tenant(3), ReportFilters(), AS_OF))
    with pytest.raises(ValueError):
        stage(w, str(tmp_path / "v"), tenant=1)


def _spoil(root, fact, keep):
    """Make every data file of a staged fact unreadable but those of month ``keep``."""
    for f in (root / fact).rglob("*.parquet"):
        if f"particao_mes={keep}" not in str(f):
            f.write_bytes(b"spoilt")


def test_refresh_of_a_month_reads_that_month_only(spark, tmp_path):
    """Source and warehouse files of other months can't even be opened."""
    from freightlens.sources import refresh_months, snapshots, stage
    from freightlens.sources.erp import FACTS, FINGERPRINTS

    full = ErpTables.from_fixture(spark, SF_SMALL)
    src, dst = tmp_path / "source", tmp_path / "warehouse"
    stage(full, str(src))
    stage(full, str(dst))
    source = ErpTables.from_parquet(spark, str(src))
    for name in FACTS:
        source.table(name, None)
    refresh_months(full, str(dst))  # the first one publishes the fingerprints
    assert all(snapshots.current(spark, f"{dst}/{FINGERPRINTS}/{n}") == 1 for n in FACTS)

    # in the warehouse, the month loses a file in each fact; elsewhere nothing can be read
    month, before = 200005, {}
    for name in FACTS:
        assert source.table(name).columns
        before[name] = spark.read.parquet(f"{dst}/{name}").filter(f"particao_mes = {month}").count()
        files = sorted((dst / name).rglob("*.parquet"))
        here = [f for f in files if f"particao_mes={month}" in str(f)]
        assert before[name] > 0 and len(here) < len(files)
        _spoil(src, name, month)
        _spoil(dst, name, month)
        for f in here:
            f.write_bytes(b"spoilt")
    refresh_months(source, str(dst), [month], only=True)
    for name in FACTS:
        got = spark.read.schema(full.table(name).schema).parquet(*{str(f.parent) for f in (dst / name).rglob("*.parquet") if f"particao_mes={month}" in str(f)})
        assert got.count() == before[name]
        assert snapshots.current(spark, f"{dst}/{FINGERPRINTS}/{name}") == 2


def test_refresh_by_stored_fingerprints(spark, tmp_path):
    """A paid and a re-dated title move, an unchanged month isn't written again, and a
    later full run finds nothing to do."""
    from freightlens.sources import refresh_months, stage
    from freightlens.sources.erp import DIMENSIONS, FACTS, changed_partitions

    full = ErpTables.from_fixture(spark, SF_SMALL)
    root = str(tmp_path / "w")
    stage(full, root)
    refresh_months(full, root)
    open_ = full.table("cptit").filter("vlrsaldo <> 0 and datavencto is not null").orderBy("nrocontrole").first()
    paid = full.table("cptit").withColumn("vlrsaldo", F.when(F.col("nrocontrole") == open_["nrocontrole"], F.lit(0).cast(full.table("cptit").schema["vlrsaldo"].dataType)).otherwise(F.col("vlrsaldo")))
    frames = {n: full.table(n) for n in (*DIMENSIONS, *FACTS)}
    later = ErpTables.from_frames(spark, {**frames, "cptit": paid})
    month = open_["datavencto"].year * 100 + open_["datavencto"].month
    changed = changed_partitions(later, root, "cptit", [month])[0].collect()
    assert changed and {r["__particao_mes"] for r in changed} == {month}
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "w" / "cptit").rglob("*.parquet")}
    refresh_months(later, root, [month], only=True)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "w" / "cptit").rglob("*.parquet")}
    assert all(after[f] == t for f, t in files.items() if f"particao_mes={month}" not in str(f))
    cols = later.table("cptit").columns
    assert _sorted(spark.read.parquet(f"{root}/cptit").select(cols)) == _sorted(later.table("cptit").select(cols))
    assert all(changed_partitions(later, root, n)[0].isEmpty() for n in FACTS)
