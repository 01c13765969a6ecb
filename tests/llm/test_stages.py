"""Each stage of the pipeline by itself against its operator's query, and the mix's shards."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freightlens.llm import common as C
from freightlens.llm import decontaminate, mixing, pii, quality
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The table, with extra columns that clash with the operators' own, a null and a repeated row."""
    table = C.table(spark, SF_MID, "documents")
    extra = spark.createDataFrame([(None, None, None, None, None), (-1, "", "xx", None, 0), (-2, "a b " * 60_000, "en", "web", 0)], table.schema)
    return written(table.unionByName(extra).unionByName(table.where("doc_id = 3")).withColumn("__extra", F.lit(1)).withColumn("size", F.lit("clash")), tmp_path_factory)


def written(df, tmp_path_factory):
    """Not by C.saved: a stage releases what that has written."""
    path = str(tmp_path_factory.mktemp("written") / "t")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ids(df):
    return sorted((str(r.doc_id) for r in df.select("doc_id").collect()))


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "personal data", "mixture"]


def test_quality_stage(spark, docs):
    got = corpus_pipeline.quality_rules(spark, docs, SF_MID)
    want = quality.judged(quality.measured(docs, "__q"), "__q").where("__q.kept")
    assert got.columns == docs.columns and ids(got) == ids(want) and 0 < got.count() < docs.count()


def test_decontamination_stage(spark, docs):
    got = corpus_pipeline.decontamination(spark, docs, SF_MID)
    items = C.table(spark, SF_MID, "benchmark")
    rows, marks = decontaminate.found_windows(docs, items, ["doc_id"])
    assert got.columns == docs.columns and ids(got) == ids(rows.join(marks.select("__uid"), "__uid", "left_anti"))
    assert 0 < got.count() < docs.count()


def test_decontamination_shuffles_no_clean_document(spark, docs):
    """The rows that are joined are those with a prefix shingle, filtered in the scan."""
    plan = decontaminate.keep_clean(docs, C.table(spark, SF_MID, "benchmark"))._jdf.queryExecution().optimizedPlan().toString()
    arms = plan.split("Union")[1]
    assert arms.index("LeftAnti") > 0 and arms.count("size(__scan") >= 2


def test_personal_data_stage(spark, docs):
    got = {(r.doc_id, r.text) for r in corpus_pipeline.personal_data(spark, docs, SF_MID).select("doc_id", "text").collect()}
    spans = {}
    for r in pii.spans(docs, ["doc_id", "text"]).collect():
        spans[r.doc_id, r.text] = list(r["__spans"])
    assert len(got) == len(spans) and any(spans.values())
    left = {(i, t) for (i, t), s in spans.items() if not s}
    assert left <= got and not {k for k, s in spans.items() if s} & got


def test_mixture_stage(spark, docs):
    got = corpus_pipeline.mixture(spark, docs, SF_MID).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows) + 1
    assert {r.doc_size for r in got} == {"clash"}


@pytest.fixture(scope="module")
def many_shards(spark, tmp_path_factory):
    table = C.table(spark, SF_MID, "documents")
    return table, written(mixing.mixed(table, table.columns, block_words=2000, shard_blocks=8), tmp_path_factory)


def test_tree_splits_without_changing_what_is_taken(many_shards):
    table, mix = many_shards
    rows, one = mix.collect(), mixing.mixed(table, ["doc_id"], block_words=2000, shard_blocks=10**9)
    assert len({d.shard for r in rows for d in r.draws}) > 20
    assert sorted((r.doc_id, r.taken, len(r.draws)) for r in rows) == sorted((r.doc_id, r.taken, len(r.draws)) for r in one.collect())
    assert all(r.taken == r["size"] * len(r.draws) and len({d.copy for d in r.draws}) == len(r.draws) for r in rows)


def test_shards_share_blocks_evenly(many_shards):
    """Blocks of every source, exact in number, eight to a shard."""
    quotas = [40, 7, 100, 1]
    shards = -(-sum(quotas) // 8)
    starts, counts = zip(*(mixing.leaf(mixing.np.array(quotas), shards, i) for i in range(shards)))
    assert sum(counts).tolist() == quotas and {int(c.sum()) for c in counts} <= {7, 8}
    for s, q in enumerate(quotas):
        units = sorted(u for a, c in zip(starts, counts) for u in range(a[s], a[s] + c[s]))
        assert units == list(range(q))


def test_shard_output(many_shards):
    table, mix = many_shards
    out = mixing.shards(mix).withColumn("part", F.spark_partition_id()).select("doc_id", "shard", "part").collect()
    want = Counter((r.doc_id, d.shard) for r in mix.collect() for d in r.draws)
    assert Counter((r.doc_id, r.shard) for r in out) == want
    assert all(n == 1 for n in Counter(s for s, _ in {(r.shard, r.part) for r in out}).values())


def test_prefix_sums_cross_runs_of_buckets(spark, monkeypatch):
    """Small buckets and runs give the same line of documents, in another order: whole targets, exact sums."""
    table = C.table(spark, SF_MID, "documents")
    monkeypatch.setattr(mixing, "BUCKET", 5)
    rows = mixing.mixed(table, ["doc_id", "source"], block_words=2000).collect()
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
