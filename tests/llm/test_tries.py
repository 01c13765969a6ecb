"""The burst trie against SQL, at container sizes that burst everywhere or nowhere."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from freightlens.llm import common as C
from freightlens.llm import tries
from tests.conftest import SF_MID
from tests.oracle_compare import compare_frames


def duck(conversations):
    con = duckdb.connect()
    con.register("conversations", conversations.toArrow())
    return con


@pytest.fixture(scope="module", params=[0, 1])
def odd(spark, request):
    """Copies, null and empty roles and texts, ties and null turns, repeated rows, no base, clashing columns."""
    rnd, rows = random.Random(request.param), []
    for c in [*range(40), 100, 105, 200, 201, 202, 203, 307, 309, 310, 311, 312, -5, -105, -100]:
        turns = [("u", "same"), ("a", "é same"), ("u", "3"), ("a", "4"), ("u", "5"), ("a", "6"), ("u", "7")][:rnd.choice([1, 7, 7])]
        if c % 7 > 2:
            turns = [(rnd.choice(["u", None, "a"]), rnd.choice(["x", "y", "z", None, ""])) for _ in range(rnd.randint(1, 9))]
        for i, (role, text) in enumerate(turns):
            rows.append((c, None if rnd.random() < 0.1 else i if request.param else rnd.randint(0, 3), role, text, "clash", c))
    rows += [(None, 1, "u", "t", "q", 1)] * 3 + [rows[0]] * 2
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, d string, seq int").repartition(5)


@pytest.mark.parametrize("burst", [1, 3, 12, tries.BURST])
def test_any_container_size(odd, burst):
    assert compare_frames(tries.trie(*tries.rebuilt(odd), burst), duck(odd), tries.SQL) is None


@pytest.mark.parametrize("burst", [4, 60])
def test_bursting_on_a_table(spark, burst):
    table = C.table(spark, SF_MID, "conversations")
    assert compare_frames(tries.trie(*tries.rebuilt(table), burst), duck(table), tries.SQL) is None


def test_empty(odd):
    assert tries.trie(*tries.rebuilt(odd.limit(0))).count() == 0
    assert tries.trie(*tries.rebuilt(odd.where("conv_id is null"))).count() == 0


def test_long_conversation_and_copies(spark, monkeypatch):
    """A conversation longer than a chunk of the running sums, a copy of it, and many
    copies of another, whose ends take several blocks."""
    monkeypatch.setattr(tries, "CHUNK", 8)
    monkeypatch.setattr(tries, "BLOCK", 16)
    ids = [100 * c for c in range(1, 201)]  # their own base: turns stay as they are
    long_ = spark.range(100).select(F.explode(F.array(F.lit(7000000), F.lit(7000100))).alias("conv_id"), F.col("id").alias("turn"),
                                    F.lit("u").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    many = spark.createDataFrame([(c, t, "u", f"same {t}") for c in ids for t in range(3)], "conv_id long, turn long, role string, text string")
    table = long_.select(F.col("conv_id").cast("long"), "turn", "role", "text").unionByName(many)
    for burst in (2, 10, tries.BURST):
        got = tries.trie(*tries.rebuilt(table), burst)
        assert compare_frames(got, duck(table), tries.SQL) is None
    ends = {r.conv_id: r.ends_sha256 for r in got.where("depth = 3 and conv_id = 100").collect()}
    assert ends == {100: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}


def test_deep_shared_opening_takes_few_rounds(spark):
    """Sequences that share a long opening: each round bursts twice as many levels."""
    turns = [(c, d, "o" if d <= 40 else f"{c} {d}") for c in range(1, 31) for d in range(1, 46)]
    rows = spark.createDataFrame(turns, "conv long, d long, text string").select("conv", "d", F.unhex(F.md5("text")).alias("tid"), F.lit(1).cast("long").alias("chars"))
    convs = rows.groupBy("conv").agg(F.max("d").alias("len"))
    nodes = {(r.conv_id, r.depth): r for r in tries.trie(convs, rows, 20).collect()}
    assert len(nodes) == 1 + 40 + 30 * 5 and nodes[1, 40].n_children == nodes[1, 0].n_leaves == 30
    assert nodes[1, 0].saved_tokens == 29 * 40 and nodes[1, 39].saved_tokens == 29 * 2 and nodes[2, 41].parent_conv_id == 1
