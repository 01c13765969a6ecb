"""Operator 10 against brute force: what it flags, its spans and what it cuts."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from freightlens.llm import substrings
from tests.conftest import SF_MID


def _windows(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def _sharing(texts, size):
    """Keys of the texts that share ``size`` words in a row with another one."""
    holders = defaultdict(set)
    for k, t in texts.items():
        for w in _windows(t, size):
            holders[w].add(k)
    return {k for v in holders.values() if len(v) > 1 for k in v}


def test_flags_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    flagged = {r.doc_id for r in substrings.found(docs, ["doc_id"]).where("__repeats.longest_words > 0").collect()}
    assert _sharing(texts, 51) <= flagged <= _sharing(texts, 30)
    clean = set(texts) - _sharing(texts, 51)
    assert len(clean - flagged) >= 0.98 * len(clean)


@pytest.fixture(scope="module")
def planted(spark):
    """Passages of 60 words in texts of their own words: shared, repeated words, pieced
    together from 12 others, short, alone."""
    rnd = random.Random(5)
    fresh = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 9))) for _ in range(n))
    shared, pieces = fresh(60), [fresh(12) for _ in range(12)]
    rows = [(f"shared{i}", f"{fresh(70 + i)} {shared} {fresh(50)}") for i in range(3)]
    rows += [(f"again{i}", f"{fresh(31 + i)} {'as ' * (70 + i)}{fresh(9)}") for i in range(3)]
    rows += [(f"piece{i}", f"{fresh(40)} {p} {fresh(40)}") for i, p in enumerate(pieces)]
    rows += [("patchwork", " ".join(pieces)), ("alone", fresh(300)), ("null", None), ("empty", ""), ("white", " \n "), ("short", "a b")]
    rows += [("long", f"{fresh(150_000)} {shared}"), ("copy", fresh(80))]
    return shared, spark.createDataFrame([*rows, rows[-1], ("twice", f"{rows[-1][1]} é {rows[-1][1]}")], "name string, text string")


def test_planted_passages(planted):
    shared, docs = planted
    rows = substrings.found(docs.withColumn("digest", docs.name).withColumn("low", docs.name), ["name", "text", "digest"]).collect()
    assert len(rows) == docs.count()
    flagged = {r.name for r in rows if r["__repeats"].longest_words}
    assert flagged == {"shared0", "shared1", "shared2", "again0", "again1", "again2", "long", "copy", "twice"}
    for r in rows:
        if r.name.startswith("shared") or r.name == "long":
            (span,) = r["__repeats"].repeated
            at = r.text.index(shared)
            assert at - 12 <= span[0] <= at + 150 and at + len(shared) - 150 <= span[1] <= at + len(shared)


def test_first_is_of_the_data(planted):
    _, docs = planted
    result = lambda df: sorted(((r.name, r.text or "") for r in substrings.without_repeats(df).collect()))
    want = result(docs.coalesce(1))
    assert result(docs.repartition(7)) == want == result(docs.orderBy("text").repartition(3))
    assert sum(planted[0][200:260] in t for _, t in want) == 1
    kept = {n: t for n, t in docs.collect() if not n.startswith(("shared", "again", "long", "copy", "twice"))}
    assert {n: t for n, t in want if n in kept} == {n: t or "" for n, t in kept.items()}
