"""Near-duplicate classes and passages of repeats against brute force on a table."""

import re
from collections import Counter

import pytest

from freightlens.llm import common as C
from freightlens.llm import near_dedup
from tests.conftest import SF_MID


def weighted(text):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(x, y):
    """Probability Jaccard, from its definition."""
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


@pytest.fixture(scope="module")
def brute(spark):
    rows = [(r.doc_id, weighted(r.text)) for r in C.table(spark, SF_MID, "documents").select("doc_id", "text").collect()]
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, w in rows:
        for shingle in w:
            holders.setdefault(shingle, []).append(i)
    by, pairs = dict(rows), set()
    for members in holders.values():
        pairs |= {(a, b) for k, a in enumerate(members) for b in members[:k]}
    links = 0
    for a, b in pairs:
        x, y = by[a], by[b]
        common = sum((x & y).values())
        if common and 1.25 * min(sum(x.values()), sum(y.values())) >= 0.8 * max(sum(x.values()), sum(y.values())) and similarity(x, y) >= 0.8 - 1e-9:
            links += 1
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    assert links > 50
    return {i: top(i) for i, _ in rows}


def test_classes_are_brute_force_ones(spark, brute):
    got = near_dedup.op4_prob_minhash(spark, SF_MID).collect()
    assert {r.doc_id: r.class_id for r in got} == brute
    sizes = Counter(brute.values())
    assert all(r.class_size == sizes[brute[r.doc_id]] for r in got)


def test_one_of_each_class_stays(spark, brute):
    kept = [r.doc_id for r in near_dedup.keep_one(C.table(spark, SF_MID, "documents")).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(brute.values()))


def test_few_tables_are_left(spark):
    C.release(spark)
    near_dedup.classes(C.table(spark, SF_MID, "documents"))
    assert len(C._tables(spark)) == 2  # the rows and the classes
    C.release(spark)
