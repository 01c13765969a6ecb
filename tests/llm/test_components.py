"""Components of links found in turns, and similarities of whole blocks."""

import random

import numpy as np

from freightlens.llm import graph, near_dedup


def _components(links):
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in parent if top(n) != n}


def test_links_that_are_stars_take_no_step(spark, monkeypatch):
    monkeypatch.setattr(graph, "_star", None)
    got = graph.stars(spark.createDataFrame([(5, 1), (2, 1), (1, 5), (9, 7), (7, 7)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(5, 1), (2, 1), (9, 7)}
    assert got.count() == 3
    none = graph.stars(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_classes_joined_later_are_the_components_of_all_links(spark):
    rnd = random.Random(3)
    first = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)]
    later = [(rnd.randrange(0, 500), rnd.randrange(0, 500)) for _ in range(60)]
    cls = graph.stars(spark.createDataFrame(first, "a long, b long"))
    of = {r.node: r.cls for r in cls.collect()}
    assert of == _components(first)
    more = graph.stars(spark.createDataFrame([(of.get(a, a), of.get(b, b)) for a, b in later], "a long, b long"))
    rows = graph.merged(cls, more).collect()
    assert {r.node: r.cls for r in rows} == _components(first + later)
    assert len({r.node for r in rows}) == len(rows)


def test_similarities_of_blocks_are_those_of_pairs():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 2**63, 700).astype(np.uint64))
    side = lambda n, top: [np.sort(rng.choice(pool, rng.integers(1, top), replace=bool(k % 3 == 0))) for k in range(n)]
    x, y = side(30, 200), side(25, 200)
    pairs = np.array([(i, j) for i in range(30) for j in range(25)])
    got = near_dedup._jaccards(x, y, pairs, step=64)
    weigh = lambda h: tuple(v.astype(t) for v, t in zip(np.unique(h, return_counts=True), (np.uint64, np.float64)))
    want = [near_dedup.probability_jaccard(weigh(x[i]), weigh(y[j])) for i, j in pairs]
    assert np.allclose(got, want)


def test_large_blocks_are_compared_at_once(monkeypatch):
    # one look-up of all hashes, not a sort of the vocabulary for each text
    monkeypatch.setattr(np, "isin", None)
    pool = np.arange(1, 5000, dtype=np.uint64)
    x = [pool[k:k + 800] for k in range(200)]
    got = near_dedup._jaccards(x, x, np.array([(0, 0), (0, 100), (3, 199)]))
    assert np.allclose(got, [1, 700 / 900, 604 / 996])
