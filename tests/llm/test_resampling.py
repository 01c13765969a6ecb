"""Interning and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from freightlens.llm import interning, resampling
from tests.oracle_compare import compare_frames

TEXTS = [("A b, a-B", 1), (None, 2), ("", 3), (" .. ", 4), ("é É 日本 " * 30, 5), ("the law of the land " * 6, 6), ("the law of the land " * 6, 6),
         ("w" * 700 + " " + "w" * 700 + "x", 8), ("other words stand here " * 20_000, 9), ("number %d " * 30, 7), ("repeat " * 40, None), ("x y z " * 9, 11)]
ITEMS = ["The law of the land", None, "", "é number repeat"]


def strings(rnd):
    return [bytes(rnd.randrange(97, 100) for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 31, 32, 33, 40, 64, 100, 300]))) for _ in range(2000)]


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_interning_verifies_bytes(bits):
    words = strings(random.Random(bits))[:2000 if bits == 64 else 200]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    keys = interning.xxhash64(buf, starts, ends)
    assert keys.tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    # few or no bits of the key left: nearly all strings collide and only bytes tell them apart
    slot, owner = interning.intern(buf, starts, ends, keys & np.uint64((1 << bits) - 1))
    held = {}
    for w, s in zip(words, slot.tolist()):
        assert held.setdefault(w, s) == s
    assert len(set(held.values())) == len(held) == int((owner >= 0).sum())


def test_interning_of_nothing():
    none = np.zeros(0, np.int64)
    slot, owner = interning.intern(np.zeros(0, np.uint8), none, none)
    assert len(slot) == 0 and (owner == -1).all()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(text, sizes):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]


def brute(docs, items, sizes, buckets, share):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in grams(x, sizes)) for texts in ([x for x, _ in docs], items))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + float(buckets)) / ((s[b] + 1.0) * (nt + float(buckets)))))
    rows = []
    for text, i in docs:
        f = grams(text, sizes)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:share * len(able) // 100]):
        r[4] = k + 1
    return sorted(str(r[:5]) for r in rows)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "clash", 0.5) for t, i in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, score string, weight double").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(k, x) for k, x in enumerate(ITEMS)], "item_id long, text string")


@pytest.mark.parametrize("sizes, buckets, share", [((1, 1), 10_000, 10), ((1, 2), 50, 50), ((2, 4), 997, 100)])
def test_resampled(docs, items, sizes, buckets, share):
    got = resampling.resampled(docs, items, sizes, buckets, share_pct=share)
    assert sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in got.collect()) == brute(TEXTS, ITEMS, sizes, buckets, share)


def test_empty_tables(docs, items):
    assert resampling.resampled(docs.limit(0), items).count() == 0
    got = resampling.resampled(docs, items.limit(0)).collect()
    assert sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in got) == brute(TEXTS, [], (1, 1), 10_000, 10)


def test_drawn_documents(spark, docs, items):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ranks = resampling.resampled(some, items, share_pct=50)
    assert {r.doc_id for r in resampling.drawn_documents(some, ranks).collect()} == {r.doc_id for r in ranks.where("rank is not null").collect()}


def test_edge_sql(spark, docs, items):
    duck = duckdb.connect()
    duck.register("documents", docs.where("doc_id is not null").toArrow())
    duck.register("benchmark", items.toArrow())
    assert compare_frames(resampling.resampled(docs.where("doc_id is not null"), items), duck, resampling.SQL) is None
