"""Toxicity scores against a word-by-word version; edge cases; windows of long texts."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.llm import toxicity as X

TEXTS = [(1, "You UTTER fool, é9 go"), (2, None), (3, ""), (4, " .,; \n"), (5, "a"), (None, "a bb ccc"), (5, "a"),
         (6, "Straße ŁÓDŹ 東京 x_y z-1"), (7, "nice words only " * 20_000 + "fool"), (8, "q" * 70_000)]
BITS = 64 - int(math.log2(X.BUCKETS))
P = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1


def mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def buckets(word: str) -> list[int]:
    """The word itself, and its n-grams with the blanks around it."""
    points = [ord(c) for c in word]
    out = [mixed(sum((c + 1) * pow(P, k, 1 << 64) for k, c in enumerate(points)) + len(word) & FULL)]
    edged = [32, *points, 32]
    for n in X.GRAMS:
        for k in range(len(edged) - n + 1):
            h = 0
            for c in edged[k:k + n]:
                h = h * P + c & FULL
            out.append(mixed(h + n & FULL))
    return [x >> BITS for x in out]


def expected(text: str, weights: np.ndarray, bias: float, prior: float) -> float:
    kept = "".join(c if c.isascii() and c.isalnum() or ord(c) >= 0xC0 else " " for c in text.lower())
    margins = [float(np.mean(weights[buckets(w)].astype(float))) for w in set(kept.split(" ")) if w]
    return 1 / (1 + math.exp(-max(margins) - bias)) if margins else prior


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, 9, "clash", "en") for t in TEXTS], "doc_id long, text string, word long, id string, lang string").repartition(3)


def test_scores(docs):
    weights = np.random.default_rng(1).normal(0, 3, X.BUCKETS).astype(np.float32)
    got = {(r.doc_id, r.text): r.score for r in X.score(docs, weights, 0.3, 0.25).collect()}
    assert len(got) == len(set(TEXTS))
    for (key, text), score in got.items():
        if key != 8:  # a word of 70,000 letters: below
            assert score == pytest.approx(expected(text or "", weights, 0.3, 0.25), abs=1e-9)
    assert 0 < got[8, "q" * 70_000] < 1
    assert all(got[k, t] == 0.25 for k, t in TEXTS[1:4])


def test_without_labels(docs):
    assert {r.score for r in X.score(docs, None, 0.0, 0.4).collect()} == {0.4}
    none = docs.limit(0)
    assert X.score(none, None, 0.0, 0.4).count() == 0
    labels = docs.sparkSession.createDataFrame([(1, 2), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    texts, y, _ = X.sample(docs, labels)
    assert texts == [] and len(y) == 0
    assert X.sample(none, labels.limit(0))[2] == 0.0


def test_windows_of_long_texts(spark):
    size = X.SAMPLE_CHARS
    texts = ["", "a" * size, "".join(chr(0x4E00 + k % 9000) for k in range(size + 1)), "".join(chr(65 + k % 50) for k in range(400_000)), None]
    count = size // X.WINDOW_CHARS
    for text, r in zip(texts, spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
                       .select("k", X.windows(F.col("text")).alias("w")).orderBy("k").collect()):
        if text is None or len(text) <= size:
            assert r.w == text
            continue
        starts = [k * (len(text) - X.WINDOW_CHARS) // (count - 1) for k in range(count)]
        assert r.w == " ".join(text[a:a + X.WINDOW_CHARS] for a in starts) and r.w.endswith(text[-X.WINDOW_CHARS:])


def test_long_texts_are_learnt_from(spark):
    """No labelled row is passed over for its length."""
    rows = [(k, ("good text " if k % 2 else "vile text ") * (6_000 if k % 3 == 0 else 5)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(400)], "doc_id long, toxic int")
    texts, y, prior = X.sample(docs, labels)
    usable = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    assert len(texts) == len(y) and max(map(len, texts)) == X.SAMPLE_CHARS + X.SAMPLE_CHARS // X.WINDOW_CHARS - 1
    assert len(texts) == len(usable)
    weights, bias = X.train(texts, y, prior)
    got = {r.doc_id: r.score for r in X.score(docs, weights, bias, prior).collect()}
    assert all((got[k] >= 0.5) == (k % 2 == 0) for k in got)
