"""Operator 1: toxicity from subword-bag embeddings averaged into a linear softmax.

A word's bag is its own hash and the hashes of its character n-grams (3 to 5,
with its edges marked), in ``BUCKETS`` shared embedding rows, so a misspelling
shares most of its vectors with the word it comes from.  A bag is averaged
(over ``SEGMENT`` words; over longer segments a few words drown and held-out
accuracy falls) and a linear softmax scores the average; a text scores as its
most toxic segment, whatever its length.  Embeddings and softmax are trained
jointly in numpy (damped Adagrad on mini-batches, segments weighted more and
more towards the text's worst; buckets that fewer than ``MIN_DOCS`` documents
have stay out), on a bounded sample: up to ``SAMPLE`` labelled documents of each class with the
smallest hashes of doc_id.  Of a text beyond ``SAMPLE_CHARS`` characters, windows
of ``WINDOW_CHARS`` spread evenly from its first to its last character are learnt
from, ``SAMPLE_CHARS`` in all; scoring reads whole texts.  The classes' shares
among all usable labels set the prior.  Since the model is linear,
scoring needs one weight per bucket: 4 * ``BUCKETS`` bytes go to the executors.

Labels of rows whose crc32(doc_id as text) mod 5 is 0 are never read; labels,
lang, source and doc_id are no inputs of a score.

Edge cases: null, empty and wordless texts score the prior (the share of label
1); so do all texts if a class has no labelled document, with 0 if there are no
labels; labels other than 0 and 1, and labels without a document, are ignored;
rows are scored one by one, so repeated rows get equal scores; held_out is
false for a null doc_id.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS, DIM, GRAMS, SEGMENT = 1 << 17, 8, (3, 4, 5), 1
SAMPLE, SAMPLE_CHARS, WINDOW_CHARS = 2000, 20_000, 1_000
EPOCHS, BATCH, RATE, FOCUS, DAMP, MIN_DOCS, SEED = 8, 128, 0.4, 0.5, 1e-6, 5, 7
_GAP = 32


def _is_word(points: np.ndarray) -> np.ndarray:
    digit = (points >= 48) & (points <= 57)
    lower = (points >= 97) & (points <= 122)
    return digit | lower | (points >= 0xC0)


def bags(texts: list[str]):
    """(row of each word, word, bucket): all texts' words in order, and the buckets of
    each word and of its n-grams."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    inside = _is_word(points)
    c = np.where(inside, points, _GAP).astype(np.uint64)
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(np.cumsum(sizes), starts, side="right") if len(texts) else starts
    index = np.cumsum(edge == 1) - 1  # the word that a character is in
    words_of, hashes_of = [np.arange(len(starts))], [_word_hashes(c, starts, ends)]
    h = c.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * C._P + c[n - 1:]
        if n not in GRAMS:
            continue
        m = len(c) - n + 1
        # gaps only at the first or last place
        ok = inside[1:1 + m].copy()
        for k in range(2, n - 1):
            ok &= inside[k:k + m]
        at = np.flatnonzero(ok)
        words_of.append(index[at + 1])
        hashes_of.append(C.mix(h[at] + np.uint64(n)))
    word, hashes = np.concatenate(words_of), np.concatenate(hashes_of)
    return row, word, (hashes >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int64)


def _word_hashes(c, starts, ends):
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + C.PIECE_BYTES, side="right")))
        lo, hi = starts[a], ends[b - 1]
        out[a:b] = C.ranges_hash(c[lo:hi], starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return out


def segments(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each word, row of each segment)."""
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    per = -(-count // SEGMENT)
    base = np.cumsum(per) - per
    return base[row] + (np.arange(len(row)) - first[row]) // SEGMENT, np.repeat(np.arange(n), per)


def train(texts: list[str], labels: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of the toxic class against the other."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    top = rng.normal(0, 1 / DIM, (DIM, 2))
    bias = np.zeros(2)
    found = np.zeros(BUCKETS, np.int64)  # documents that have a bucket
    for a in range(0, len(texts), BATCH):
        row, word, bucket = bags(texts[a:a + BATCH])
        found += np.bincount(np.unique(row[word] * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
    live = found >= MIN_DOCS
    table[~live] = 0
    sums = [np.full((BUCKETS, 1), DAMP), DAMP, DAMP]
    order = np.arange(len(texts))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for a in range(0, len(order), BATCH):
            pick = order[a:a + BATCH]
            row, word, bucket = bags([texts[i] for i in pick])
            if not len(row):
                continue
            seg, of = segments(row, len(pick))
            used, local = np.unique(bucket, return_inverse=True)
            share = (1 / np.bincount(word, minlength=len(row)))[word] * (1 / np.bincount(seg))[seg][word]
            cell = seg[word]
            mean = np.stack([np.bincount(cell, share * table[used, d][local], len(of)) for d in range(DIM)], 1)
            logits = mean @ top + bias
            margin = logits[:, 1] - logits[:, 0]
            worst = np.full(len(pick), -np.inf)
            np.maximum.at(worst, of, margin)
            focus = np.exp(FOCUS * (1 + epoch) * (margin - worst[of]))
            focus /= np.bincount(of, focus, len(pick))[of]
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            g = focus * (p - labels[pick][of]) / len(pick)
            two = np.stack([-g, g], 1)
            g_mean = two @ top.T
            g_table = np.stack([np.bincount(local, share * g_mean[cell, d], len(used)) for d in range(DIM)], 1) * live[used][:, None]
            g_top, g_bias = mean.T @ two, two.sum(0)
            sums[0][used] += (g_table**2).mean(1, keepdims=True)
            table[used] -= RATE * g_table / np.sqrt(sums[0][used])
            sums[1] += (g_top**2).mean()
            top -= 0.1 * RATE * g_top / np.sqrt(sums[1])
            sums[2] += (g_bias**2).mean()
            bias -= 0.1 * RATE * g_bias / np.sqrt(sums[2])
    share1 = labels.mean()
    shift = math.log(prior / (1 - prior)) - math.log(share1 / (1 - share1))
    return (table @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift)


def windows(text: F.Column) -> F.Column:
    """The text, or its windows if it is long, with a blank between them."""
    count = SAMPLE_CHARS // WINDOW_CHARS
    room = F.length(text) - WINDOW_CHARS
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.substring(
        text, F.floor(k.cast("long") * room / (count - 1)).cast("int") + 1, F.lit(WINDOW_CHARS)))
    return F.when(F.length(text) > SAMPLE_CHARS, F.array_join(spread, " ")).otherwise(text)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of the training sample, and the share of label 1 among all
    labels that may be learnt from."""
    usable = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % 5 != 0)))
    share = usable.agg(F.avg("toxic").alias("p")).first()["p"]
    ids = [usable.where(F.col("toxic") == k).groupBy("id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE) for k in (0, 1)]
    chosen = C.saved(ids[0].unionByName(ids[1]), "toxic-sample")  # at most 2 * SAMPLE rows
    rows = (docs.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("text").isNotNull())
            .select("doc_id", windows(F.col("text")).alias("text"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
            .groupBy("id", "toxic").agg(F.min("text").alias("text")).orderBy("id", "toxic").toArrow())
    return rows["text"].to_pylist(), rows["toxic"].to_numpy().astype(float), float(share or 0.0)


def score(docs: DataFrame, weights: np.ndarray | None, bias: float, prior: float) -> DataFrame:
    """``docs`` with a column ``score``."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        w, out = model.value, np.full(len(text), prior)
        if w is not None:
            for a, b, _, _ in C.steps(text):
                row, word, bucket = bags([x or "" for x in text[a:b].to_pylist()])
                if not len(row):
                    continue
                of_word = np.bincount(word, w[bucket], len(row)) / np.bincount(word, minlength=len(row))
                seg, of = segments(row, b - a)
                margin = np.bincount(seg, of_word) / np.bincount(seg) + bias
                worst = np.full(b - a, -np.inf)
                np.maximum.at(worst, of, margin)
                some = np.flatnonzero(np.isfinite(worst))
                out[a + some] = 1 / (1 + np.exp(-np.clip(worst[some], -700, 700)))
        return pa.array(out)

    C.small_batches(docs)
    return docs.withColumn("score", scored("text"))


def op1_subword_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    texts, y, prior = sample(docs, C.table(spark, sf_dir, "labels"))
    weights, bias = train(texts, y, prior) if 0 < y.sum() < len(y) else (None, 0.0)
    return score(docs, weights, bias, prior).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
