"""Operator 12: target-distribution importance resampling over hashed n-grams.

A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of whole
texts.  Features are all runs of ``SIZES`` words joined by one space, repeats
counted; a feature's bucket is the crc32 of its bytes modulo ``BUCKETS``.  The
counts of all buckets over all documents (the source) and all target texts give
each bucket's gain, and a document's weight is the floored mean of its features'
gains.  A Gumbel key from the doc_id turns the weight into a score, and the
highest scores of documents with enough words are drawn.

Per Arrow batch, n-grams are interned in an open-addressed table (``interning``:
xxhash64 keys, bytes verified); each used slot stores its bucket and count.  The
first pass adds the counts up by bucket, so a task sends ``BUCKETS`` rows at
most; the second one gathers gains by the occurrences' slot ids.  The gains are
``BUCKETS`` numbers at any size of the corpus.  Places come from a range sort of
narrow rows; texts are never shuffled.

Edge cases: null, empty and wordless texts have no features, weight 0, and are
never drawn; a null doc_id hashes like the empty string and ties after all
others; rows that repeat a doc_id are rows of their own; without documents the
result is empty, without target texts all gains come from smoothing alone.  Only
``doc_id`` and ``text`` are read, so other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import with_place
from . import common as C
from .decontaminate import SEPARATORS
from .interning import intern

SIZES, BUCKETS, SEED = (1, 1), 10_000, 2024
MIN_WORDS, SHARE_PCT = 20, 10

MEASURES = T.StructType([T.StructField(k, T.LongType()) for k in ("n_words", "n_features", "weight")])


class Grams:
    """The n-grams of a run of texts: ``slot`` of each occurrence, its text in
    ``row``, and per slot of the table ``bucket`` and ``count``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, sizes: tuple[int, int], buckets: int):
        starts, ends, row = C.word_ranges(buf, offs, SEPARATORS)
        low = C.lower_table()[buf]
        self.words = C.counts_of(row, len(offs) - 1)
        if sizes[1] > 1:
            low, starts, ends = _spaced(low, starts, ends)
        first, last, of = [], [], []
        for n in range(sizes[0], sizes[1] + 1):
            at = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
            first.append(starts[at])
            last.append(ends[at + n - 1])
            of.append(row[at])
        first, last, self.row = np.concatenate(first), np.concatenate(last), np.concatenate(of)
        self.slot, owner = intern(low, first, last)
        used = np.flatnonzero(owner >= 0)
        raw = low.tobytes()
        self.bucket = np.full(len(owner), -1, np.int64)
        self.bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(first[owner[used]].tolist(), last[owner[used]].tolist())]
        self.count = np.bincount(self.slot, minlength=len(owner))

    def totals(self, buckets: int) -> np.ndarray:
        used = self.count > 0
        return np.bincount(self.bucket[used], weights=self.count[used], minlength=buckets).astype(np.int64)

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, floored mean of their gains) of each text."""
        n = len(self.words)
        gain = gains[self.bucket][self.slot]
        features = C.counts_of(self.row, n)
        total = np.zeros(n, np.int64)
        np.add.at(total, self.row, gain)
        return features, np.where(features > 0, total // np.maximum(features, 1), 0)


def _spaced(buf, starts, ends):
    """The words on end, each followed by one space: a run of words is a range."""
    size = ends - starts + 1
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    inside = np.repeat(starts - to, ends - starts)
    at = np.arange(int((ends - starts).sum())) + np.repeat(np.arange(len(starts)), ends - starts)
    out[at] = buf[at + inside]
    return out, to, to + size - 1


def bucket_counts(texts: DataFrame, sizes=SIZES, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of features in all texts; at most ``buckets`` rows."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offs in C.steps(batch.column("text")):
                total += Grams(buf, offs, sizes, buckets).totals(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    each = C.small_batches(texts.select("text")).mapInArrow(work, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.float64)
    for r in counts.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b = float(len(source))
    return np.floor(1000.0 * np.log((target + 1.0) * (source.sum() + b) / ((source + 1.0) * (target.sum() + b)))).astype(np.int64)


def weighed(docs: DataFrame, name: str, gains: np.ndarray, sizes=SIZES) -> DataFrame:
    """``docs`` and a struct column ``name``: n_words, n_features, weight."""

    @F.arrow_udf(MEASURES)
    def measures(text: pa.Array) -> pa.Array:
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for _, _, buf, offs in C.steps(text):
            grams = Grams(buf, offs, sizes, len(gains))
            for column, values in zip(out, (grams.words, *grams.weights(gains))):
                column.append(values)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["n_words", "n_features", "weight"])

    C.small_batches(docs)
    return docs.withColumn(name, measures("text"))


def resampled(docs: DataFrame, target: DataFrame, sizes=SIZES, buckets: int = BUCKETS, seed: int = SEED,
              min_words: int = MIN_WORDS, share_pct: int = SHARE_PCT) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null if undrawn)."""
    gains = gains_of(_dense(bucket_counts(docs, sizes, buckets), buckets), _dense(bucket_counts(target, sizes, buckets), buckets))
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.ln(-F.ln((key.cast("double") + 0.5) / 4294967296.0))).cast("long")
    scored = C.saved(weighed(docs.select("doc_id", "text"), "__w", gains, sizes).select(
        "doc_id", "__w.n_features", "__w.weight", (F.col("__w.weight") + gumbel).alias("score"), "__w.n_words"), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = with_place(scored.where(F.col("n_words") >= min_words), order, "place", save=lambda df: C.saved(df, "by-score"))
    drawn = share_pct * ranked.count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(
        scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were drawn; doc_ids must be distinct."""
    return docs.join(ranks.where("rank is not null").select("doc_id"), "doc_id", "left_semi")


def op12_interned_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    return resampled(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 of a string in DuckDB: its table from the polynomial, then a fold over the bytes.
CRC_TABLE = ("crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
             "lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) r(i)))")


def crc_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of a string column, with CRC_TABLE's ``crc`` (one row) in FROM."""
    digits = f"hex(encode({text}))"
    each = f"list_transform(range(0, length({digits}) // 2), lambda k: (instr('0123456789ABCDEF', substr({digits}, 2 * k + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({digits}, 2 * k + 2, 1)) - 1)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT uid, unnest(w) AS f FROM d),
bw AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
bucket AS (SELECT f, {crc_sql('f')} % {BUCKETS} AS b FROM (SELECT f FROM dw UNION SELECT f FROM bw), crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN bucket USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE
                / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
         FROM (SELECT DISTINCT b FROM bucket) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
m AS (SELECT uid, count(*) AS k, sum(gain) AS g FROM dw JOIN bucket USING (f) JOIN gain USING (b) GROUP BY uid),
w AS (SELECT doc_id, len(w) AS n_words, coalesce(k, 0) AS n_features,
             CAST(coalesce((g - ((g % k) + k) % k) // k, 0) AS BIGINT) AS weight,
             CAST(('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8)) AS BIGINT) AS h
      FROM d LEFT JOIN m USING (uid)),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place FROM x)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_words >= {MIN_WORDS} AND place <= (SELECT count(*) FROM x WHERE n_words >= {MIN_WORDS}) * {SHARE_PCT} // 100 THEN place END AS rank
FROM r
"""
