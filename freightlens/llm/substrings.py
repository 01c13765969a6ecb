"""Operator 10: substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text (16 bits, so it knows the last 16
bytes); a position where its top ``CUT_BITS`` bits are zero ends a chunk, if no
other such position lies within ``APART`` bytes before it and no character would
be cut.  All of that is local, so insertions move boundaries only near them, and
texts that share a passage share its inner chunks.  A chunk beyond ``MOST`` bytes,
as in a word repeated over and over, is cut where the hash is the largest of the last
``LOOK`` bytes, so at the same place of each repetition.  Chunks are deduplicated by
a 64-bit digest of ``NEXT`` neighbouring chunks, so what counts as shared stands
as a whole in one other document: the first document that has one keeps it (and the first place
within it), later ones are cut.  A run is repeated if its digests, one from each
chunk on, occur in other documents, and if the passage can have ``MIN_WORDS`` words:
with the chunk before and the chunk after it, which the passage ends in.

Digests are counted alone (partial aggregates first), so one that a
third of the documents share costs one row per task; what goes back to the
documents are the shared digests, per document.

Edge cases: null and empty texts have no chunks; documents that repeat as whole
rows share all chunks, whatever their doc_id; a passage that repeats only inside
its own document is cut but not ``repeats``; an empty table gives an empty
result.  "First" is by a hash of the whole row, so it doesn't follow the order in
which rows are read; of equal rows any one is first.  Only ``text`` is searched; other
columns pass through (maps and variants, which have no hash, don't order rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

CUT_BITS, APART, MOST, LOOK, NEXT, MIN_WORDS = 4, 8, 96, 16, 3, 50
#: A random number per byte, by rule.
GEAR = (C.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)

CHUNKS = T.StructType([T.StructField("digests", T.ArrayType(T.LongType())), T.StructField("chars", T.ArrayType(T.IntegerType())),
                       T.StructField("words", T.ArrayType(T.IntegerType()))])


def gear(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[byte i back] << i, within a text."""
    h = GEAR[buf]
    for m in (1, 2, 4, 8):
        more = np.zeros_like(h)
        more[m:] = h[:-m] << np.uint16(m)
        first = offs[:-1]
        for k in range(m):
            at = first + k
            more[at[at < np.minimum(offs[1:], len(buf))]] = 0
        h = h + more
    return h


def boundaries(buf: np.ndarray, offs: np.ndarray, bits: int = CUT_BITS, apart: int = APART, most: int = MOST) -> np.ndarray:
    """Ends (exclusive) of the chunks of all texts of a buffer, in order."""
    if not len(buf):
        return np.zeros(0, np.int64)
    h = gear(buf, offs)
    whole = np.append((buf[1:] & 0xC0) != 0x80, True)  # no character is cut after this byte
    texts = offs[:-1][offs[:-1] < offs[1:]]
    at = np.flatnonzero(h >> np.uint16(16 - bits) == 0) + 1
    gap = np.diff(at, prepend=-apart)
    row = np.searchsorted(texts, at - 1, side="right")
    same = np.diff(row, prepend=0) == 0
    at = at[(gap >= apart) | ~same]
    ends = np.union1d(at[whole[at - 1]], offs[1:][offs[1:] > 0])
    starts = np.concatenate([[0], ends[:-1]])
    wide = ends - starts > most
    extra = [_peaks(h[s:e], whole[s:e]) + s for s, e in zip(starts[wide], ends[wide])]
    return np.union1d(ends, np.concatenate(extra)) if extra else ends


def _peaks(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where to cut a stretch without boundaries."""
    top = np.lib.stride_tricks.sliding_window_view(h, LOOK).max(axis=1)
    return np.flatnonzero((h[LOOK - 1:] == top) & whole[LOOK - 1:]) + LOOK


def chunks_of(text: pa.Array):
    """Per step of a column: (row, digest from it on, characters, words) of each chunk, the
    number of rows, and whether the digest counts (``NEXT`` chunks, or all of a shorter text)."""
    for a, b, buf, offs in C.steps(text):
        ends = boundaries(buf, offs)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        row = np.searchsorted(offs, starts, side="right") - 1
        row_first = np.searchsorted(row, np.arange(b - a + 1))
        whole = np.minimum(np.arange(len(row)) + NEXT, row_first[row + 1]) - 1
        digest = C.word_hashes(buf, starts, ends[whole])
        kept = (np.arange(len(row)) + NEXT <= row_first[row + 1]) | (starts == offs[row])
        chars, words = np.zeros(len(buf) + 1, np.int64), np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        first = np.zeros(len(buf), bool)
        first[C.word_ranges(buf, offs)[0]] = True
        np.cumsum(first, out=words[1:])
        yield row, digest.view(np.int64), chars[ends] - chars[starts], words[ends] - words[starts], b - a, kept


@F.arrow_udf(CHUNKS)
def chunks(text: pa.Array) -> pa.Array:
    parts = list(chunks_of(text))

    def lists(i, t, some):
        counts = [np.bincount(p[0][some(p)], minlength=p[4]) for p in parts]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts) if parts else [])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[i][some(p)] for p in parts]) if parts else [], t))

    every = slice(None)
    return pa.StructArray.from_arrays(
        [lists(1, pa.int64(), lambda p: p[5]), lists(2, pa.int32(), lambda p: every), lists(3, pa.int32(), lambda p: every)],
        names=["digests", "chars", "words"])


REPEATS = T.StructType([
    T.StructField("n_chunks", T.LongType()), T.StructField("n_shared_chunks", T.LongType()), T.StructField("n_cut_chunks", T.LongType()),
    T.StructField("repeat_words", T.LongType()), T.StructField("longest_words", T.LongType()),
    T.StructField("repeated", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("cut", T.ArrayType(T.ArrayType(T.IntegerType())))])


def _runs(mark: np.ndarray, chars: np.ndarray, words: np.ndarray):
    """(from, to, words) in code points of the runs of marked digests whose passage
    can have ``MIN_WORDS`` words."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    last = np.minimum(np.flatnonzero(edge == -1) + NEXT - 1, len(chars))
    at, w = np.concatenate([[0], np.cumsum(chars)]), np.concatenate([[0], np.cumsum(words)])
    outer = w[np.minimum(last + 1, len(chars))] - w[np.maximum(first - 1, 0)]
    out: list[tuple[int, int, int]] = []
    for f, t in zip(first[outer >= MIN_WORDS], last[outer >= MIN_WORDS]):
        if out and at[f] < out[-1][1]:  # runs of digests a chunk apart share chunks
            a, b, n = out.pop()
            f, n = int(np.searchsorted(at, a)), 0
        out.append((int(at[f]), int(at[t]), int(w[t] - w[f])))
    return out


@F.arrow_udf(REPEATS)
def repeats(digests: pa.Array, chars: pa.Array, words: pa.Array, shared: pa.Array, owned: pa.Array) -> pa.Array:
    out = []
    for d, c, w, s, o in zip(digests, chars, words, shared, owned):
        d, c, w = (np.array(x.as_py() or [], np.int64) for x in (d, c, w))
        s, o = np.array(s.as_py() or [], np.int64), np.array(o.as_py() or [], np.int64)
        common = np.isin(d, s)
        again = np.ones(len(d), bool)
        again[np.unique(d, return_index=True)[1]] = False
        cut = (common & ~np.isin(d, o)) | again
        found = _runs(common, c, w)
        out.append({"n_chunks": len(c), "n_shared_chunks": int(common.sum()), "n_cut_chunks": int(cut.sum()),
                    "repeat_words": sum(x[2] for x in found), "longest_words": max((x[2] for x in found), default=0),
                    "repeated": [list(x[:2]) for x in found], "cut": [list(x[:2]) for x in _runs(cut, c, w)]})
    spans = pa.list_(pa.list_(pa.int32()))
    return pa.array(out, pa.struct([(f.name, spans if f.name in ("repeated", "cut") else pa.int64()) for f in REPEATS]))


def found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row and a struct ``__repeats``."""
    C.small_batches(docs)
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = C.saved(docs.withColumn("__chunks", chunks("text")).withColumn("__order", F.xxhash64(*(F.col(f"`{c}`") for c in plain)))
                   .select(*keep, "__chunks", "__order").withColumn("__uid", F.monotonically_increasing_id()), "chunks")
    each = rows.select("__uid", "__order", F.explode(F.array_distinct("__chunks.digests")).alias("digest"))
    shared = C.saved(each.groupBy("digest").agg(F.count("*").alias("n"), F.min_by("__uid", "__order").alias("low")).where("n > 1").select("digest", "low"), "shared-chunks")
    back = each.join(shared, "digest").groupBy("__uid").agg(
        F.collect_list("digest").alias("shared"), F.collect_list(F.when(F.col("low") == F.col("__uid"), F.col("digest"))).alias("owned"))
    return rows.join(back, "__uid", "left").withColumn(
        "__repeats", repeats("__chunks.digests", "__chunks.chars", "__chunks.words", "shared", "owned")).select(*keep, "__repeats")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of all texts but the first that has them."""
    gone = F.aggregate(
        "__repeats.cut", F.struct(F.lit(0).alias("to"), F.lit("").alias("out")),
        lambda acc, x: F.struct(x[1].alias("to"), F.concat(acc["out"], F.substring(F.col("text"), acc["to"] + 1, x[0] - acc["to"])).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["to"] + 1, F.length("text"))))
    out = found(docs, docs.columns)
    return out.withColumn("__text", F.when(F.size("__repeats.cut") > 0, gone).otherwise(F.col("text"))).select(
        *(F.col("__text").alias(c) if c == "text" else F.col(c) for c in docs.columns))


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chunks, n_shared_chunks, n_cut_chunks, repeat_words,
    longest_words, repeats, spans (from:to of repeated passages, in code points)."""
    rows = found(C.table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        "doc_id", *(f"__repeats.{c}" for c in ("n_chunks", "n_shared_chunks", "n_cut_chunks", "repeat_words", "longest_words")),
        (F.col("__repeats.longest_words") > 0).alias("repeats"),
        F.array_join(F.transform("__repeats.repeated", lambda x: F.array_join(x.cast("array<string>"), ":")), ",").alias("spans"))
