"""Operator 8: benchmark decontamination by a prefix-filtered set join.

A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window
is 10 consecutive words of an item, or all of a shorter one.  Its tokens are
its shingles of three words (fewer in windows of one or two).  A window is
contained only where all its shingles are, so a prefix of one shingle will do:
the rarest, by counts over all documents.  A document's occurrence of a prefix
shingle fixes where the window would start; windows that would leave the
document are dropped (position and length bounds), and the rest are verified
word by word.

Two bit maps of a fixed 2 MB (of all item shingles for the counts, of prefix
shingles for the join) go to the executors; they only spare shuffling shingles
that no item has, and the joins after them are exact.  Documents are read twice;
the query never shuffles texts, ``keep_clean`` those with a prefix shingle only.

Edge cases: null, empty and wordless texts have no words and are clean; an item
without words has no window; rows are judged one by one, so repeated rows get
equal results; items that repeat an item_id count once, items of a null id
mark words but aren't counted or named.  Without documents the result is
empty, without items all documents are clean.  Only ``text`` (and ``doc_id``
for the query) are read, other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, SHINGLE = 10, 3
BITS = 1 << 24
#: Bytes that aren't in words once A-Z are lower-cased.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_HIT = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("at", T.IntegerType()),
                     T.StructField("before", T.IntegerType()), T.StructField("near", T.StringType())])
SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_HIT))])


def _words(buf, offs):
    starts, ends, row = C.word_ranges(buf, offs, SEPARATORS)
    return starts, ends, row, C.word_hashes(buf, starts, ends, lower=True)


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, size, shingles) of each window of each item."""

    def work(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for a, b, buf, offs in C.steps(batch.column("text")):
                starts, ends, row, h = _words(buf, offs)
                low = C.lower_table()[buf]
                cut = np.searchsorted(row, np.arange(b - a + 1))
                out = {"item_id": [], "words": [], "size": [], "shingles": []}
                for i in range(b - a):
                    f, t = int(cut[i]), int(cut[i + 1])
                    texts = [low[starts[k]:ends[k]].tobytes().decode("utf-8", "replace") for k in range(f, t)]
                    size = min(window, t - f)
                    step = min(shingle, size)
                    every = C.windows_hash(h[f:t], np.zeros(t - f, np.int64), step)[1].view(np.int64) if size else []
                    for k in range(t - f - size + 1 if size else 0):
                        out["item_id"].append(ids[a + i].as_py())
                        out["words"].append(" ".join(texts[k:k + size]))
                        out["size"].append(size)
                        out["shingles"].append(every[k:k + size - step + 1].tolist())
                yield pa.RecordBatch.from_arrays([
                    pa.array(out["item_id"], ids.type), pa.array(out["words"], pa.string()),
                    pa.array(out["size"], pa.int32()), pa.array(out["shingles"], pa.list_(pa.int64()))], names=list(out))

    schema = T.StructType([
        T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("words", T.StringType()),
        T.StructField("size", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return C.small_batches(items.select("item_id", "text")).mapInArrow(work, schema)


def bit_map(hashes: DataFrame) -> np.ndarray:
    """The set bits of a column ``shingle``, as BITS / 8 bytes: at most BITS / 64 rows reach the driver."""
    at = F.col("shingle").bitwiseAND(F.lit(BITS - 1))
    rows = (hashes.groupBy(F.shiftright(at, 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, int(shingle & 63))")).alias("bits")).toArrow())
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def shingle_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(shingle, n): occurrences in all documents of the shingles in the bit map."""

    def work(batches):
        for batch in batches:
            for _, _, buf, offs in C.steps(batch.column("text")):
                _, _, row, words = _words(buf, offs)
                for size in sizes:
                    h = C.windows_hash(words, row, size)[1]
                    h, n = np.unique(h[_in_map(bits.value, h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return C.small_batches(docs.select("text")).mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame, name: str, bits, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """``docs`` and a struct column of their number of words and their prefix shingles' occurrences."""

    @F.arrow_udf(SCAN)
    def hits(text: pa.Array) -> pa.Array:
        counts, n_hits, cols = [], [], {"shingle": [], "at": [], "before": [], "near": []}
        for a, b, buf, offs in C.steps(text):
            starts, ends, row, words = _words(buf, offs)
            n = C.counts_of(row, b - a)
            first = np.cumsum(n) - n
            counts.append(n)
            found = []
            for size in sizes:
                at, h = C.windows_hash(words, row, size)
                ok = _in_map(bits.value, h)
                found.append((at[ok], h[ok]))
            at = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            h = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
            order = np.argsort(row[at], kind="stable")
            at, h = at[order], h[order]
            r = row[at]
            lo, hi = np.maximum(first[r], at - window + 1), np.minimum(first[r] + n[r], at + window)
            n_hits.append(C.counts_of(r, b - a))
            cols["shingle"] += h.view(np.int64).tolist()
            cols["at"] += (at - first[r]).tolist()
            cols["before"] += (at - lo).tolist()
            low = C.lower_table()[buf] if len(at) else buf
            for f, t in zip(lo.tolist(), hi.tolist()):
                cols["near"].append(" ".join(low[starts[k]:ends[k]].tobytes().decode("utf-8", "replace") for k in range(f, t)))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        k = np.concatenate(n_hits) if n_hits else np.zeros(0, np.int64)
        kinds = {"shingle": pa.int64(), "at": pa.int32(), "before": pa.int32(), "near": pa.string()}
        each = pa.StructArray.from_arrays([pa.array(cols[c], t) for c, t in kinds.items()], names=list(kinds))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), each)
        return pa.StructArray.from_arrays([pa.array(n), lists], names=["n_words", "hits"])

    C.small_batches(docs)
    return docs.withColumn(name, hits("text"))


def found_windows(docs: DataFrame, items: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): rows has the columns ``keep`` of all documents, ``__uid`` and
    ``__scan``; marks has __uid, n_hit, item_ids of those with windows in them."""
    spark = docs.sparkSession
    every = C.saved(windows_of(items), "windows")
    windows = C.saved(every.select("words", "size", "shingles").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    sizes = sorted({min(SHINGLE, r["size"]) for r in windows.select("size").distinct().collect()})  # at most WINDOW rows
    tokens = windows.select("window", F.posexplode("shingles").alias("offset", "shingle"))
    bits = spark.sparkContext.broadcast(bit_map(tokens))
    n = shingle_counts(docs, bits, sizes)
    prefix = C.saved(
        tokens.join(n, "shingle", "left").groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("p"))
        .join(windows, "window").select("window", "words", "size", "p.shingle", "p.offset"), "prefixes")
    bits2 = spark.sparkContext.broadcast(bit_map(prefix))
    rows = C.saved(scan(docs, "__scan", bits2, sizes).select(*keep, "__scan").withColumn("__uid", F.monotonically_increasing_id()), "scanned")

    hits = rows.where(F.size("__scan.hits") > 0).select("__uid", "__scan.n_words", F.explode("__scan.hits").alias("hit"))
    hits = hits.select("__uid", "n_words", "hit.*")
    start = F.col("at") - F.col("offset")
    met = (hits.join(prefix, "shingle")
           .where((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("offset") <= F.col("before")))
           .where(F.concat_ws(" ", F.slice(F.split("near", " "), F.col("before") - F.col("offset") + 1, F.col("size"))) == F.col("words"))
           .select("__uid", start.alias("start"), "size", "window"))
    met = C.saved(met, "met")
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "size"))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(acc["to"], x["start"]))).alias("n"),
            F.greatest(acc["to"], x["start"] + x["size"]).alias("to")),
        lambda acc: acc["n"].cast("long"))
    n_hit = met.groupBy("__uid").agg(covered.alias("n_hit"))
    of = every.select("item_id", "words").where("item_id is not null").distinct().join(windows, "words").select("item_id", "window")
    items_of = (met.select("__uid", "window").distinct().join(of, "window")
                .groupBy("__uid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    return rows, n_hit.join(items_of, "__uid", "left")


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, marks = found_windows(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), ["doc_id"])
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "__uid", "__scan.n_words").join(marks, "__uid", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a word of a benchmark window.  Only those that a
    prefix shingle occurs in are joined with the findings; the others are clean,
    and stay where they are."""
    rows, marks = found_windows(docs, items, docs.columns)
    asked = F.size("__scan.hits") > 0
    some = rows.where(asked).join(marks.select("__uid"), "__uid", "left_anti")
    return rows.where(~asked).select(*docs.columns).unionByName(some.select(*docs.columns))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), {WINDOW}) AS size,
               unnest([array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), {WINDOW}) + 2)]) AS words
        FROM b WHERE len(w) > 0),
pos AS (SELECT uid, size, unnest([{{'k0': i, 'words': array_to_string(w[i:i + size - 1], ' ')}} FOR i IN range(1, len(w) - size + 2)]) AS p
        FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
met AS (SELECT uid, p.k0 AS k0, pos.size AS size, item_id FROM pos JOIN win ON win.size = pos.size AND win.words = p.words),
hit AS (SELECT uid, count(DISTINCT k) AS n_hit FROM (SELECT uid, unnest(range(k0, k0 + size)) AS k FROM (SELECT DISTINCT uid, k0, size FROM met)) GROUP BY uid),
ids AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN ids USING (uid)
"""
