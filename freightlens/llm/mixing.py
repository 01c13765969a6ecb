"""Operator 5: mixing sources to target weights by a multivariate-hypergeometric
splitting tree.

A text's size is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources by code
point, null last, weigh 5, 2, 1, repeating, and share 150 % of all sizes; a
target stops at twice its source's size, and the excess is reshared by weight.

Each source's documents lie in a hash-permuted line.  A target of q times the
size takes floor(q) copies of the line and the start of one more, up to the
document whose middle passes the quota.  The line is cut every ``BLOCK_WORDS``
words; (copy, block) units are numbered by an affine permutation, so a source's
quota is an exact number of units.  The tree halves the output shards again
and again: at each node a multivariate-hypergeometric draw splits every
source's remaining quota between the halves, and each half continues where the
other's run of permuted units ends, so the draws are disjoint and exact.  Every
shard walks its own path from the root (each node has its own seed), so no
table of shards by sources is made in one place.  Within a shard, documents are
in order of a hash (``place``).

Positions come from prefix sums in three levels: of runs of ``BUCKET`` hash
buckets within a source, of buckets of about ``BUCKET`` documents within a run,
and of documents within a bucket; a source with a third of all rows is many
buckets.  Only one row per source (its
size) and the quotas reach the driver.

Edge cases: null, empty and blank texts have size 0 and are never drawn; a null
source is a source of its own; rows that repeat everything count and are drawn
one by one (which of them is drawn more often is open); repeated doc_ids are
rows of their own.  An empty table gives an empty result.  Columns other than
doc_id, text and source pass through, those named like the added ones as
``doc_<name>``.  Reruns over equal tables agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as _W
from pyspark.sql import functions as F

from . import common as C

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
ADDED = ("size", "source_size", "target", "taken", "draws")
BLOCK_WORDS, SHARD_BLOCKS, BUCKET, SEED = 50_000, 32, 1000, 20240607


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Each source's words in the mix."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        want = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if want[s] > most * sizes[s]]
        if not over:
            return out | want
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _affine(n: int, k: int) -> tuple[int, int]:
    """Multiplier and shift of a permutation of 0 to n - 1."""
    rng = np.random.default_rng([SEED, n, k])
    a = int(rng.integers(1, n + 1))
    while math.gcd(a, n) != 1:
        a += 1
    return a % n if n > 1 else 1, int(rng.integers(0, n))


def leaf(quotas: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, units) of each source in one shard: the path from the root to it."""
    start, count, lo, hi, total = np.zeros_like(quotas), quotas.copy(), 0, shards, int(quotas.sum())
    cut = lambda i: total * i // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(count, cut(mid) - cut(lo), method="marginals")
        if shard < mid:
            count, hi = left, mid
        else:
            start, count, lo = start + left, count - left, mid
    return start, count


def plan(spark: SparkSession, quotas: list[int], shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(s, rank, shard): where each source's units go."""
    q = np.array(quotas, np.int64)
    shards = max(1, -(-int(q.sum()) // shard_blocks))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                start, count = leaf(q, shards, int(shard))
                s = np.flatnonzero(count)
                yield pd.DataFrame({"s": s.astype(np.int32), "first": start[s], "units": count[s], "shard": int(shard)})

    runs = spark.range(shards).mapInPandas(work, "s int, first long, units long, shard long")
    return runs.select("s", F.explode(F.sequence("first", F.col("first") + F.col("units") - 1)).alias("rank"), "shard")


def draws(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """rows: __uid, __key (a hash), __size, source.  Gives (sources, draws): the
    source table (source, s, source_size, target) and one row per drawn copy
    (__uid, __key, __size, copy, shard)."""
    spark = rows.sparkSession
    of = rows.groupBy("source").agg(F.sum("__size").alias("size"), F.count("*").alias("n")).collect()  # a row per source
    sizes = {r["source"]: int(r["size"]) for r in of}
    want = targets(sizes)
    docs_of = {r["source"]: int(r["n"]) for r in of}
    names = list(want)
    table, quotas = [], []
    for s, name in enumerate(names):
        full = int(want[name] // sizes[name]) if sizes[name] else 0
        rest = want[name] - full * sizes[name] if sizes[name] else 0.0
        blocks, part = -(-sizes[name] // block_words), math.ceil(rest / block_words)
        units = full * blocks + part
        a, b = _affine(units, s) if units else (1, 0)
        quotas.append(units)
        table.append((name, s, sizes[name], float(want[name]), full, float(rest), blocks, units, a, b, -(-docs_of[name] // BUCKET)))
    sources = spark.createDataFrame(
        table, f"source {rows.schema['source'].dataType.simpleString()}, s int, source_size long, target double, "
               "full int, rest double, blocks long, units long, a long, b long, buckets long")
    line = (rows.where("__size > 0").join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"]))
            .select("__uid", "__key", "__size", "s", "full", "rest", "blocks", "units", "a", "b",
                    F.pmod(F.col("__key"), F.col("buckets")).alias("bucket")))
    inside = line.withColumn("before", F.sum("__size").over(_upto("s", "bucket")) - F.col("__size"))
    # a bucket's first word: sums within runs of buckets, then over the runs
    each = line.groupBy("s", "bucket").agg(F.sum("__size").alias("words")).withColumn("run", F.floor(F.col("bucket") / BUCKET))
    run = each.groupBy("s", "run").agg(F.sum("words").alias("words")).select("s", "run", _before(["s"], "run").alias("run_offset"))
    offset = (each.select("s", "run", "bucket", _before(["s", "run"], "bucket").alias("in_run")).join(run, ["s", "run"])
              .select("s", "bucket", (F.col("in_run") + F.col("run_offset")).alias("offset")))
    at = F.col("before") + F.col("offset")
    copies = F.sequence(F.lit(1), F.col("full") + F.when(F.col("at") + F.col("__size") / 2 <= F.col("rest"), 1).otherwise(0))
    taken = (inside.join(offset, ["s", "bucket"]).withColumn("at", at)
             .withColumn("copies", F.when((F.col("full") > 0) | (F.col("at") + F.col("__size") / 2 <= F.col("rest")), copies).otherwise(F.array().cast("array<int>")))
             .select("__uid", "__key", "__size", "s", "units", "a", "b", "blocks", "at", F.explode("copies").alias("copy")))
    unit = (F.col("copy") - 1) * F.col("blocks") + F.floor(F.col("at") / block_words)
    ranked = taken.withColumn("rank", F.pmod(F.col("a") * unit + F.col("b"), F.col("units")))
    drawn = ranked.join(plan(spark, quotas, shard_blocks), ["s", "rank"]).select("__uid", "__key", "__size", "copy", "shard")
    return sources.select("source", "s", "source_size", "target"), drawn


def _before(keys: list[str], order: str):
    """The words of the rows before this one."""
    return F.sum("words").over(_W.partitionBy(*keys).orderBy(order).rowsBetween(_W.unboundedPreceding, 0)) - F.col("words")


def _upto(*keys: str):
    return _W.partitionBy(*keys).orderBy("__key", "__uid").rowsBetween(_W.unboundedPreceding, 0)


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with __size, __key and __uid, written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return C.saved(docs.select(
        *keep, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("__size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("source"), F.xxhash64(text)).alias("__key"),
    ).withColumn("__uid", F.monotonically_increasing_id()), "sized")


def mixed(docs: DataFrame, keep: list[str], block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The columns ``keep`` of each row, size, source_size, target, taken, and
    draws: shard, place (order within the shard) and copy of each time it is drawn.
    A kept column of one of these names is called ``doc_<name>``."""
    C.ship(docs.sparkSession)
    rows = sized(docs, keep if "source" in keep else [*keep, "source"])
    sources, drawn = draws(rows.select("__uid", "__key", "__size", "source"), block_words, shard_blocks)
    per = drawn.groupBy("__uid").agg(F.sum("__size").alias("__taken"), F.sort_array(F.collect_list(F.struct(
        "shard", F.xxhash64(F.lit(SEED), "__key", "copy").alias("place"), "copy"))).alias("__draws"))
    sources = sources.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    return (rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["__source"]))
            .join(per, "__uid", "left")
            .select(*(rows[c].alias(f"doc_{c}" if c in ADDED else c) for c in keep), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                    F.col("__target").alias("target"), F.coalesce("__taken", F.lit(0).cast("long")).alias("taken"),
                    F.coalesce("__draws", F.array().cast("array<struct<shard:bigint,place:bigint,copy:int>>")).alias("draws")))


def shards(mix: DataFrame) -> DataFrame:
    """The mix itself: a row per drawn copy, all of a shard in one partition, shuffled within it."""
    each = mix.withColumn("draw", F.explode("draws")).drop("draws").withColumn("shard", F.col("draw.shard"))
    return each.repartition("shard").sortWithinPartitions("shard", "draw.place").drop("draw")


def op5_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, draws."""
    return mixed(C.table(spark, sf_dir, "documents"), ["doc_id"])
