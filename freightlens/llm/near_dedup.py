"""Operator 4: near duplicates by ProbMinHash on weighted five-word shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the weight of a shingle
is its count in the text (a text of one to four words is one shingle).  Each
shingle runs a Poisson process with its weight as rate; every arrival claims
one of ``hashes`` components at random, and a shingle stops as soon as its
clock passes the text's largest component (early termination).  Two texts agree
in a component with the probability Jaccard similarity of their weighted
shingles, which for unrepeated shingles is the plain Jaccard similarity.

``bands`` bands of four components make candidates.  No group is gathered and
no group's pairs are all emitted:

1. equal word sequences collapse to one node (128-bit digest);
2. every node is verified against one hub, the smallest node of its buckets;
   links give classes; from here on links join classes, and components are taken
   of links between classes alone;
3. every node of a bucket that is still of another class is verified against the
   bucket's smallest node, then against its best-linked one and against random
   ones (``TURNS`` in all);
4. in buckets that still hold several classes, all pairs across classes are
   compared, block against block (a bucket is cut into as many blocks of at most
   about ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles as it needs); signatures
   come first, then the similarity itself within the task, and only links leave it.

Verification is exact: probability Jaccard over the whole texts.  The
signature estimate only spares hopeless pairs (``slack`` is more than four
standard deviations).  So a link is lost only if no band catches it, which at
similarity 0.8 has a chance of (1 - 0.8^4)^20 < 3e-5.

Edge cases: null, empty and blank texts are never copies of anything (class:
own doc_id); rows with equal texts are one class, also if they repeat a
doc_id; a class is named by its smallest non-null doc_id, so class_id is null
only if all its rows have a null doc_id.  An empty table gives an empty
result.  Only ``doc_id`` and ``text`` are read; other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .graph import merged, stars

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
SLACK, TURNS, BLOCK, BLOCK_SHINGLES = 0.19, 3, 256, 200_000


# ---------------------------------------------------------------- signatures

def shingles(words: np.ndarray, row: np.ndarray, n: int, size: int = SHINGLE):
    """(row, hash, weight) of the distinct shingles of each text."""
    at, h = C.windows_hash(words, row, size)
    r = row[at]
    count = C.counts_of(row, n)
    first = np.cumsum(count) - count
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            x = np.zeros(len(short), np.uint64)
            for j in range(k):
                x = x * C._P + words[first[short] + j]
            h, r = np.concatenate([h, C.mix(x + np.uint64(k))]), np.concatenate([r, short])
    key = h ^ C.mix(r.astype(np.uint64) + np.uint64(1))
    _, index, weight = np.unique(key, return_index=True, return_counts=True)
    return r[index], h[index], weight.astype(np.float64)


def prob_min_hash(row, h, weight, n: int, m: int) -> np.ndarray:
    """The element that claims each of the m components, per text; (n, m)."""
    best = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    clock = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        draw = C.mix(h + np.uint64(step * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / weight
        slot = row * m + ((C.mix(draw) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, slot, clock)
        won = best[slot] == clock
        who[slot[won]] = h[won]
        go = clock < best.reshape(n, m).max(1)[row]
        row, h, weight, clock = row[go], h[go], weight[go], clock[go]
    return who.reshape(n, m)


def _words(buf, offs):
    starts, ends, row = C.word_ranges(buf, offs)
    return C.word_hashes(buf, starts, ends, lower=True), row


def _digests(words, row, n) -> list[bytes | None]:
    cut = np.searchsorted(row, np.arange(n + 1))
    return [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cut[:-1], cut[1:])]


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, keys, sketch); digest is null for texts without words."""
    m = bands * rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in C.steps(batch.column("text")):
                n = b - a
                words, row = _words(buf, offs)
                digest = _digests(words, row, n)
                who = prob_min_hash(*shingles(words, row, n), n, m)
                keys = np.zeros((n, bands), np.uint64)
                for k in range(rows):
                    keys = C.mix(keys + who.reshape(n, bands, rows)[:, :, k])
                keys = C.mix(keys + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                sketch = C.mix(who).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[a:b], pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "digest", "keys", "sketch"])

    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("digest", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return C.small_batches(docs.select("doc_id", "text")).mapInArrow(work, schema)


@F.arrow_udf(T.BinaryType())
def digest_of(text: pa.Array) -> pa.Array:
    out = []
    for a, b, buf, offs in C.steps(text):
        out += _digests(*_words(buf, offs), b - a)
    return pa.array(out, pa.binary())


# ---------------------------------------------------------------- verification

def weighted_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = C.buffer_of(pa.array([text]))
    _, h, w = shingles(*_words(buf, offs), 1)
    order = np.argsort(h)
    return h[order], w[order]


def probability_jaccard(x, y) -> float:
    """Exact: sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (hx, wx), (hy, wy) = x, y
    both, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    cx, cy = wx[ix], wy[iy]
    ratio = cy / cx
    order = np.argsort(ratio, kind="stable")
    ratio, cx, cy = ratio[order], cx[order], cy[order]
    below = np.searchsorted(ratio, ratio, side="right")
    sum_x = np.concatenate([[0.0], np.cumsum(cx)])[below] + (wx.sum() - cx.sum())
    sum_y = (cy.sum() - np.concatenate([[0.0], np.cumsum(cy)])[below]) + (wy.sum() - cy.sum())
    return float((cx / (sum_x + sum_y / ratio)).sum())


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of similarity ``threshold`` or more, over whole texts; further
    columns, all long, go with them."""
    names = pairs.columns

    def work(batches):
        kept: dict[int, tuple] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta"), batch.column("tb")
            ok = []
            for i in range(len(a)):
                if b[i] not in kept:
                    kept = {b[i]: weighted_set(tb[i].as_py())}  # pairs of a hub come together
                ok.append(probability_jaccard(weighted_set(ta[i].as_py()), kept[b[i]]) >= threshold - 1e-9)
            C.trim(ta.nbytes + tb.nbytes)
            yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .select(*names, "ta", "tb"))
    return C.small_batches(both).mapInArrow(work, ", ".join(f"{c} long" for c in names))


@F.arrow_udf(T.DoubleType())
def agreement(x: pa.Array, y: pa.Array) -> pa.Array:
    if not len(x):
        return pa.array([], pa.float64())
    a, b = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(x), -1) for v in (x, y))
    return pa.array((a == b).mean(1))


# ---------------------------------------------------------------- candidates

def _near(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(agreement("sa", "sb") >= F.lit(least)).select(*pairs.columns))


@F.arrow_udf(T.BinaryType())
def _hashes(text: pa.Array) -> pa.Array:
    """The sorted shingle hashes of each text, repeated by weight."""
    out = []
    for x in text:
        h, w = weighted_set(x.as_py())
        out.append(np.repeat(h, w.astype(np.int64)).tobytes())
    return pa.array(out, pa.binary())


def _jaccards(x: list[np.ndarray], y: list[np.ndarray], pairs: np.ndarray, step: int = 2048) -> np.ndarray:
    """Exact similarities of pairs (i, j) of two blocks: all at once for texts without a
    repeated shingle, where it is the Jaccard similarity of sets, else one by one."""
    sets = [[np.unique(h, return_counts=True) for h in side] for side in (x, y)]
    plain = [np.array([w.max(initial=1) == 1 for _, w in side]) for side in sets]
    vocabulary = np.intersect1d(np.concatenate([h for h, _ in sets[0]]), np.concatenate([h for h, _ in sets[1]]))
    sides = []  # per side the cells of its rows in the vocabulary, by column
    for side in sets:
        row = np.repeat(np.arange(len(side)), [len(h) for h, _ in side])
        h = np.concatenate([h for h, _ in side])
        column = np.searchsorted(vocabulary, h)
        known = np.flatnonzero(column < len(vocabulary))
        known = known[vocabulary[column[known]] == h[known]]
        known = known[np.argsort(column[known], kind="stable")]
        sides.append((row[known], column[known], len(side)))
    both = np.zeros((len(x), len(y)), np.float32)
    for f in range(0, len(vocabulary), step):
        dense = []
        for row, column, n in sides:
            m = np.zeros((n, min(step, len(vocabulary) - f)), np.float32)
            lo, hi = np.searchsorted(column, [f, f + step])
            m[row[lo:hi], column[lo:hi] - f] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    size = [np.array([len(h) for h, _ in side], np.float64) for side in sets]
    i, j = pairs[:, 0], pairs[:, 1]
    out = both[i, j] / (size[0][i] + size[1][j] - both[i, j])
    for k in np.flatnonzero(~(plain[0][i] & plain[1][j])):
        out[k] = probability_jaccard(*((h, w.astype(np.float64)) for h, w in (sets[0][i[k]], sets[1][j[k]])))
    return out


def _block_links(members: DataFrame, payload: DataFrame, least: float, threshold: float, block: int, block_shingles: int) -> DataFrame:
    """Pairs of classes that links join within each bucket, block against block; only they leave a task.
    members: (key, node, cls); payload: (node, n, sketch, keys, hashes)."""
    full = members.join(payload, "node")
    size = members.join(payload.select("node", "n"), "node").groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") / F.lit(block_shingles))).cast("int").alias("blocks"))
    blocks = (full.join(size, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .groupBy("key", "i").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("node", "cls", "sketch", "keys", "hashes")).alias("of")))
    left = blocks.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1))).select("key", "i", "j", F.col("of").alias("x"))
    right = blocks.select("key", F.col("i").alias("j"), F.col("of").alias("y"))

    def parts(column):
        f = column.flatten()
        raw = lambda c, t: [np.frombuffer(v, t) for v in f.field(c).to_pylist()]
        keys = f.field("keys").combine_chunks() if isinstance(f.field("keys"), pa.ChunkedArray) else f.field("keys")
        return (f.field("node").to_numpy(), f.field("cls").to_numpy(), np.array(raw("sketch", np.uint8)),
                np.array(keys.to_pylist(), np.int64), raw("hashes", np.uint64))

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column("key")[k].as_py()
                (na, ca, sa, ka, ha), (nb, cb, sb, kb, hb) = parts(batch.column("x")[k:k + 1]), parts(batch.column("y")[k:k + 1])
                pairs = []
                for r in range(len(na)):
                    ok = cb != ca[r]
                    if batch.column("i")[k] == batch.column("j")[k]:
                        ok &= nb > na[r]
                    some = np.flatnonzero(ok)
                    some = some[(sb[some] == sa[r]).mean(1) >= least]
                    # a pair that meets in several buckets is looked at in the first of them
                    some = some[ka[r][(kb[some] == ka[r]).argmax(1)] == key]
                    pairs.append(np.column_stack([np.full(len(some), r), some]))
                pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
                if len(pairs):
                    pairs = pairs[_jaccards(ha, hb, pairs) >= threshold - 1e-9]
                    joined = np.unique(np.column_stack([ca[pairs[:, 0]], cb[pairs[:, 1]]]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(joined[:, 0]), pa.array(joined[:, 1])], names=["a", "b"])

    met = left.join(right, ["key", "j"]).select("key", "i", "j", "x", "y")
    return C.small_batches(met.repartition(met.sparkSession.sparkContext.defaultParallelism * 4, "key", "i", "j")).mapInArrow(work, "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK,
            turns: int = TURNS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES):
    """(rows, nodes): rows (doc_id, digest) of all documents; nodes (digest, node,
    doc_id, n, cls, class_id) of the distinct word sequences."""
    least = threshold - slack
    sig = C.saved(signatures(docs, bands, rows), "near-signatures")
    nodes = C.saved(
        sig.where("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = C.saved(keys.join(shared, "key").select("key", "node", "low"), "near-buckets")
    texts = C.saved(
        docs.select(digest_of("text").alias("digest"), "text")
        .join(nodes.join(members.select("node").distinct(), "node", "left_semi").select("digest", "node"), "digest")
        .groupBy("node").agg(F.min("text").alias("text")), "near-texts")

    # each node against the smallest node of its buckets: in a group of copies that is one pair a node
    one = members.groupBy("node").agg(F.min("low").alias("low")).where("node > low")
    tried = C.saved(_near(one.select(F.col("node").alias("a"), F.col("low").alias("b")), nodes, least), "near-tried")
    links = C.saved(verified(tried, texts, threshold), "near-links")
    cls = first = stars(links)

    # buckets against their smallest node, where that is of another class; from here on a
    # pair goes with its classes (ca, cb), and links join classes
    of = cls.select(F.col("node").alias("low"), F.col("cls").alias("low_cls"))
    apart = (members.where("node > low").select("node", "low").distinct().join(cls, "node", "left").join(of, "low", "left")
             .select(F.col("node").alias("a"), F.col("low").alias("b"), F.coalesce("cls", "node").alias("ca"), F.coalesce("low_cls", "low").alias("cb"))
             .where("ca <> cb").join(tried, ["a", "b"], "left_anti"))
    between = lambda found: stars(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    more = C.saved(_near(apart, nodes, least), "near-tried")
    found = C.saved(verified(more, texts, threshold), "near-links")
    joined = [between(found)]
    cls = merged(cls, joined[0])
    asked, links = [tried, more], [links, found]

    # buckets that hold several classes, against one more hub a turn
    def mixed(with_cls):
        several = with_cls.groupBy("key").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1")).where("c0 < c1").select("key")
        return with_cls.join(several, "key")

    hubs = [C.saved(members.select("key", F.col("low").alias("node")).distinct(), "near-hubs")]
    open_ = C.saved(mixed(members.join(cls, "node", "left").select("key", "node", F.coalesce("cls", "node").alias("cls"))), "near-open")
    for turn in range(1, turns):
        if turn == 1:
            ends = links[0].select("a", "b").unionByName(links[1].select("a", "b"))
            degree = ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").cast("long").alias("order"))
            ranked = open_.join(degree, "node", "left").withColumn("order", F.coalesce("order", F.lit(0).cast("long")))
        else:
            ranked = open_.withColumn("order", F.xxhash64(F.lit(turn), "node"))
        met = functools.reduce(DataFrame.unionByName, [h.select("key", "node") for h in hubs])
        hub = (ranked.join(met, ["key", "node"], "left_anti").groupBy("key").agg(F.max(F.struct("order", "node", "cls")).alias("hub"))
               .select("key", F.col("hub.node").alias("node"), F.col("hub.cls").alias("cls")))
        hubs.append(C.saved(hub, "near-hubs"))
        hub = hubs[-1].select("key", F.col("node").alias("hub"), F.col("cls").alias("hub_cls"))
        again = (open_.join(hub, "key").where("cls <> hub_cls")
                 .select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"),
                         F.greatest("cls", "hub_cls").alias("ca"), F.least("cls", "hub_cls").alias("cb")).distinct()
                 .join(functools.reduce(DataFrame.unionByName, [t.select("a", "b") for t in asked]), ["a", "b"], "left_anti"))
        asked.append(C.saved(_near(again, nodes, least), "near-tried"))
        found = C.saved(verified(asked[-1], texts, threshold), "near-links")
        joined.append(between(found))
        cls = merged(cls, joined[-1])
        # a bucket of one class stays so: only those still open are looked at again
        to = joined[-1].select(F.col("node").alias("cls"), F.col("cls").alias("__cls"))
        left = C.saved(mixed(open_.join(to, "cls", "left").select("key", "node", F.coalesce("__cls", "cls").alias("cls"))), "near-open")
        C.forget(open_, found)
        open_ = left
    C.forget(*asked, *hubs, *links)

    # whatever is left, whole; a bucket of turns + 1 nodes or fewer has no pair left
    large = open_.groupBy("key").count().where(F.col("count") > turns + 1).select("key")
    rest = C.saved(open_.join(large, "key"), "near-open")
    payload = C.saved(texts.join(rest.select("node").distinct(), "node", "left_semi").select("node", _hashes("text").alias("hashes"))
                      .join(nodes.select("node", "sketch", "keys"), "node").withColumn("n", F.octet_length("hashes") / 8), "near-payload")
    C.forget(texts, members, open_)
    found = C.saved(_block_links(rest, payload, least, threshold, block, block_shingles), "near-links")
    C.forget(rest, payload)
    joined.append(stars(found))
    cls = merged(cls, joined[-1])

    named = nodes.join(cls, "node", "left").select("digest", "node", "doc_id", "n", F.coalesce("cls", "node").alias("cls"))
    names = named.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    rows = C.saved(sig.select("doc_id", "digest"), "near-rows")
    out = C.saved(named.join(names, "cls"), "near-classes")
    C.forget(found, first, *joined, nodes, sig)
    return rows, out


def op4_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, class_size."""
    docs = C.table(spark, sf_dir, "documents")
    rows, nodes = classes(docs)
    return rows.join(nodes.select("digest", "class_id", "class_size"), "digest", "left").select(
        "doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each class of near copies: its smallest doc_id
    (nulls last; among repeated rows any one)."""
    rows, nodes = classes(docs)
    of_class = nodes.groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("pick"))
    fate = nodes.where("class_size > 1").join(of_class, "cls").select(
        "digest", F.col("pick.doc_id").alias("keep_id"), (F.col("pick.digest") == F.col("digest")).alias("keep"))
    pairs = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).join(fate, "digest")
    stays = F.col("keep") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    told = C.saved(pairs.select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id"), stays.alias("__stays"), "n")
                   .where(~stays | (F.col("n") > 1)), "near-fate")
    left = docs.withColumn("__digest", digest_of("text"))

    def those(stay: bool, how: str, df: DataFrame) -> DataFrame:
        some = told.where(F.col("__stays") == stay).select(F.col("__digest").alias("__d"), "__id")
        return df.join(some, (F.col("__digest") == F.col("__d")) & F.col("doc_id").eqNullSafe(F.col("__id")), how)

    left = those(False, "left_anti", left)
    if not told.where("__stays").isEmpty():  # rows that repeat both text and doc_id
        left = those(True, "left_anti", left).unionByName(those(True, "left_semi", left).dropDuplicates(["__digest", "doc_id"]))
    return left.select(*docs.columns)
