"""Operator 13: the prefix trie of conversations, by burst tries.

``rebuilt`` orders a conversation's turns (null first, ties by the turn's
digest), puts the first turns of conversation c - c % 100 before c's own later
ones, and gives a row per turn: conversation, depth, turn id (md5 of role and
text) and code points of the text.  Texts go no further.

``trie`` makes the nodes.  Conversations of the same turns are one sequence with
a count.  At first all sequences lie in one container under the root.  An
oversized container (more than ``BURST`` turns of two or more sequences) bursts
by the next turn id: it becomes a trie head, and its suffixes go to a container
per turn id.  A round bursts twice as many levels as the one before, and only
touches suffixes of containers that are still oversized.  The remaining
containers are dealt to shards, where each is sorted and swept into nodes with
a stack; it holds at most ``BURST`` turns.  A container of one sequence has
nothing to sort: its turns are its nodes, whatever their number.

A head's subtree can be any part of the trie, so its sums aren't taken down the
tree: a sequence adds to each head above it, with pre-aggregation, what it has
there itself (its count times the rest of its code points, less the rest that
it owns; a node is owned by its smallest member).  So work is in proportion to
rows at any depth.  The members that end at a node are joined in blocks and
hashed block after block.

Hot parts: a conversation's places come from a range sort; copies collapse to a
count before any join; a hot container bursts; a long sequence's prefix sums
go in two levels.  Joins on conversations are left to AQE's skew split.

Edge cases: null roles and texts are empty; turns of a null conv_id belong to no
conversation and are left out; turns that repeat everything are turns of their
own; a conversation can be turnless once rebuilt, and ends at the root; an empty
table gives no node.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as _W
from pyspark.sql import functions as F

from ..operators.ranking import with_place
from . import common as C
from .resampling import CRC_TABLE, crc_sql

BURST, GROUP, HEADS = 2_000, 100, 6
#: Turns that a running sum takes at a time, conversation ids in a block of ends.
CHUNK, BLOCK = 4096, 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- conversations

def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): (conv, len) of each conversation, and (conv, d, tid,
    chars) of the turns of each once rebuilt, d from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("tid"),
        F.char_length(text).cast("long").alias("chars"))
    rows = C.saved(rows, "turns")  # a range sort reads its rows twice; texts are digested once
    placed = with_place(rows, ["conv", F.asc_nulls_first("turn"), "tid"], "at", save=lambda df: C.saved(df, "turns"))
    own = placed.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    convs = own.select("conv", "first", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"),
                       (F.col("conv") - F.col("conv") % group).alias("base"))
    convs = C.saved(
        convs.join(own.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .withColumn("take", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    told = placed.join(convs.select("conv", "first", "h", "take"), "conv").withColumn("pos", F.col("at") - F.col("first"))
    later = told.where(F.col("pos") >= F.col("h")).select("conv", (F.col("take") + F.col("pos") - F.col("h") + 1).alias("d"), "tid", "chars")
    # at most ``heads - 1`` turns of a base, taken by the conversations of its group
    openings = told.where(F.col("pos") < heads - 1).select(F.col("conv").alias("base"), "pos", "tid", "chars")
    earlier = (convs.where("take > 0").select("conv", "base", "take").join(openings, "base")
               .where(F.col("pos") < F.col("take")).select("conv", (F.col("pos") + 1).alias("d"), "tid", "chars"))
    return (convs.select("conv", (F.col("take") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")),
            C.saved(later.unionByName(earlier), "rebuilt"))


# ---------------------------------------------------------------- sequences

def _distinct(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, seqs): (conv, seq) of each conversation, and (seq, n, len) of each
    distinct sequence, named by its smallest conversation."""
    h1, h2 = F.xxhash64("tid", "d"), F.xxhash64("d", "tid", F.lit(13))
    mark = turns.groupBy("conv").agg(F.bit_xor(h1).alias("k1"), F.bit_xor(h2).alias("k2"))
    each = C.saved(convs.join(mark, "conv", "left").select(
        "conv", "len", F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2")), "marks")
    seqs = C.saved(each.groupBy("k1", "k2", "len").agg(F.min("conv").alias("seq"), F.count("*").alias("n")), "sequences")
    members = each.join(seqs.where("n > 1"), ["k1", "k2", "len"]).select("conv", "seq")
    return members, seqs.select("seq", "n", "len")


def _prefixed(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """The turns of the sequences with n, len, the prefix's key (k1, k2), and
    ``rest``: code points from this turn on."""
    rows = turns.join(seqs.select(F.col("seq").alias("conv"), "n", "len"), "conv").select(
        F.col("conv").alias("seq"), "d", "tid", "chars", "n", "len", F.floor((F.col("d") - 1) / CHUNK).alias("chunk"),
        F.xxhash64("tid", "d").alias("x1"), F.xxhash64("d", "tid", F.lit(13)).alias("x2"))
    upto = _W.partitionBy("seq", "chunk").orderBy("d").rowsBetween(_W.unboundedPreceding, 0)
    within = rows.select("seq", "chunk", "d", "tid", "chars", "n", "len", F.bit_xor("x1").over(upto).alias("k1"),
                         F.bit_xor("x2").over(upto).alias("k2"), F.sum("chars").over(upto).alias("upto"))
    sums = rows.groupBy("seq", "chunk").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"), F.sum("chars").alias("y"))
    past = _W.partitionBy("seq").orderBy("chunk").rowsBetween(_W.unboundedPreceding, -1)
    before = sums.select(
        "seq", "chunk", *(F.coalesce(F.bit_xor(c).over(past), F.lit(0)).alias(c) for c in ("y1", "y2")),
        F.coalesce(F.sum("y").over(past), F.lit(0)).alias("y"), F.sum("y").over(_W.partitionBy("seq")).alias("total"))
    return C.saved(within.join(before, ["seq", "chunk"]).select(
        "seq", "d", "tid", "chars", "n", "len", F.col("k1").bitwiseXOR(F.col("y1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("y2")).alias("k2"),
        (F.col("total") - F.col("y") - F.col("upto") + F.col("chars")).alias("rest")), "prefixes")


# ---------------------------------------------------------------- bursting

def burst_depths(rows: DataFrame, burst: int) -> DataFrame:
    """(seq, burst): the depth of the last burst container that each sequence
    runs through; sequences without one don't occur."""
    low, levels, open_, found = 0, 1, None, []
    while True:
        block = rows.where((F.col("d") > low) & (F.col("d") <= low + levels))
        if open_ is not None:
            block = block.join(open_, "seq", "left_semi")
        oversized = block.groupBy("k1", "k2").agg(F.sum(F.col("len") - F.col("d") + 1).alias("turns"), F.count("*").alias("suffixes")).where(
            (F.col("turns") > burst) & (F.col("suffixes") > 1)).select("k1", "k2")
        hit = C.saved(block.join(oversized, ["k1", "k2"], "left_semi").groupBy("seq").agg(
            F.max("d").alias("burst"), F.first("len").alias("len")), "burst")
        found.append(hit.select("seq", "burst"))
        low, levels = low + levels, levels * 2
        open_ = hit.where((F.col("burst") == low) & (F.col("len") > low)).select("seq")
        if open_.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("seq").agg(F.max("burst").alias("burst"))


NODE = ("conv long, depth long, parent long, n long, children long, leaves long, saved long, chars long, ends long, ends_n long")
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def sweep(suffixes: list[tuple[list[bytes], list[int], int, int]], depth: int, out: list[list]) -> None:
    """Append the nodes of one container: suffixes of (turn ids, code points,
    sequence, count), the first turn at ``depth`` the same in all.  The top node
    has no parent yet."""
    suffixes.sort(key=lambda s: s[0])
    # an open node: conv, n, leaves, saved, chars, sequence that ends here and its count, children's places in ``out``
    stack: list[list] = []

    def close() -> None:
        conv, n, leaves, saved, chars, ends, ends_n, children = stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * chars
        for k in children:
            out[k][2] = conv
        if stack:
            up = stack[-1]
            up[0], up[1], up[2], up[3] = min(up[0], conv), up[1] + n, up[2] + leaves, up[3] + saved
            up[7].append(len(out))
        out.append([conv, depth + len(stack), None, n, len(children), leaves, saved, chars, ends, ends_n])

    last: list[bytes] = []
    for tids, chars, seq, count in suffixes:
        same = 0
        while same < len(last) and same < len(tids) and last[same] == tids[same]:
            same += 1
        while len(stack) > same:
            close()
        stack.extend([seq, 0, 0, 0, c, None, 0, []] for c in chars[same:])
        top = stack[-1]
        top[0], top[1], top[5], top[6] = min(top[0], seq), top[1] + count, seq, count
        last = tids
    while stack:
        close()


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of the containers (c1, c2) of more than one sequence."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        key, depth, held = None, 0, []

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=_NAMES)
            out.clear()
            return got

        for b in batches:
            for c1, c2, seq, d, tid, chars, n in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "seq", "d", "tid", "chars", "n"))):
                if key != (c1, c2):
                    if held:
                        sweep(held, depth, out)
                    key, depth, held = (c1, c2), d, []
                if not held or held[-1][2] != seq:
                    held.append(([], [], seq, n))
                held[-1][0].append(tid)
                held[-1][1].append(chars)
            if len(out) > 10_000:
                yield batch()
        if held:
            sweep(held, depth, out)
        if out:
            yield batch()

    sorted_ = (rows.select("c1", "c2", "seq", "d", "tid", "chars", "n").repartition("c1", "c2")  # a shard each
               .sortWithinPartitions("c1", "c2", "seq", "d"))
    return C.small_batches(sorted_, 4096).mapInArrow(nodes, NODE)


# ---------------------------------------------------------------- ends

def _ends(members: DataFrame) -> DataFrame:
    """(seq, sha): of the conversations of each sequence of several, in order."""
    ranked = with_place(members, ["seq", "conv"], "at", save=lambda df: C.saved(df, "members"))
    blocks = ranked.groupBy("seq", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))

    def hashed(batches):
        seq, state = None, None
        for b in batches:
            done: list[tuple[int, str]] = []
            for s, ids in zip(b.column("seq").to_pylist(), b.column("ids").to_pylist()):
                if s != seq:
                    if state:
                        done.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], names=["seq", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([state.hexdigest()])], names=["seq", "sha"])

    ordered = blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "ids")
    return C.small_batches(ordered).mapInArrow(hashed, "seq long, sha string")


# ---------------------------------------------------------------- the trie

def trie(convs: DataFrame, turns: DataFrame, burst: int = BURST) -> DataFrame:
    """convs (conv, len), turns (conv, d, tid, chars) -> conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members, seqs = _distinct(convs, turns)
    rows = _prefixed(turns, seqs)
    rows = C.saved(rows.join(burst_depths(rows, burst), "seq", "left").withColumn("burst", F.coalesce("burst", F.lit(0))), "heads")

    # what lies under the heads
    tops = rows.where(F.col("d") == F.col("burst") + 1).select("seq", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    alone = tops.groupBy("c1", "c2").agg(F.count("*").alias("suffixes"))
    held = C.saved(tops.join(alone, ["c1", "c2"]), "containers")
    under = rows.where(F.col("d") > F.col("burst")).join(held, "seq")
    end = F.when(F.col("d") == F.col("len"), F.col("seq"))
    chains = under.where("suffixes = 1").select(
        F.col("seq").alias("conv"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("burst") + 1, F.col("seq")).alias("parent"), "n",
        (F.col("d") < F.col("len")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("rest")).alias("saved"), "chars", end.alias("ends"), F.when(end.isNotNull(), F.col("n")).alias("ends_n"))
    low = C.saved(_swept(under.where("suffixes > 1")).unionByName(chains), "nodes")

    # the heads
    above = rows.where(F.col("d") <= F.col("burst"))
    heads = C.saved(above.groupBy("k1", "k2").agg(
        F.min("seq").alias("conv"), F.first("d").alias("depth"), F.sum("n").alias("n"), F.first("chars").alias("chars"),
        F.max(end).alias("ends"), F.max(F.when(end.isNotNull(), F.col("n"))).alias("ends_n")), "heads")
    leaf = (F.col("children") == 0).cast("long")
    owned = C.saved(
        low.select("conv", "depth", "chars", leaf.alias("leaf")).unionByName(heads.select("conv", "depth", "chars", F.lit(0).cast("long").alias("leaf")))
        .groupBy("conv").agg(F.min("depth").alias("owned_from"), F.sum("chars").alias("owned"), F.max("leaf").alias("leaf"))
        .withColumnRenamed("conv", "seq"), "owned")
    # a sequence owns its turns from ``owned_from`` on
    kept = F.when(F.col("owned_from").isNull(), 0).when(F.col("d") >= F.col("owned_from"), F.col("rest")).otherwise(F.col("owned"))
    sums = above.join(owned, "seq", "left").groupBy("k1", "k2").agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("leaves"), F.sum(F.col("n") * F.col("rest") - kept).alias("saved"),
        F.count_if((F.col("owned_from") <= F.col("d") + 1) & (F.col("d") < F.col("len"))).alias("children"))

    # the root has no turn, so nothing of its own
    empty = F.when(F.col("len") == 0, F.col("seq"))
    all_ = seqs.join(rows.where("d = 1").select("seq", "rest"), "seq", "left").join(owned, "seq", "left")
    root = C.saved(all_.agg(
        F.min("seq").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.sum("n").alias("n"),
        F.count_if(F.col("owned_from") == 1).alias("children"), F.greatest(F.lit(1), F.sum(F.coalesce("leaf", F.lit(0)))).alias("leaves"),
        F.sum(F.col("n") * F.coalesce("rest", F.lit(0)) - F.coalesce("owned", F.lit(0))).alias("saved"),
        F.max(empty).alias("ends"), F.max(F.when(empty.isNotNull(), F.col("n"))).alias("ends_n")).where("conv is not null"), "root")

    # parents of heads and of containers' tops: the head one turn up, or the root
    top = root.first()  # one row, or none
    need = low.where("parent is null").select("conv", "depth").unionByName(heads.select("conv", "depth"))
    up = (need.where("depth > 1").join(above.select(F.col("seq").alias("conv"), (F.col("d") + 1).alias("depth"), "k1", "k2"), ["conv", "depth"])
          .join(heads.select("k1", "k2", F.col("conv").alias("parent")), ["k1", "k2"]).select("conv", "depth", "parent"))
    parents = up.unionByName(need.where("depth = 1").withColumn("parent", F.lit(top and top["conv"]).cast("long")))
    columns = ["conv", "depth", "parent", "n", "children", "leaves", "saved", "ends", "ends_n"]
    loose = low.where("parent is null").drop("parent").unionByName(heads.join(sums, ["k1", "k2"]).drop("k1", "k2"))
    nodes = low.where("parent is not null").select(columns).unionByName(loose.join(parents, ["conv", "depth"]).select(columns)).unionByName(root.select(columns))

    several = nodes.where("ends_n > 1").join(_ends(members).withColumnRenamed("seq", "ends"), "ends")
    few = nodes.where("ends_n is null or ends_n <= 1").withColumn(
        "sha", F.when(F.col("ends").isNull(), F.lit(EMPTY_SHA)).otherwise(F.sha2(F.col("ends").cast("string"), 256)))
    return several.unionByName(few).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(*rebuilt(C.table(spark, sf_dir, "conversations")))


SQL = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid
      FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, chars, tid, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tid) - 1 AS pos FROM t),
n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
v AS (SELECT c, n, {crc_sql('CAST(c AS VARCHAR)')} % {HEADS} AS h, c - c % {GROUP} AS base FROM n, crc),
w AS (SELECT v.c AS c, v.base AS base, v.n AS n, h, least(h, coalesce(b.n, 0)) AS take FROM v LEFT JOIN n b ON v.base = b.c),
r AS (SELECT w.c AS c, pos + 1 AS d, tid, chars FROM w JOIN p ON p.c = w.base AND pos < take
      UNION ALL SELECT w.c, take + pos - h + 1, tid, chars FROM w JOIN p ON p.c = w.c AND pos >= h
      UNION ALL SELECT w.c, 0, '', 0 FROM w),
k AS (SELECT c, d, chars, sha256(string_agg(tid, ',') OVER (PARTITION BY c ORDER BY d)) AS k FROM r),
len AS (SELECT c, max(d) AS len FROM k GROUP BY c),
node AS (SELECT k, min(c) AS c, first(d) AS d, first(chars) AS chars, count(*) AS n, count(*) FILTER (d = len) AS ending,
                string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len) AS ends FROM k JOIN len USING (c) GROUP BY k),
link AS (SELECT node.k AS k, up.k AS up FROM node JOIN k up ON up.c = node.c AND up.d = node.d - 1),
childless AS (SELECT k FROM node WHERE k NOT IN (SELECT up FROM link)),
under AS (SELECT k.k AS k, count(*) FILTER (x.k IN (SELECT k FROM childless)) AS leaves, sum((x.n - 1) * x.chars) AS saved
          FROM node x JOIN k ON k.c = x.c AND k.d <= x.d GROUP BY k.k)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, parent.c AS parent_conv_id, node.n AS n_convs,
       (SELECT count(*) FROM link l WHERE l.up = node.k) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN under USING (k) LEFT JOIN link USING (k) LEFT JOIN node parent ON parent.k = link.up
"""
