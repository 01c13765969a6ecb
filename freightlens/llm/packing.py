"""Operator 11: best-fit packing planned on the histogram of lengths.

A document is its tokens and one end token.  Documents longer than ``SIZE`` are
cut into pieces of ``SIZE`` tokens, the last of which may be shorter; nothing
else is cut.  The plan is best-fit decreasing over counts: lengths go from long
to short, and all pieces of a length go at once into the fullest sequences that
still hold them, so a run of equal sequences is one entry and the plan has a
size that depends on ``SIZE`` alone, not on the number of documents.  It equals
best-fit decreasing over the single pieces, and sequences are filled from 0
without gaps.

A piece's rank within its length comes from a range sort of narrow rows (a
length with a third of all pieces is cut over many ranges); the plan's runs are
spread into slots (length, rank), and pieces take slots by an equi-join on that
key, which is unique on both sides.

Tokens: the tokenizer's normaliser and splitter never reach across white space,
and the signs (``_ENDING``) that end a word after a Latin letter are always a run
of their own.  So a text's ids are its words' ids on end, and each distinct word
that a Python worker meets (``interning``) is encoded once, A-Z lower-cased where
nothing can compose and no special token stand; words of plain Latin letters, which
need no composing or splitting, go in lines, those of a-z past the normaliser.

Edge cases: a null text is empty; an empty or blank text is the end token alone;
rows that repeat a doc_id or a text are documents of their own; a null doc_id is
kept.  An empty table gives an empty result.  Only ``doc_id`` and ``text`` are
read, so other columns don't matter.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import with_place
from . import common as C
from .interning import Places

SIZE, END = 2048, 0
#: The tokenizer's file, at one path on all executors.
TOKENIZER = "word_bpe_49k.json"
#: Distinct words, and their ids, that a Python worker remembers before it forgets all.
KNOWN, KNOWN_IDS = 400_000, 4_000_000
#: Slots that one task spreads at a time.
SPREAD = 1 << 16

_ENDING = b".,;:!?#$%&*"
#: Words of letters below U+0180, without U+0130, whose lower case is two characters.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|\xC4[\x80-\xAF\xB1-\xBF]|\xC5[\x80-\xBF])+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _Vocabulary:
    """The tokenizer and the ids of words met so far, in one flat array."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a plain word is one unit once lower-cased: nothing to compose or split in it
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # a word of a-z alone stays as it is
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        tokens = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(tokens.values()) + 1, bool)  # the ids that end a unit
        self.closes[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words = Places()
        self.flat, self.ids = np.zeros(1 << 16, np.uint32), 0  # ``ids`` of them are in use
        self.size, self.first = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    @property
    def known(self) -> list[bytes]:
        return self.words.strings()

    def _add(self, place: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.size), self.words.n
        if m > n:
            self.size, self.first = (np.concatenate([x, np.zeros(2 * m - n, np.int64)]) for x in (self.size, self.first))
        if self.ids + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.ids], np.zeros(self.ids + 2 * len(ids), np.uint32)])
        self.flat[self.ids:self.ids + len(ids)] = ids
        self.size[place] = size
        self.first[place] = self.ids + np.cumsum(size) - size
        self.ids += len(ids)

    def places(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each of the words buf[start:end] stands in ``size``; new ones are encoded."""
        if self.words.n > KNOWN or self.ids > KNOWN_IDS:
            self.forget()
        n = self.words.n
        place, fresh = self.words.of(buf, starts, ends)
        first, last, raw = starts[fresh], ends[fresh], buf.tobytes()
        letters = _within((buf < 97) | (buf > 122), first, last) == 0
        new = [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
        kind = np.array([0 if easy else 1 if PLAIN.fullmatch(w) else 2 for w, easy in zip(new, letters.tolist())], np.int64)
        for k, tokenizer in enumerate((self.letters, self.plain)):
            some = np.flatnonzero(kind == k)
            of = [new[i] for i in some.tolist()]
            lines = [b" ".join(of[i:i + 50]).decode("utf-8") for i in range(0, len(of), 50)]
            run = np.fromiter(itertools.chain.from_iterable(e.ids for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
            self._add(n + some, run, np.diff(np.flatnonzero(self.closes[run]), prepend=-1))
        some = np.flatnonzero(kind == 2)
        each = [e.ids for e in self.tokenizer.encode_batch_fast([new[i].decode("utf-8") for i in some.tolist()], add_special_tokens=False)]
        self._add(n + some, np.fromiter(itertools.chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each)))
        return place


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> _Vocabulary:
    return _Vocabulary(path)


def _letter_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter that ``PLAIN`` has ends at each place (2 or more)."""
    last, lead = buf[at - 1], buf[at - 2]
    low = last | 32
    two = (last >= 0x80) & (last < 0xC0) & (((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | ((lead == 0xC4) & (last != 0xB0)) | (lead == 0xC5))
    return ((low >= 97) & (low <= 122)) | two


def _units(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, row) of what is encoded by itself: words, and the signs that end them apart."""
    starts, ends, row = C.word_ranges(buf, offs)
    if not len(starts):
        return starts, ends, row
    closing = ~C.byte_class(_ENDING)
    kept, some = ends.copy(), np.flatnonzero(closing[buf[ends - 1]])  # kept: after the last other byte
    if (ends[some] - starts[some]).max(initial=0) > 64:
        kept = np.maximum(starts, np.maximum.accumulate(np.where(closing[buf], 0, np.arange(1, len(buf) + 1)))[ends - 1])
    else:
        while len(some):
            kept[some] -= 1
            some = some[kept[some] > starts[some]]
            some = some[closing[buf[kept[some] - 1]]]
    apart = (kept > starts) & (kept < ends)
    apart[apart] = _letter_before(buf, kept[apart])
    at = np.repeat(np.arange(len(starts)), 1 + apart)
    second = np.zeros(len(at), bool)
    second[1:] = at[1:] == at[:-1]
    first_of_two = apart[at] & ~second
    return (np.where(second, kept[at], starts[at]), np.where(first_of_two, kept[at], ends[at]), row[at])


def _within(marked: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marked bytes lie in each range."""
    total = np.concatenate([[0], np.cumsum(marked, dtype=np.int32)])
    return total[ends] - total[starts]


def _folded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``buf`` with A-Z lower-cased in the ranges where the tokenizer does just that: without
    marks that a letter may compose with (all from U+0180) and ``<``, which special tokens begin with."""
    out = C.lower_table()[buf]
    odd = np.flatnonzero((buf >= 0xC6) | (buf == 0x3C))
    if len(odd):
        at = np.searchsorted(starts, odd, side="right") - 1
        at = at[np.diff(at, prepend=-1) > 0]  # the ranges that have them
        size = ends[at] - starts[at]
        kept = np.arange(size.sum()) + np.repeat(starts[at] - np.cumsum(size) + size, size)
        out[kept] = buf[kept]
    return out


def token_ids(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts on end, first id of each and the end): without end tokens."""
    starts, ends, row = _units(buf, offs)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    buf = _folded(buf, starts, ends)
    vocabulary = _vocabulary(path)
    word = vocabulary.places(buf, starts, ends)
    count = vocabulary.size[word]
    total = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(vocabulary.first[word] - total[:-1], count)
    return vocabulary.flat[np.arange(total[-1]) + source], total[np.searchsorted(row, np.arange(len(offs)))]


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of all documents; ``ids`` false leaves the ids out."""
    path = path or tokenizer_path()

    def work(batches):
        for batch in batches:
            for a, b, buf, offs in C.steps(batch.column("text")):
                flat, cut = token_ids(buf, offs, path)
                n = np.diff(cut) + 1
                first = np.cumsum(n) - n
                out = np.full(int(n.sum()), end, np.dtype("<u4"))
                out[np.arange(len(flat)) + np.repeat(np.arange(b - a), n - 1)] = flat
                count = -(-n // size)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, n[doc] - start)
                lo = first[doc] + start
                view = memoryview(out)
                columns = [batch.column("doc_id")[a:b].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                           pa.array([zlib.crc32(view[x:y]) for x, y in zip(lo.tolist(), (lo + length).tolist())], pa.int64())]
                if ids:
                    edge = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(out.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              *(T.StructField(k, T.LongType()) for k in ("start", "length", "ids_crc32"))]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    return C.small_batches(docs.select("doc_id", "text")).mapInArrow(work, T.StructType(fields))


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first, slots, sequence, offset, per).

    The pieces of rank ``first`` to ``first + slots - 1`` of a length lie ``per``
    to a sequence, from ``sequence`` on, the first of each at ``offset``."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, sequences)
    rooms: list[int] = []  # the keys in order
    out, sequences = [], 0

    def put(left: int, sequence: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((sequence, n))

    for length in sorted(counts, reverse=True):
        first, n = 0, counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                more = -(-n // (size // length))
                put(size, sequences, more)
                sequences += more
                continue
            left = rooms[at]
            per = left // length
            sequence, m = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(at)
            whole = min(m, n // per)
            per, used = (per, whole) if whole else (n, 1)  # the last few share one sequence
            out.append((length, first, per * used, sequence, size - left, per))
            put(left - per * length, sequence, used)
            put(left, sequence + used, m - used)
            first, n = first + per * used, n - per * used
    return out


def packed(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (of ``pieces``) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    order = ["length", F.asc_nulls_last("doc_id"), "piece", "ids_crc32"]
    parts = C.saved(parts, "parts")  # a range sort reads its rows twice; texts are encoded once
    ranked = with_place(parts, order, "__place", save=lambda df: C.saved(df, "pieces"))
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    before, start = 0, []
    for length in sorted(counts):
        start.append((length, before))
        before += counts[length]
    # both tables have at most ``size`` rows, or rows by ``size`` alone
    starts = spark.createDataFrame(start, "length long, __start long")
    runs = spark.createDataFrame(plan(counts, size), "length long, first long, slots long, sequence long, at long, per long")
    spread = (runs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SPREAD))))
              .repartition("length", "first", "chunk")
              .withColumn("k", F.explode(F.sequence(F.col("chunk") * SPREAD, F.least(F.col("slots"), (F.col("chunk") + 1) * SPREAD) - 1))))
    slots = spread.select("length", (F.col("first") + F.col("k")).alias("__rank"),
                          (F.col("sequence") + F.expr("k div per")).alias("sequence_id"),
                          (F.col("at") + F.col("k") % F.col("per") * F.col("length")).alias("offset"))
    return (ranked.join(F.broadcast(starts), "length").withColumn("__rank", F.col("__place") - F.col("__start"))
            .join(slots, ["length", "__rank"]).select(*parts.columns, "sequence_id", "offset"))


def sequences(packs: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, from ``packed(pieces(docs))``."""
    of = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``size`` tokens a sequence
    return packs.groupBy("sequence_id").agg(F.flatten(F.transform(of, lambda x: x["ids"])).alias("ids"))


def op11_histogram_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(pieces(C.table(spark, sf_dir, "documents"), ids=False))
