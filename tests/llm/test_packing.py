"""Best-fit packing against single pieces and the plain tokenizer."""

import random
import zlib
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freightlens.llm import common as C
from freightlens.llm import packing
from tests.conftest import SF_MID

ODD = ["", None, "  \n", "Don't stop, it's. we'll!!", "J̌x J̌,", "<|endoftext|>, <|EndOfText|> a<|startoftext|>b.", "x≮y a≠. é. é. e.́",
       "\xa0a b\x85c d", "İstanbul, ǅ. ß! ﬁ. KK.", "1,234.5. a1. 12:30;", "日本語。テスト.", "a" * 5000, "é" * 3000 + ".", "👍🏽! 👍.", "\x00\x1c\x1d a\x0b.b", "foo?! bar?? baz!."]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def best_fit(lengths: list[int], size: int) -> int:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        insort(rooms, (rooms.pop(at) if at < len(rooms) else size) - n)
    return len(rooms)


@pytest.mark.parametrize("size", [5, 17, 64, 2048])
def test_plan_is_best_fit_of_single_pieces(size):
    rnd = random.Random(size)
    for _ in range(40):
        lengths = [min(size, 1 + int(rnd.expovariate(1 / (size * rnd.choice([0.05, 0.3, 0.6]))))) for _ in range(rnd.choice([1, 3, 50, 700]))]
        taken, inside = set(), {}
        for length, first, slots, sequence, offset, per in packing.plan({n: lengths.count(n) for n in set(lengths)}, size):
            for k in range(slots):
                taken.add((length, first + k))
                inside.setdefault(sequence + k // per, []).append((offset + k % per * length, length))
        assert taken == {(n, k) for n in set(lengths) for k in range(lengths.count(n))}
        for members in inside.values():
            at = 0
            for offset, length in sorted(members):
                assert offset == at
                at += length
            assert at <= size
        assert sorted(inside) == list(range(best_fit(lengths, size)))
    assert packing.plan({}, size) == []


def test_plan_does_not_grow_with_counts():
    small = packing.plan({n: 1000 + n for n in range(1, 65)}, 64)
    large = packing.plan({n: (1000 + n) * 10**9 for n in range(1, 65)}, 64)
    assert len(large) <= 2 * len(small) and sum(x[2] for x in large) == sum((1000 + n) * 10**9 for n in range(1, 65))


def test_ids_are_the_plain_tokenizers(spark, plain):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("text").limit(400).collect()]
    for a, b, buf, offs in C.steps(pa.array(texts)):
        ids, cut = packing.token_ids(buf, offs, packing.tokenizer_path())
        for i in range(a, b):
            assert ids[cut[i - a]:cut[i - a + 1]].tolist() == plain(texts[i])


def test_vocabulary_forgets(monkeypatch, plain):
    monkeypatch.setattr(packing, "KNOWN", 3)
    for text in ("one two three", "two four five", "one six", "two two"):
        buf, offs = C.buffer_of(pa.array([text]))
        assert packing.token_ids(buf, offs, packing.tokenizer_path())[0].tolist() == plain(text)


def test_packed_sequences(spark, plain):
    rows = [(i if i % 7 else None, t, i, "x") for i, t in enumerate(ODD * 3 + ["word " * n for n in (1, 5, 5, 5, 31, 32, 33, 300)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset string").repartition(4)
    packs = packing.packed(packing.pieces(docs, size=32), 32)
    got = packs.collect()
    want = [[*plain(t), 0] for _, t, _, _ in rows]
    cut = sorted((str(r[0]), k, 32 * k, x[32 * k:32 * k + 32]) for r, x in zip(rows, want) for k in range(-(-len(x) // 32)))
    assert sorted((str(r.doc_id), r.piece, r.start, list(r.ids)) for r in got) == cut
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes()) for r in got)
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(packs).collect()}
    assert len(whole) == best_fit([len(x) for *_, x in cut], 32) and max(map(len, whole.values())) <= 32
    assert all(whole[r.sequence_id][r.offset:r.offset + r.length] == list(r.ids) for r in got)
    assert sum(map(len, whole.values())) == sum(map(len, want))
    assert packing.packed(packing.pieces(docs.limit(0), ids=False)).count() == 0


def test_one_length_holds_all(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPREAD", 64)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    got = packing.packed(packing.pieces(docs, size=16, ids=False), 16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 1000 and {r.sequence_id for r in got} == set(range(334))
