"""The table of words that packing keeps from step to step."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from freightlens.llm import common as C
from freightlens.llm import interning, packing


def _ranges(words):
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), ends - size, ends


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_equal_strings_share_a_place_from_buffer_to_buffer(monkeypatch, bits):
    mix = interning.mix
    monkeypatch.setattr(interning, "mix", lambda x: mix(x) & np.uint64((1 << bits) - 1))
    rnd, table, expected = random.Random(5), interning.Places(), {}
    for step in range(6):
        words = [bytes(rnd.choice(b"\0a") for _ in range(rnd.choice([1, 2, 7, 8, 9, 16, 17, 23, 24, 25, 40]))) for _ in range(300)]
        words += [b"a" * k for k in range(1, 30)] + [b"a" * k + b"\0" for k in range(30)]
        buf, starts, ends = _ranges(words)
        place, fresh = table.of(buf, starts, ends)
        for w, p in zip(words, place.tolist()):
            assert expected.setdefault(w, p) == p
        assert len(set(expected.values())) == len(expected) == table.n
        assert [place[i] for i in fresh] == list(range(table.n - len(fresh), table.n))
    assert sorted(table.strings()) == sorted(expected)


def test_table_grows():
    table = interning.Places()
    words = [str(k).encode() for k in range(60_000)] + [b"long" * 10 + str(k).encode() for k in range(50)]
    for part in (words[:10], words[:5000], words, words[::-1]):
        place, _ = table.of(*_ranges(part))
        assert len(set(place.tolist())) == len(part)
    assert table.n == len(words) and table.of(*_ranges([]))[0].tolist() == []
    assert (table.of(*_ranges(words))[0] == place[::-1]).all()


def test_known_words_are_not_encoded_again(monkeypatch):
    packing._vocabulary.cache_clear()
    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    text = "reach Café x7 中文 " + "z" * 30 + " éclair. REACH!! <|endoftext|>"
    buf, offs = C.buffer_of(pa.array([text, "reach", None, ""]))
    expected = [plain.encode(t, add_special_tokens=False).ids for t in (text, "reach", "", "")]
    vocabulary = packing._vocabulary(path)
    for step in range(3):
        ids, cut = packing.token_ids(buf, offs, path)
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == expected
        if not step:
            n, used = vocabulary.words.n, vocabulary.ids
        assert (vocabulary.words.n, vocabulary.ids) == (n, used)
    monkeypatch.setattr(packing, "KNOWN_IDS", 0)
    assert packing.token_ids(buf, offs, path)[0].tolist() == sum(expected, [])
    packing._vocabulary.cache_clear()


def test_words_of_letters_skip_the_normaliser():
    path = packing.tokenizer_path()
    plain, vocabulary, rnd = Tokenizer.from_file(path), packing._vocabulary(path), random.Random(7)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(1, 30))) for _ in range(2000)]
    assert [vocabulary.letters.encode(w, add_special_tokens=False).ids for w in words] == [plain.encode(w, add_special_tokens=False).ids for w in words]
