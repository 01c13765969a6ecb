"""Words that share a unit in packing's encoding still get the plain tokenizer's ids."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from freightlens.llm import common as C
from freightlens.llm import packing

ODD = [
    "a$$$ A*** Reach&&& reach.%%% REACH!! café... CAFÉ### naïve,", "J̌$$ Á.. é! İ. İ$$ ×. ÷## ẞ. KK.",
    "<|ENDOFTEXT|>. <|endoftext|>.. x<|endoftext|>$ A<B. <|StartOfText|> don't. DON'T!! it's$$$ 'LL.", "$$$ . ,,, a" + "." * 300 + " b" + "$" * 70 + " 7$ 77.. x̸. ≠ Łódź. ŉ. ſ! ƀ. ǅ. 中.",
    "A B.  C$$ ª. µ# ﬁ. ͅA. Z̀́.",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _ids(texts):
    buf, offs = C.buffer_of(pa.array(texts))
    ids, cut = packing.token_ids(buf, offs, packing.tokenizer_path())
    return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]


def test_signs_and_capitals(plain):
    assert _ids(ODD) == [plain(t) for t in ODD]
    rnd = random.Random(11)
    letters = "aBzZéÉ×İıſǰ̸̌́中7'<|>=.,;:!?#$%&*  \t "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    assert _ids(texts) == [plain(t) for t in texts]


def test_words_that_differ_in_signs_or_capitals_are_encoded_once(monkeypatch):
    packing._vocabulary.cache_clear()
    _ids(["reach reach$$$ Reach*** REACH&&& reach.%%% reach### café café... Café!!"])
    known = packing._vocabulary(packing.tokenizer_path()).known
    assert set(known) == {b"reach", "café".encode(), b"$$$", b"***", b"&&&", b".%%%", b"###", b"...", b"!!"}
    packing._vocabulary.cache_clear()
