"""Operator 7: quality rules by tokeniser fertility.

Public vocabularies measure each whole text: characters per token and the
entropy of its token distribution (byte-level BPE), and the share of tokens
that fall back to single bytes (a piece BPE with byte fallback).  A language's
band for each measure is taken from the corpus itself, over its documents of
``MIN_TOKENS`` tokens or more that pass the base rules: the median, widened
``WIDTH`` times the distance to the quartile, and ``MARGIN`` at least.  The
measures of a short text scatter more, with one over the root of its tokens, so
distances are taken and compared as those of ``FULL_TOKENS`` tokens (longer
texts count as that long).  A document outside a band of its language is
rejected.  Entropy is compared as a share of the largest entropy that the
number of tokens, ``FULL_TOKENS`` at most, allows, and only from below (its
edge stays above half the median); byte fallback only from above.

Documents without a language, or of one with fewer than ``MIN_DOCS`` such
documents, use their script's band: it reaches over the bands of the script's
languages that have enough, and over the one that the documents without such a
language give, if they are enough or there is no other.

Base rules come first (see ``op7_fertility``): fewer than 20 words, or more
than 30 % of the words in 8-word windows that occur twice or more.

No token reaches over the end of a word into white space, so a long text is
encoded in runs that are cut there (a word, however long, stays whole).  Byte
fallback is counted over the pieces of the words, one blank between them; a
text whose characters all are pieces has none, and isn't encoded for it.

Edge cases: null, empty and blank texts have no words and fail the base rules;
rows are judged one by one, so ties and repeated rows get equal verdicts; texts
with fewer than ``MIN_TOKENS`` tokens pass the bands; a text's script is the
one that most letters have.  An empty table gives an empty
result.  Only ``text`` and ``lang`` are read; the other columns pass through.
"""

from __future__ import annotations

import base64
import functools
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Where the vocabulary files are on every executor.
VOCABULARIES = "/opt/tokenizers"
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
MIN_TOKENS, FULL_TOKENS, MIN_DOCS, WIDTH = 50, 512, 50, 5.0
#: The least distance of a band's edges from the median: below, above (none: no edge).
MARGIN = {"chars_per_token": (0.15, 0.3), "byte_share": (None, 0.05), "entropy_share": (0.05, None)}
#: Characters encoded at once (and on to the end of a word).
RUN = 100_000
WORD_END = re.compile(r"(?<=\S)(?=[ \n])")
SYMBOLS = b"#*$%&|<>"
#: How the byte-level vocabulary splits text before merging: contractions, letters, digits, signs, white space.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_FIELDS = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
           "n_repeat_words": T.LongType(), "n_tokens": T.LongType(), "chars_per_token": T.DoubleType(),
           "byte_share": T.DoubleType(), "entropy_share": T.DoubleType(), "script": T.StringType()}
MEASURES = T.StructType([T.StructField(k, v) for k, v in _FIELDS.items()])


@functools.lru_cache(maxsize=2)
def vocabularies(folder: str):
    import sentencepiece
    import tiktoken

    with open(f"{folder}/{BYTE_VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_VOCABULARY}")
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
    plain = frozenset(x for x in map(pieces.id_to_piece, range(pieces.vocab_size())) if len(x) == 1) | frozenset(string.whitespace)
    return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), pieces, is_byte, plain


def runs(text: str, most: int = RUN) -> list[str]:
    """The text in runs of ``most`` characters and on to the next end of a word."""
    out, a = [], 0
    while len(text) - a > most and (cut := WORD_END.search(text, a + most)):
        out.append(text[a:cut.start()])
        a = cut.start()
    return [*out, text[a:]]


def byte_share(text: str, folder: str) -> float:
    """The share of the words' pieces that are single bytes."""
    _, pieces, is_byte, plain = vocabularies(folder)
    if plain.issuperset(text):  # every character is a piece, so none falls back
        return 0.0
    ids = np.array([i for x in runs(" ".join(text.split())) for i in pieces.encode(x.strip(" "), num_threads=1)], np.int64)
    return float(is_byte[ids].mean()) if len(ids) else 0.0


def fertility(text: str, folder: str) -> tuple[int, float, float, float]:
    """(tokens, characters per token, byte share, entropy share)."""
    encoding = vocabularies(folder)[0]
    ids = np.concatenate([np.array(encoding.encode_ordinary(x), np.int64) for x in runs(text)])
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    n = np.unique(ids, return_counts=True)[1]
    entropy = float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids))
    return len(ids), len(text) / len(ids), byte_share(text, folder), entropy / float(np.log2(len(ids))) if len(ids) > 1 else 0.0


def script_of(text: str) -> str:
    """The script that most letters have, by the first word of their names."""
    if text.isascii():
        return "LATIN" if re.search("[A-Za-z]", text) else "NONE"
    names: dict[str, int] = {}
    counts = np.bincount(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
    for c in np.flatnonzero(counts).tolist():
        if chr(c).isalpha():
            k = counts[c]
            name = unicodedata.name(chr(c), "OTHER").split()[0]
            names[name] = names.get(name, 0) + int(k)
    return max(sorted(names), key=names.get) if names else "NONE"


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offs])


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeat_words(words: np.ndarray, row: np.ndarray, n: int, size: int = WINDOW) -> np.ndarray:
    """Words within windows that occur twice or more in their text."""
    at, h = C.windows_hash(words, row, size)
    if not len(at):
        return np.zeros(n, np.int64)
    _, index, count = np.unique(h ^ C.mix(row[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    at = at[count[index] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.bincount(row[np.cumsum(edge)[:-1] > 0], minlength=n).astype(np.int64)


def measured(docs: DataFrame, name: str, folder: str = VOCABULARIES) -> DataFrame:
    """``docs`` and a struct column ``name`` of its texts' measures."""

    @F.arrow_udf(MEASURES)
    def measures(text: pa.Array) -> pa.Array:
        cols = {k: [] for k in _FIELDS}
        for a, b, buf, offs in C.steps(text):
            starts, ends, row = C.word_ranges(buf, offs)
            inside = np.zeros(len(buf) + 1, np.int8)
            inside[starts] += 1
            np.add.at(inside, ends, -1)
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(buf) else inside[:0].astype(bool)
            cols["n_words"] += C.counts_of(row, b - a).tolist()
            cols["word_chars"] += _per_row(inside & ((buf & 0xC0) != 0x80), offs).tolist()
            cols["n_symbols"] += _per_row(~C.byte_class(SYMBOLS)[buf], offs).tolist()
            cols["n_repeat_words"] += repeat_words(C.word_hashes(buf, starts, ends), row, b - a).tolist()
            for i in range(a, b):
                x = text[i].as_py() or ""
                cols["n_dup_lines"].append(dup_lines(x))
                for k, v in zip(("n_tokens", "chars_per_token", "byte_share", "entropy_share"), fertility(x, folder)):
                    cols[k].append(v)
                cols["script"].append(script_of(x))
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
        return pa.StructArray.from_arrays([pa.array(cols[k], kinds[t]) for k, t in _FIELDS.items()], names=list(_FIELDS))

    C.small_batches(docs)
    return docs.withColumn(name, measures("text"))


def judged(measures: DataFrame, q: str) -> DataFrame:
    """Adds ``base_failed``, ``fertility_failed`` and ``kept`` to the struct column ``q`` of measures."""
    all_ = C.saved(measures, "quality")
    lang, script, tokens = F.col("lang").cast("string"), F.col(f"{q}.script"), F.col(f"{q}.n_tokens").cast("double")
    base = (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PCT * F.col(f"{q}.n_words"))
    capped = F.least(tokens, F.lit(float(FULL_TOKENS)))
    value = {x: F.col(f"{q}.{x}") for x in MARGIN}
    value["entropy_share"] = value["entropy_share"] * F.log2(tokens) / F.log2(F.greatest(capped, F.lit(2.0)))
    # a short text's distance from a median as that of a text of FULL_TOKENS
    scale = F.sqrt(capped / FULL_TOKENS)

    # small tables are written, so that their size is known: they are broadcast, and only
    # one beyond Spark's threshold would make a join shuffle the documents
    clean = all_.where((tokens >= MIN_TOKENS) & ~base)
    langs = C.saved(clean.where("lang is not null").groupBy(lang.alias("__lang"))
                    .agg(F.count("*").alias("n"), F.mode(script, True).alias("__lang_script")).where(F.col("n") >= MIN_DOCS).drop("n"), "langs")

    def keyed(df: DataFrame) -> DataFrame:
        """With the language, if it has enough documents, and the script whose band counts."""
        return (df.withColumn("__lang0", lang).join(langs, F.col("__lang0") == F.col("__lang"), "left").drop("__lang0")
                .withColumn("__script", F.coalesce("__lang_script", script)).drop("__lang_script"))

    def same(a: str, b: str) -> F.Column:
        return F.col(f"{a}lang").eqNullSafe(F.col(f"{b}lang")) & (F.col(f"{a}script") == F.col(f"{b}script"))

    def percentiles(x: F.Column, *at: float) -> F.Column:
        return F.percentile_approx(x, F.array(*map(F.lit, at)), 10_000)

    own = keyed(clean).select("__lang", "__script", scale.alias("__scale"), *(v.alias(f"__{x}") for x, v in value.items()))
    mids = C.saved(own.groupBy(F.col("__lang").alias("m_lang"), F.col("__script").alias("m_script"))
                   .agg(*(percentiles(F.col(f"__{x}"), 0.5)[0].alias(f"{x}_mid") for x in MARGIN)), "medians")
    units = own.join(mids, same("__", "m_")).groupBy("m_lang", "m_script").agg(
        F.count("*").alias("n"), *(F.first(f"{x}_mid").alias(f"{x}_mid") for x in MARGIN),
        *(percentiles((F.col(f"__{x}") - F.col(f"{x}_mid")) * F.col("__scale"), 0.25, 0.75).alias(f"{x}_off") for x in MARGIN))

    def ends(x: str, down: F.Column, up: F.Column) -> list[F.Column]:
        return [F.min(f"{x}_mid").alias(f"{x}_low"), F.max(down).alias(f"{x}_down"), F.max(f"{x}_mid").alias(f"{x}_high"), F.max(up).alias(f"{x}_up")]

    def edges(df: DataFrame, key: F.Column) -> DataFrame:
        return df.groupBy(key.alias("b_lang"), F.col("m_script").alias("b_script")).agg(*(e for x, (down, up) in MARGIN.items() for e in ends(
            x, F.greatest(-WIDTH * F.col(f"{x}_off")[0], F.lit(down or 0.0)), F.greatest(WIDTH * F.col(f"{x}_off")[1], F.lit(up or 0.0)))))

    units = C.saved(units, "units")
    spoken = units.where("m_lang is not null")
    # a script's band: over its languages', and that of its other documents if they are enough or alone
    others = units.where(f"m_lang is null and n >= {MIN_DOCS}").unionByName(
        units.where(f"m_lang is null and n < {MIN_DOCS}").join(spoken.select("m_script").distinct(), "m_script", "left_anti"))
    bands = C.saved(edges(spoken, F.col("m_lang")).unionByName(edges(spoken.unionByName(others), F.lit(None).cast("string"))), "bands")

    def beyond(x: str, up: bool) -> F.Column:
        if up:
            return (value[x] - F.col(f"{x}_high")) * scale > F.col(f"{x}_up")
        return (value[x] - F.col(f"{x}_low")) * scale < -F.col(f"{x}_down")

    odd = (beyond("chars_per_token", False) | beyond("chars_per_token", True) | beyond("byte_share", True)
           | beyond("entropy_share", False) | (value["entropy_share"] < F.col("entropy_share_low") / 2))
    odd = F.coalesce(odd, F.lit(False)) & (tokens >= MIN_TOKENS)
    return (keyed(all_).join(bands, same("__", "b_"), "left")
            .withColumn(q, F.struct(f"{q}.*", base.alias("base_failed"), odd.alias("fertility_failed"), (~base & ~odd).alias("kept")))
            .select(*measures.columns))


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base counts, base_failed, kept, and the fertility measures."""
    q = "__quality"
    return judged(measured(C.table(spark, sf_dir, "documents"), q).select("doc_id", "lang", q), q).select(
        "doc_id", *(f"{q}.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                        "fertility_failed", "n_tokens", "chars_per_token", "byte_share", "entropy_share")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    q = "__quality"
    return judged(measured(docs, q), q).where(f"{q}.kept").select(*docs.columns)
