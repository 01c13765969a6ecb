"""Operator 3: secret scans by one combined deterministic automaton.

All rules are compiled (subset construction, minimisation) into one transition
array, which reads every byte of every text once.  Bytes that no rule has (line
ends, commas, all beyond ASCII) lead every state back to the start; the text
between two of them is a lane, and numpy steps all lanes of a batch together.
Where the automaton reports a rule's head, the rule's own anchored automaton gives
the matches in that lane: leftmost, longest, non-overlapping.

Base kinds as fixed: assign (value of 6 characters or more, else dropped),
access (20 or more), hex (24 or more).  Their expressions below carry the two
run lengths, which gives the same spans: a run that is too short has no longer
match inside.  More kinds are known token formats; they add spans.

Edge cases: null and empty texts have no spans; rows are scanned one by one, so
repeated rows get equal spans; an empty table gives an empty result.  Memory: a
batch of texts and a few integers per lane; a lane that outlasts all others is
read on its own.  Only ``text`` is read; other columns pass through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .automaton import compile_rules

#: kind: (head, rest): the combined automaton looks for heads, so that run lengths of
#: different rules don't multiply its states; the anchored one has head and rest.
BASE = ("assign", "access", "hex")
RULES: dict[str, tuple[bytes, bytes]] = {
    "assign": (rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", rb"[A-Za-z0-9+/_.=-]*"),
    "access": (rb"AKIA[A-Z0-9]", rb"[A-Z0-9]{15,}"),
    "hex": (rb"[0-9a-f]{24}", rb"[0-9a-f]*"),
    "github": (rb"gh[opsur]_[A-Za-z0-9]", rb"[A-Za-z0-9]*"),
    "google": (rb"AIza[0-9A-Za-z_-]", rb"[0-9A-Za-z_-]*"),
    "slack": (rb"xox[abprs]-[0-9A-Za-z-]", rb"[0-9A-Za-z-]*"),
    "stripe": (rb"[rs]k_(live|test)_[0-9A-Za-z]", rb"[0-9A-Za-z]*"),
    "jwt": (rb"eyJ[0-9A-Za-z_-]", rb"[0-9A-Za-z_-]*\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+"),
    "private": (rb"-----BEGIN ", rb"([A-Z0-9]+ )*PRIVATE KEY-----"),
}
LEAST = {"github": 40, "google": 39, "slack": 20, "stripe": 24, "jwt": 30}
VALUE = 6
KINDS = list(RULES)
#: Lanes fewer than this are read one by one.
FEW = 96


@functools.lru_cache(maxsize=1)
def automata():
    whole = [compile_rules([head + rest], anchored=True) for head, rest in RULES.values()]
    return compile_rules([head for head, _ in RULES.values()]), whole, np.logical_or.reduce([a.used() for a in whole])


@functools.lru_cache(maxsize=1)
def _tables():
    """The combined automaton for numpy (states times classes, flat) and for single lanes (by byte)."""
    a = automata()[0]
    width = a.next.shape[1]
    flat = (a.next * width).astype(np.int32).reshape(-1)
    found = np.repeat(a.accept, width).astype(np.int32)
    by_byte = a.next[:, a.cls].tolist()
    return a, width, flat, found, by_byte


def lanes(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, row) of the runs of bytes that rules have."""
    return C.word_ranges(buf, offs, bytes(np.flatnonzero(~automata()[2]).astype(np.uint8)))


def scan(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rules (bits) that the automaton reports in each lane; one pass over the bytes."""
    a, width, flat, found, by_byte = _tables()
    order = np.argsort(starts - ends, kind="stable")  # longest first
    at, length = starts[order], (ends - starts)[order]
    state = np.zeros(len(at), np.int32)
    seen = np.zeros(len(at), np.int32)
    classes = a.cls[buf]
    j, falling = 0, -length
    while True:
        k = int(np.searchsorted(falling, -j, side="left"))  # lanes longer than j
        if k < FEW:
            break
        state[:k] = flat[state[:k] + classes[at[:k] + j]]
        seen[:k] |= found[state[:k]]
        j += 1
    accept = a.accept.tolist()
    for i in range(k):
        s, bits = int(state[i]) // width, int(seen[i])
        for b in buf[at[i] + j:at[i] + length[i]].tobytes():
            s = by_byte[s][b]
            bits |= accept[s]
        seen[i] = bits
    out = np.zeros(len(at), np.int32)
    out[order] = seen
    return out


#: Bytes that a run may go beyond its last match before it is remembered.
LONG = 64


@functools.lru_cache(maxsize=len(RULES))
def _single(kind: int):
    a = automata()[1][kind]
    first = a.next[0, a.cls] != a.dead if a.dead >= 0 else np.ones(256, bool)
    return a.next[:, a.cls].tolist(), a.accept.astype(bool).tolist(), a.dead, first.tolist()


def matches(lane: bytes, kind: int) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of one rule.

    A state at a place from which no match was reached is remembered, once a run
    goes ``LONG`` bytes for nothing; later runs that come there stop.  So the work
    is bounded by the bytes times the rule's states."""
    step, accept, dead, first = _single(kind)
    out, i, width, hopeless = [], 0, len(step), set()
    while i < len(lane):
        end, j = -1, i
        if first[lane[i]]:
            s = 0
            for j in range(i, len(lane)):
                s = step[s][lane[j]]
                if s == dead or (hopeless and j * width + s in hopeless):
                    break
                if accept[s]:
                    end = j + 1
            if j - max(i, end) > LONG:
                s = 0
                for k in range(i, j + 1):
                    s = step[s][lane[k]]
                    if k >= end and s != dead:
                        hopeless.add(k * width + s)
        if end > 0:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out


def stands(kind: str, found: bytes) -> bool:
    if kind == "assign":
        key = min(x for x in (found.find(b":"), found.find(b"=")) if x >= 0)
        value = found[key + 1:].lstrip(b" ")
        return len(value[1:] if value[:1] in (b'"', b"'") else value) >= VALUE
    return len(found) >= LEAST.get(kind, 0)


def spans_of(text: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points of each text, sorted."""
    out: list[list[tuple[int, int, int]]] = []
    for a, b, buf, offs in C.steps(text):
        here: list[list[tuple[int, int, int]]] = [[] for _ in range(a, b)]
        starts, ends, row = lanes(buf, offs)
        bits = scan(buf, starts, ends)
        done = [-1, 0, 0]  # row, byte and code point counted so far
        for i in np.flatnonzero(bits):
            r, lane = int(row[i]), buf[starts[i]:ends[i]].tobytes()
            if r != done[0]:
                done = [r, int(offs[r]), 0]
            done[2] += int(np.count_nonzero((buf[done[1]:starts[i]] & 0xC0) != 0x80))
            done[1] = int(starts[i])
            for k, kind in enumerate(KINDS):
                if bits[i] >> k & 1:
                    # no rule has a byte beyond ASCII, so within a lane bytes are code points
                    for f, t in matches(lane, k):
                        if stands(kind, lane[f:t]):
                            here[r].append((done[2] + f, k, done[2] + t))
        out += [sorted(x) for x in here]
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def found(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """``docs`` with an array of the secrets' kind, start and end, by start, then kind as in KINDS."""

    @F.arrow_udf(T.ArrayType(SPAN))
    def scanned(text: pa.Array) -> pa.Array:
        rows = [[{"kind": KINDS[k], "start": f, "end": t} for f, k, t in x] for x in spans_of(text)]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    C.small_batches(docs)
    return docs.withColumn(name, scanned("text"))


def op3_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = found(C.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return rows.select(
        "doc_id", *(_count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secrets", text)).alias("spans"))


def _count(kind: str) -> F.Column:
    return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
