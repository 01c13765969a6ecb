"""Operator 6: personal data by bootstrapped contextual extraction.  DataFrame
functions only.

Seeds are the spans of four base kinds, leftmost and non-overlapping per kind
over the whole text, failing ones dropped without a retry:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

(The expressions below match the same spans without backtracking over long runs.)

The word before an identifier is its lexical pattern.  Candidates are tokens
after a word that hold an ``@`` or six digits or more.  Patterns and distinct
identifiers form a graph; over ``ROUNDS`` rounds a pattern's confidence is the
mean of its identifiers' (one unknown identifier is added, so that few
observations count less), and an unknown identifier's that of its patterns.
Patterns of at least ``SUPPORT`` distinct seeds and confidence ``ACCEPT``
extract: identifiers behind them that no base kind knows, of confidence
``ACCEPT`` or more, become spans of kind ``context``.

Scores come from group-bys over occurrences (a small share of the corpus), so a
frequent word or identifier costs one row per task; the texts are read once.

Edge cases: null and empty texts have no spans; rows are scanned one by one,
so repeated rows get equal spans, but an identifier counts once per pattern; an
empty table gives an empty result.  Only ``text`` is read (``mask`` writes it,
and ``n_chars`` if there); other columns pass through.
"""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word, white space or one of ``: = # |`` between, and a token that has a digit.
CANDIDATE = r"(?<![\p{L}\p{N}_])[\p{L}_]{2,40}+[\s:=#|]{1,4}+(?=[A-Za-z@._+()-]*+[0-9])[A-Za-z0-9+(][A-Za-z0-9@._+()-]*+"
LEFT = r"^[\p{L}_]++"
GAP = r"^[\p{L}_]++[\s:=#|]++"
ROUNDS, SUPPORT, ACCEPT = 3, 5, 0.8
#: Matches whose positions are summed at a time.
RUN = 64
KINDS = [*BASE, "context"]
_SPANS = "array<struct<start:int,end:int,found:string>>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, regex: str) -> Column:
    """Leftmost non-overlapping matches: structs of start, end (code points) and text.

    Positions are running sums of the lengths between and of the matches: within
    blocks of ``RUN`` matches first, then over the blocks, so that no array grows
    match by match over a whole text."""
    pieces = F.zip_with(
        F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
        lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")))

    def block(some: Column) -> Column:
        return F.aggregate(
            some, F.struct(F.lit(0).alias("to"), F.array().cast(_SPANS).alias("spans")),
            lambda acc, x: F.when(x["found"].isNull(), acc).otherwise(F.struct(
                (acc["to"] + x["gap"] + F.length(x["found"])).alias("to"),
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["to"] + x["gap"]).alias("start"),
                    (acc["to"] + x["gap"] + F.length(x["found"])).alias("end"), x["found"].alias("found")))).alias("spans"))))

    def joined(blocks: Column) -> Column:
        first = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["to"])))
        return F.flatten(F.zip_with(blocks, F.slice(first, F.lit(1), F.size(blocks)), lambda x, to: F.transform(x["spans"], lambda s: F.struct(
            (s["start"] + to).alias("start"), (s["end"] + to).alias("end"), s["found"].alias("found")))))

    spans = _bound(pieces, lambda p: _bound(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: block(F.slice(p, k * RUN + 1, F.lit(RUN)))), joined))
    return F.when(text.rlike(regex), spans).otherwise(F.array().cast(_SPANS))


#: Capitals whose small form takes more than one letter or depends on the letters around: U+0130 and the sigma.
IRREGULAR = "\u0130\u03a3"


@functools.lru_cache(maxsize=1)
def _capitals() -> tuple[str, str]:
    """The other letters that have a small form, and these forms."""
    pairs = [(c, c.lower()) for c in map(chr, range(sys.maxunicode + 1)) if c.lower() != c and c not in IRREGULAR]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def lowered(word: Column) -> Column:
    """``lower`` of a word.  On its first use in a JVM, Spark's ``lower`` title-cases
    every code point for a table, which grows the heap by hundreds of MB; so letters
    are looked up, and only words with ``IRREGULAR`` letters go that way."""
    return F.when(word.rlike(f"[{IRREGULAR}]"), F.lower(word)).otherwise(F.translate(word, *_capitals()))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(number), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """Whether a match of the kind's expression stands."""
    n = F.length(digits(found))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(found, r"\."), lambda x: F.when(F.length(part(x)) > 3, False).otherwise(F.concat(F.lit("0"), part(x)).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(found))).otherwise(False)
    return n.between(10, 15)


def _standing(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: holds(kind, x["found"]))


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with its base spans and candidates, written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = [_standing(k, matches(text, r)).alias(f"__{k}") for k, r in BASE.items()]
    near = F.filter(
        F.transform(matches(text, CANDIDATE), lambda x: F.struct(
            lowered(F.regexp_extract(x["found"], LEFT, 0)).alias("left"),
            (x["start"] + F.length(F.regexp_extract(x["found"], GAP, 0))).alias("start"),
            F.rtrim(F.regexp_replace(F.regexp_replace(x["found"], GAP, ""), r"[.(+-]++$", "")).alias("found"))),
        lambda x: x["found"].contains("@") | (F.length(digits(x["found"])) >= 6) | x["found"].startswith("+"))
    out = docs.select(*keep, *arrays, near.alias("__near"))
    return C.saved(out.withColumn("__uid", F.monotonically_increasing_id()), "personal")


def occurrences(rows: DataFrame) -> DataFrame:
    """(__uid, left, start, end, found, seed): candidates; those where a base span starts or that lie in one are seeds."""
    base = F.concat(*(F.col(f"__{k}") for k in BASE))
    each = rows.where(F.size("__near") > 0).select("__uid", base.alias("base"), F.explode("__near").alias("c"))
    inside = F.filter("base", lambda x: (x["start"] <= F.col("c.start") + F.length("c.found") - 1) & (x["end"] > F.col("c.start")))
    return (each.withColumn("inside", inside)
            .select("__uid", "c.left", "c.start", (F.col("c.start") + F.length("c.found")).alias("end"),
                    F.when(F.size("inside") > 0, F.col("inside")[0]["found"]).otherwise(F.col("c.found")).alias("found"),
                    (F.size("inside") > 0).alias("seed")))


def accepted(occ: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(left, found): the patterns and unknown identifiers that the graph vouches for."""
    edges = C.saved(occ.groupBy("left", "found").agg(F.max("seed").alias("seed")), "personal-graph")
    known = edges.groupBy("found").agg(F.max("seed").alias("seed"))
    score = known.select("found", F.col("seed").cast("double").alias("i_conf"))
    for k in range(rounds):
        patterns = (edges.join(score, "found").groupBy("left")
                    .agg((F.sum("i_conf") / (F.count("*") + 1)).alias("p_conf"), F.sum(F.col("seed").cast("int")).alias("seeds"))
                    .where(F.col("seeds") >= support))
        of = edges.join(patterns, "left").groupBy("found").agg(F.avg("p_conf").alias("mean"))
        score = C.saved(known.join(of, "found", "left").select(
            "found", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("i_conf")), "personal-score")
    unknown = score.join(known.where("not seed"), "found", "left_semi").where(F.col("i_conf") >= accept)
    return edges.where("not seed").join(patterns.where(F.col("p_conf") >= accept), "left").join(unknown, "found").select("left", "found").distinct()


def _tagged(ord_: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), x["end"].alias("end")))


def spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row and ``__spans``: structs start, end, ord of
    all kinds, by start, then kind as in KINDS; ``__email`` to ``__phone`` are the base spans."""
    rows = scanned(docs, keep)
    occ = occurrences(rows)
    new = (occ.where("not seed").join(accepted(occ), ["left", "found"])
           .groupBy("__uid").agg(F.collect_set(F.struct("start", "end")).alias("__more")))
    some = rows.where(F.size("__near") > 0).join(new, "__uid", "left")
    none = rows.where(F.size("__near") <= 0).withColumn("__more", F.lit(None).cast("array<struct<start:int,end:int>>"))
    more = F.coalesce("__more", F.array().cast("array<struct<start:int,end:int>>"))
    tagged = [_tagged(k, a) for k, a in enumerate([*(F.col(f"__{k}") for k in BASE), more])]
    return some.unionByName(none).withColumn("__spans", F.array_sort(F.concat(*tagged)))


def _listed(spans_: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["ord"] + 1)
    return F.concat_ws(",", F.transform(spans_, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))))


def op6_bootstrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    rows = spans(C.table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("__spans", lambda x: x["ord"] < len(BASE))
    return rows.select(
        "doc_id", *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("__spans")).alias("spans"),
        F.size(F.coalesce("__more", F.array().cast("array<struct<start:int,end:int>>"))).cast("long").alias("n_context"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span (overlapping ones together) replaced by its first kind in brackets."""
    name = lambda x: F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), x["ord"] + 1)
    start = F.struct(F.lit(0).alias("to"), F.lit("").alias("out"))
    masked = F.aggregate(
        "__spans", start,
        lambda acc, x: F.when(x["start"] < acc["to"], F.struct(F.greatest(acc["to"], x["end"]).alias("to"), acc["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("to"), F.concat(acc["out"], F.substring(F.col("text"), acc["to"] + 1, x["start"] - acc["to"]), name(x)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["to"] + 1, F.length("text"))))
    out = spans(docs, docs.columns).withColumn("__text", F.when(F.size("__spans") > 0, masked).otherwise(F.col("text")))
    cols = [F.col("__text").alias(c) if c == "text" else
            F.when(F.size("__spans") > 0, F.length("__text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
            for c in docs.columns]
    return out.select(*cols)
