"""Connected components of a link table, by alternating large-star and
small-star steps.  Every step is a pre-aggregated group-by and a join, each
result is written to the shared folder, and nothing but a flag reaches the
driver.  Links found later are joined by class (``merged``): only links between
classes go through the steps again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; rows may repeat, and there are never more than two per edge."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges  # a > b in every row
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.join(low, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _loose(edges: DataFrame) -> bool:
    """Whether some node is both a centre and a leaf, or a leaf of two centres."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("of")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("of")))
    told = ends.groupBy("node").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.max(F.col("of").isNull()).alias("centre"))
    return told.where("low < high or (low is not null and centre)").limit(1).count() > 0


def stars(links: DataFrame) -> DataFrame:
    """links (a long, b long), any order, repeats allowed -> (node, cls) of every node
    with a smaller one in its component: cls is the component's smallest node."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    done = None
    while _loose(edges):  # a fixpoint is a set of stars
        new = C.saved(_star(_star(edges, True), False).distinct(), "links")
        if done is not None:
            C.forget(done)
        edges = done = new
    out = C.saved(edges.distinct().select(F.col("a").alias("node"), F.col("b").alias("cls")), "classes")
    if done is not None:
        C.forget(done)
    return out


def merged(cls: DataFrame, more: DataFrame) -> DataFrame:
    """``cls`` (of ``stars``) after classes were joined: ``more`` has the ``stars`` of
    links between classes, a node without a class being its own."""
    to = more.select(F.col("node").alias("__was"), F.col("cls").alias("__cls"))
    return (cls.join(to, F.col("cls") == F.col("__was"), "left").select("node", F.coalesce("__cls", "cls").alias("cls"))
            .unionByName(more))
