"""The training-data pipeline: each stage works on all that the one before kept.

A stage gets documents that are written, so it first releases the tables that
earlier stages wrote for themselves; its own result must be written before the
next stage begins, as ``run`` does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freightlens.llm import common as C
from freightlens.llm import decontaminate, mixing, near_dedup, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the rules reject go."""
    C.release(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each class of near copies stays."""
    C.release(spark)
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark window go."""
    C.release(spark)
    return decontaminate.keep_clean(docs, C.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: personal data is masked, n_chars follows."""
    C.release(spark)
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: a row per document: its columns, size, source_size, target, taken
    (words the mix takes of it) and draws (shard, place and copy of each)."""
    C.release(spark)
    return mixing.mixed(docs, docs.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixture", mixture),
]

#: No SQL: tokenisers, verified similarity and drawn blocks are beyond it.  tests/llm holds each stage against its
#: operator, the near-duplicate classes against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = C.scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    C.release(spark)
    return docs
