"""Places in a global order, without a window over all rows.

Rows are dealt to ranges of the order and sorted within each; a place is the
number of rows in the ranges before plus the place within the range.  Only one
row per range is ever brought together.  The ordered rows are written first:
another evaluation could sample other range bounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: monotonically_increasing_id keeps the row's place in its partition in the low 33 bits.
_LOW_BITS = 33


def in_shared_folder(df: DataFrame) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ordered-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_place(
    df: DataFrame,
    order: list[Column | str],
    column: str,
    partitions: int | None = None,
    save: Callable[[DataFrame], DataFrame] = in_shared_folder,
) -> DataFrame:
    """``df`` with its rows' places (0, 1, 2...) in ``order`` as a long ``column``.

    Rows that tie in all of ``order`` get places in any order, so give columns
    enough to tell apart what must not be swapped.  A tie of any size is cut
    over several ranges.  An empty ``df`` stays empty.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    rows = save(
        tied.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
        .withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumn("__range", F.shiftright("__id", _LOW_BITS)).withColumn(
        "__id", F.col("__id").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range, so at most n rows are windowed and broadcast
    starts = rows.groupBy("__range").agg(F.count("*").alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (rows.join(F.broadcast(starts), "__range")
            .select(*df.columns, (F.col("__start") + F.col("__id")).alias(column)))
