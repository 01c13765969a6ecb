"""Continuous audit ingestion (N2): Structured Streaming append of N1.

N1 is a per-row map, so the stream is stateless: no watermark, no state
store.  Exactly-once comes from the file sink's commit log plus the
checkpoint, so a restarted query (or a lost executor) neither drops nor
duplicates rows.  The checkpoint and the sink must live on shared storage;
the defaults go under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.audit import AUDIT_COLS, accepted
from ..schemas import EVENTS_RAW
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import audit_events, audit_rows


def raw_event_stream(spark: SparkSession, folder: str, table: str = "events.parquet") -> DataFrame:
    """Stream the raw events: ``table`` in ``folder``, one Parquet file or a folder
    of part files as they arrive (fixed schema, never inferred)."""
    # the stream source takes a single file only as the match of a pattern: [e]vents.parquet
    return spark.readStream.schema(EVENTS_RAW).parquet(f"{folder.rstrip('/')}/[{table[0]}]{table[1:]}")


def start_audit_stream(
    spark: SparkSession,
    source_folder: str,
    sink_path: str,
    checkpoint_path: str,
    available_now: bool = True,
    dedupe_within: str | None = None,
) -> StreamingQuery:
    """Raw events -> N1 -> append-only Parquet audit table.

    ``dedupe_within`` (e.g. ``"1 hour"``): drop events whose ``id`` was already
    seen within that event-time delay, for sources that may redeliver.  This
    keeps bounded state (watermark on ``ts``); without it the job is
    stateless.
    """
    stream = accepted(audit_rows(raw_event_stream(spark, source_folder)))
    if dedupe_within:
        # watermarks need TIMESTAMP; the capture time is TIMESTAMP_NTZ (UTC wall clock)
        stream = (
            stream.withColumn("__event_time", F.col("ts").cast("timestamp"))
            .withWatermark("__event_time", dedupe_within)
            .dropDuplicatesWithinWatermark(["id"])
            .drop("__event_time")
        )
    w = (
        stream.select(*AUDIT_COLS)
        .withColumn("dia", F.to_date("ts"))
        .writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint_path)
        .partitionBy("dia")
        .outputMode("append")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_audit_stream_once(
    spark: SparkSession, source_folder: str, run_root: str | None = None, dedupe_within: str | None = None
) -> DataFrame:
    """Run N2 to completion over what is available and read the sink back.

    Sink and checkpoint go under the shared checkpoint folder, in a fresh
    sub-folder per run.
    """
    root = (run_root or ensure_checkpoint_dir(spark)).rstrip("/")
    run = f"{root}/audit-stream-{uuid.uuid4().hex}"
    q = start_audit_stream(spark, source_folder, f"{run}/sink", f"{run}/checkpoint", dedupe_within=dedupe_within)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{run}/sink").select(*AUDIT_COLS)


def batch_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows computed as a batch job (property: stream == batch)."""
    return accepted(audit_events(spark, sf_dir)).select(*AUDIT_COLS)
