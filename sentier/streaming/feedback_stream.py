"""Feedback ingest as a stream (dedup, validate/explode, resolve place, append)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentier.plans import feedback as FB
from sentier.streaming.common import run_available_now


def ingest_stream(spark: SparkSession, source_dir: str, schema, places: DataFrame, restaurants: DataFrame,
                  ingest_date, sink_path: str, checkpoint: str, files_per_trigger: int = 1) -> DataFrame:
    """Raw classified comments landed under ``source_dir`` → deduplicated by
    ``fid`` within a one-hour watermark on ``received_at`` → F25 explode →
    J10 stream-static joins → idempotent per-batch append. Returns the sink."""
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
           .withWatermark("received_at", "1 hour")
           .dropDuplicatesWithinWatermark(["fid"]))
    rows = FB.ingest_feedback(raw.drop("received_at"), places, restaurants, ingest_date)
    run_available_now(rows, sink_path, checkpoint)
    return spark.read.parquet(sink_path)
