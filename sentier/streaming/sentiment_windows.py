"""R2: sentiment counts per 30-day event-time window, late rows kept apart.

Counts of a window add up, so a micro-batch needs no state: it appends the counts of
its own rows, and a reader sums them. The watermark of a batch is the newest event
time of all earlier batches less ``delay`` (each batch logs its newest time). Rows
older than that are late: they are not counted, since their window may have been
published, but kept under their batch id. ``repaired_counts`` merges them, so that
counted and late rows are the rows landed in any order of files, and a window's
published count is known to be final but for what the late table holds.

Each of the three tables (counts, late rows, times) has one directory a batch,
overwritten when a batch is replayed. A batch reads the times of earlier batches
only, so a replay decides as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = "window_start string, sentiment string, n long, batch int"
MARKS = "newest timestamp, batch int"


def event_time(date_col: str) -> F.Column:
    """UTC midnight of a DATE as a TIMESTAMP, independent of the session time zone."""
    return F.timestamp_seconds(F.unix_date(F.col(date_col)).cast("long") * 86400)


def window_counts(rows: DataFrame, window: str = "30 days") -> DataFrame:
    """(window_start, sentiment, n) of rows with an event time ``ts``; rows without one
    have no window and are left out."""
    start = F.date_from_unix_date((F.unix_seconds(F.col("window.start")) / 86400).cast("int")).cast("string")
    return (rows.groupBy(F.window("ts", window), "sentiment").agg(F.count(F.lit(1)).alias("n"))
            .select(start.alias("window_start"), "sentiment", "n"))


def _batch_writer(spark: SparkSession, sink: str, schema, window: str, delay: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        seen = read_marks(spark, sink).where(F.col("batch") < batch_id)
        mark = seen.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
        ts = F.col("ts")
        late = F.lit(False) if mark is None else F.coalesce(ts < F.lit(mark), F.lit(False))
        out = lambda df, name: df.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")
        out(window_counts(batch.where(~late), window), "counts")
        out(batch.where(late).select(*[f.name for f in schema]), "late")
        out(batch.agg(F.max("ts").alias("newest")), "times")
    return write


def read_marks(spark: SparkSession, sink: str) -> DataFrame:
    from sentier.sources.files import exists
    if not exists(spark, f"{sink}/times"):
        return spark.createDataFrame([], MARKS)
    return spark.read.schema(MARKS).parquet(f"{sink}/times")


def run_sentiment_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink: str, checkpoint: str,
                         window: str = "30 days", delay: str = "30 days", files_per_trigger: int = 1) -> None:
    """Count all files landed under ``source_dir`` since the last run into ``sink``."""
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
            .withColumn("ts", event_time("date")))
    (rows.writeStream.foreachBatch(_batch_writer(spark, sink, schema, window, delay))
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def published_counts(spark: SparkSession, sink: str) -> DataFrame:
    """(window_start, sentiment, n) without late rows."""
    return (spark.read.schema(COUNTS).parquet(f"{sink}/counts").groupBy("window_start", "sentiment")
            .agg(F.sum("n").alias("n")))


def late_rows(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """The rows that came too late, with the batch that brought them."""
    fields = [*schema.fields, T.StructField("batch", T.IntegerType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{sink}/late")


def repaired_counts(spark: SparkSession, sink: str, schema: T.StructType, window: str = "30 days") -> DataFrame:
    """The published counts with the late rows of every batch merged."""
    late = window_counts(late_rows(spark, sink, schema).withColumn("ts", event_time("date")), window)
    return (published_counts(spark, sink).unionByName(late).groupBy("window_start", "sentiment")
            .agg(F.sum("n").alias("n")))


def sentiment_windows_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink: str, checkpoint: str,
                             window: str = "30 days", delay: str = "30 days", files_per_trigger: int = 1) -> DataFrame:
    """Run the stream over what has landed, then the repair: right for any file order."""
    run_sentiment_stream(spark, source_dir, schema, sink, checkpoint, window, delay, files_per_trigger)
    return repaired_counts(spark, sink, schema, window)
