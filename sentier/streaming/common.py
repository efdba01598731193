"""Helpers shared by the streaming jobs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1 << 20


def land_in_order(df: DataFrame, path: str, order_col: str, n_slices: int) -> None:
    """Land a table as ``n_slices`` writes in ``order_col`` order (NULLs first),
    so modification times follow the order (file sources pick files oldest
    first). The table is read twice: for the bounds and for one range shuffle that
    puts each slice in files of its own. A slice has a file for every
    ``ROWS_PER_FILE`` rows, however many tasks wrote it: a stream that takes a file at
    a time has as many batches as there are files. These have no order among
    themselves: a job that reads them one by one must allow for a disorder of one
    slice (its watermark's delay)."""
    bounds = df.select(F.percentile_approx(order_col, [i / n_slices for i in range(1, n_slices)], 10000)
                       .alias("q")).first()["q"] if n_slices > 1 else []
    part = F.lit(0)
    for q in bounds or []:
        part = part + F.coalesce((F.col(order_col) > F.lit(q)).cast("int"), F.lit(0))
    staged = f"{path.rstrip('/')}-slices"
    # ranges of (slice, order): a slice spans as many tasks as it holds ranges, not every input task
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.withColumn("_slice", part).repartitionByRange(max(n, n_slices), "_slice", order_col)
     .write.partitionBy("_slice").parquet(staged))
    slices = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(staged)
    sizes = dict(slices.groupBy("_slice").count().collect())  # a row a slice
    for i in range(len(bounds or []) + 1):
        files = -(-sizes.get(i, 0) // ROWS_PER_FILE) or 1
        slices.where(F.col("_slice") == i).drop("_slice").coalesce(files).write.mode("append").parquet(path)


def land_marker(spark: SparkSession, path: str, schema: T.StructType, time_col: str, at) -> None:
    """Land one row that holds nothing but a time: it moves the watermark on after
    the last rows of a source that ends, so that what waits for it is released."""
    row = [F.lit(at).cast("timestamp").alias(f.name) if f.name == time_col else F.lit(None).cast(f.dataType).alias(f.name)
           for f in schema.fields]
    spark.range(1).select(*row).write.mode("append").parquet(path)


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """A setting for the time of a call; the session gets its own back."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def idempotent_sink(path: str):
    """foreachBatch writer: batch ``b`` goes to ``path/batch=b`` (overwritten
    when the batch is replayed after a failure)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def run_available_now(stream: DataFrame, sink_path: str, checkpoint: str, output_mode: str = "append") -> None:
    q = (stream.writeStream.outputMode(output_mode)
         .foreachBatch(idempotent_sink(sink_path))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def read_sink(spark: SparkSession, sink_path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(sink_path) if schema else spark.read.parquet(sink_path)
