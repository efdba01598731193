"""R2: windowed counts for any file layout, late rows kept and merged."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentier.session import shared_path
from sentier.streaming import sentiment_windows as SW

SCHEMA = "fid long, date date, sentiment string"


def _feedback(spark):
    rnd = random.Random(8)
    day = dt.date(2000, 1, 1)
    rows = [(i, day + dt.timedelta(days=i // 4), rnd.choice(["Négatif", "Neutre", "Positif"])) for i in range(1600)]
    return spark.createDataFrame(rows + [(1600, None, "Neutre")], SCHEMA)


def _counts(df):
    return sorted((r.window_start, r.sentiment, r.n) for r in df.collect())


@pytest.mark.parametrize("files", [1, 8, 40])
def test_counted_and_late_rows_are_the_rows_landed(spark, files):
    fb = _feedback(spark)
    src, sink = shared_path(spark, "src"), shared_path(spark, "sink")
    fb.repartition(files, "fid").write.parquet(src)  # every file spans all days
    SW.run_sentiment_stream(spark, src, fb.schema, sink, shared_path(spark, "ckpt"), files_per_trigger=max(1, files // 5))
    late = SW.late_rows(spark, sink, fb.schema)
    counted = SW.published_counts(spark, sink).agg(F.sum("n")).first()[0]
    assert counted + late.where("date IS NOT NULL").count() == 1600
    assert (late.count() > 0) == (files > 1)
    want = _counts(SW.window_counts(fb.where("date IS NOT NULL").withColumn("ts", SW.event_time("date"))))
    assert _counts(SW.repaired_counts(spark, sink, fb.schema)) == want


def test_files_in_order_make_no_late_rows_and_later_files_are_added(spark):
    fb = _feedback(spark).where("date IS NOT NULL")
    src, sink, ckpt = (shared_path(spark, x) for x in ("src", "sink", "ckpt"))
    for i in range(4):
        fb.where(f"fid >= {400 * i} AND fid < {400 * i + 400}").coalesce(1).write.mode("append").parquet(src)
        SW.run_sentiment_stream(spark, src, fb.schema, sink, ckpt)
        assert SW.published_counts(spark, sink).agg(F.sum("n")).first()[0] == 400 * (i + 1)
    assert SW.late_rows(spark, sink, fb.schema).count() == 0
    # a file that comes months later is late as a whole, and the repair finds its windows
    fb.where("fid < 100").withColumn("sentiment", F.lit("Neutre")).coalesce(1).write.mode("append").parquet(src)
    SW.run_sentiment_stream(spark, src, fb.schema, sink, ckpt)
    late = SW.late_rows(spark, sink, fb.schema)
    assert late.count() == 100 and late.select("batch").distinct().count() == 1
    assert SW.published_counts(spark, sink).agg(F.sum("n")).first()[0] == 1600
    assert sum(x[2] for x in _counts(SW.repaired_counts(spark, sink, fb.schema))) == 1700


def test_a_replayed_batch_decides_as_before(spark):
    fb = _feedback(spark)
    sink = shared_path(spark, "sink")
    write = SW._batch_writer(spark, sink, fb.schema, "30 days", "30 days")
    rows = fb.withColumn("ts", SW.event_time("date"))
    for part, batch in (("fid >= 800", 0), ("fid < 800", 1), ("fid >= 800", 0), ("fid < 800", 1)):
        write(rows.where(part), batch)
    assert SW.published_counts(spark, sink).agg(F.sum("n")).first()[0] + SW.late_rows(spark, sink, fb.schema).where(
        "date IS NOT NULL").count() == 1600
