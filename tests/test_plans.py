"""Plan assertions: the physical strategies the design relies on."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as E
from sentier.plans import catalog as CA
from sentier.sources.tables import role

from conftest import SMOKE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stages(monkeypatch):
    """The plans of all stages written on the way: a written stage cuts lineage,
    so the last plan alone shows only the tail."""
    seen = []
    write = DataFrameWriter.parquet

    def record(self, *args, **kw):
        seen.append(plan(self._df))
        return write(self, *args, **kw)
    monkeypatch.setattr(DataFrameWriter, "parquet", record)
    return seen


def test_no_cartesian_in_headline_jobs(spark, stages):
    for key in ("recommend_places", "vector_knn", "nearest_stop", "plan_transit_trips", "rag_retrieve",
                "query_location", "feedback_dashboard", "nearest_station", "nearest_places"):
        stages.append(plan(E.queries()[key](spark, SMOKE)))
        for p in stages:
            assert "CartesianProduct" not in p, key
            assert "BroadcastNestedLoopJoin" not in p, key
        stages.clear()


def test_no_python_udf_in_dashboard_and_transit(spark, stages):
    for key in ("feedback_dashboard", "plan_transit_trips", "recommend_places"):
        stages.append(plan(E.queries()[key](spark, SMOKE)))
    for p in stages:
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_grid_join_broadcasts_small_side(spark, stages):
    stages.append(plan(E.queries()["nearest_stop"](spark, SMOKE)))
    assert any("BroadcastHashJoin" in p for p in stages)


def test_single_page_is_top_k(spark):
    p = plan(CA.places_page(role(spark, SMOKE, "v_places"), 2, county="2"))
    assert "TakeOrderedAndProject" in p


def test_prefix_filter_reaches_parquet(spark):
    df = spark.read.parquet(f"{SMOKE}/part.parquet").where(F.col("p_type").startswith("ECONOMY"))
    assert "StringStartsWith" in df._jdf.queryExecution().executedPlan().toString()


def test_top_k_per_group_uses_group_limit(spark):
    p = plan(E.queries()["recommend_places"](spark, SMOKE))
    assert "WindowGroupLimit" in p


def test_exploded_slots_are_not_broadcast(spark):
    from sentier.plans import bikes as BK
    hist = spark.createDataFrame([(i, 5.0, 6.0) for i in range(4)], "station_id long, bikes double, docks double")
    slots = spark.range(4).select(F.col("id").alias("station_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    slots = slots.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    keyed = BK.with_means(slots, BK.station_means(hist)).where("mean_bikes IS NOT NULL")
    assert keyed.count() == 4 * 168
    assert "Broadcast" not in plan(keyed)


def test_native_operators_run_no_python(spark, stages):
    for key in ("op1_chat_format", "op5_license_scan", "op9_mixing", "op10_decontamination"):
        if key in E.queries():
            stages.append(plan(E.queries()[key](spark, SMOKE)))
    for p in stages:
        assert not any(x in p for x in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMap"))
