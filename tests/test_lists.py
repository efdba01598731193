"""Nearest search by lists of points: pairs never leave the query's row."""

import random

import pytest

from sentier.operators import geojoin as GJ
from sentier.plans import transit as TR

N = dict(q_key="q", p_key="p", q_lat="qa", q_lon="qo", p_lat="pa", p_lon="po", metric="geodesic")


@pytest.mark.parametrize("small", [False, True])
def test_lists_match_brute_force(spark, small, monkeypatch):
    """Several lists a cell, and the shuffled join, give the pairs that brute force gives."""
    from pyspark.sql import functions as F

    from sentier.functions.geo import geodesic_m
    if small:
        monkeypatch.setattr(GJ, "LIST_POINTS", 18)
        monkeypatch.setattr(GJ, "BROADCAST_MAX_BYTES", 0)
    rnd = random.Random(3)
    at = lambda: (49.4 + rnd.random() / 10, 1.05 + rnd.random() / 10)
    q = spark.createDataFrame([(i, *at(), i % 2) for i in range(40)], "q long, qa double, qo double, g int")
    p = spark.createDataFrame([(i, *at(), i % 2) for i in range(300)], "p long, pa double, po double, g int")
    got = GJ.nearest_k(q, p, 3, by=("g",), **N).select("q", "p", "rank").collect()
    all_pairs = q.join(p, "g").withColumn("d", geodesic_m("qa", "qo", "pa", "po"))
    want = GJ.top_k_per_group(all_pairs, ["q"], [F.col("d"), F.col("p")], 3).select("q", "p", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stops_of_other_routes_are_no_candidates(spark):
    """However many stops of other routes are at hand, only those that share one with
    the reference stop are searched."""
    refs = spark.createDataFrame([(1,)], "ref_stop_id long")
    sr = spark.createDataFrame([(1, 7), (2, 7), (1, None), (3, None)] + [(i, 8) for i in range(10, 200)], "stop_id long, route_id long")
    assert sorted(r.cand_id for r in TR.route_neighbours(refs, sr).collect()) == [1, 2]


def test_a_slice_lands_in_as_many_files_as_its_rows_ask_for(spark, tmp_path, monkeypatch):
    """Not in as many as the session has tasks: each file is a batch of the stream."""
    import glob

    from sentier.streaming import common as SC
    monkeypatch.setattr(SC, "ROWS_PER_FILE", 400)
    with SC.session_setting(spark, "spark.sql.shuffle.partitions", "64"):
        SC.land_in_order(spark.range(2000).repartition(16), str(tmp_path / "src"), "id", 4)
    assert spark.read.parquet(str(tmp_path / "src")).count() == 2000
    assert 4 <= len(glob.glob(str(tmp_path / "src" / "*.parquet"))) <= 8


@pytest.mark.parametrize("metric", ["sphere", "geodesic"])
def test_a_batch_of_lists_is_searched_at_once(monkeypatch, metric):
    """Arrays, not an interpreted loop per point: empty and missing lists, fewer points
    than asked for, equal places (by key), a query's own key, points out of the radius."""
    import pyarrow as pa
    monkeypatch.setattr(GJ, "BATCH_QUERIES", 3)
    near = [{"key": k, "lat": 49.4 + d, "lon": 1.1} for k, d in (("e", 0.003), ("b", 0.001), ("a", 0.001), ("c", 0.0), ("d", 0.5))]
    rows = pa.RecordBatch.from_pylist([
        {"q": "c", "qa": 49.4, "qo": 1.1, "_list": near}, {"q": "x", "qa": 49.4, "qo": 1.1, "_list": None},
        {"q": "y", "qa": 49.4, "qo": 1.1, "_list": []}, {"q": "z", "qa": 49.4, "qo": 1.1, "_list": near[:1]},
        {"q": "b", "qa": 49.4, "qo": 1.1, "_list": near}])
    out = [r for b in GJ._k_best(3, "q", "qa", "qo", metric, True, 5.0)(iter([rows])) for r in b.to_pylist()]
    assert {r["q"]: [p["key"] for p in r["_best"]] for r in out} == {
        "c": ["a", "b", "e"], "x": [], "y": [], "z": ["e"], "b": ["c", "a", "e"]}
    km = {p["key"]: p["dist"] for r in out for p in r["_best"]}
    assert km["c"] == 0.0 and km["a"] == km["b"] and abs(km["a"] - 0.1112) < 0.0003
