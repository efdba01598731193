"""Nearest vertices against brute force, and how many vertices a point meets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sentier.functions.geo import with_geodesic_m
from sentier.operators import polyline as PL

NAN = float("nan")


def _brute(points, verts):
    j = with_geodesic_m(points.join(verts.select("shape_id", "idx", F.col("lat").alias("a"), F.col("lon").alias("b")), "shape_id"),
                        "d", "plat", "plon", "a", "b").where("d IS NOT NULL AND NOT isnan(d)")
    return {tuple(r) for r in j.groupBy("shape_id", "stop").agg(F.min_by("idx", F.struct("d", "idx")).alias("i")).collect()}


@pytest.mark.parametrize("n", [5, 40, 700, 5000])
def test_equals_brute_force(spark, n):
    rnd = random.Random(n)
    verts = []
    for s in range(4):
        lat, lon = 49 + s * 0.1, 1.0
        for i in range(n if s else max(1, n // 7)):
            if s != 3 or i % 5:  # shape 3 stands still now and then: equal vertices
                lat, lon = lat + rnd.uniform(-0.01, 0.011), lon + rnd.uniform(-0.01, 0.012)
            verts.append((s, i, lat, lon))
    verts += [(1, n + 1, None, 1.0), (1, n + 2, NAN, 1.0), (9, 0, None, None)]
    v = spark.createDataFrame(verts, "shape_id int, idx int, lat double, lon double")
    pick = [rnd.choice(verts[:-3]) for _ in range(60)]
    pts = [(x[0], i, x[2] + rnd.uniform(-0.2, 0.2), x[3] + rnd.uniform(-0.2, 0.2)) for i, x in enumerate(pick)]
    pts += [(s, 100 + s, -30.0, 170.0) for s in range(4)] + [(1, 200, None, 1.0), (9, 201, 49.0, 1.0), (8, 202, 49.0, 1.0), (None, 203, 49.0, 1.0)]
    p = spark.createDataFrame(pts, "shape_id int, stop int, plat double, plon double")
    got = {tuple(r) for r in PL.nearest_vertex(p, v, "stop", "plat", "plon", "i").collect()}
    assert got == _brute(p.where("plat IS NOT NULL"), v) and len(got) >= 60


def test_a_point_meets_few_vertices_of_a_long_shape(spark):
    """A spiral of 200,000 vertices: the vertices met per point stay near a hundred."""
    n = 200_000
    i = F.col("id")
    v = spark.range(n).select(F.lit(1).alias("shape_id"), i.cast("int").alias("idx"),
                              (45 + i / n * 3 * F.sin(i / 3000)).alias("lat"), (2 + i / n * 3 * F.cos(i / 3000)).alias("lon"))
    rnd = random.Random(1)
    p = spark.createDataFrame([(1, k, 45 + rnd.uniform(-3, 3), 2 + rnd.uniform(-3, 3)) for k in range(50)],
                              "shape_id int, stop int, plat double, plon double")
    met = PL.vertex_pairs(p, v, "stop", "plat", "plon").count()
    print("vertices met per point", met / 50)
    assert met < 50 * 40 * math.log2(n) / 4
    got = {tuple(r) for r in PL.nearest_vertex(p, v, "stop", "plat", "plon", "i").collect()}
    assert got == _brute(p, v)


def test_empty_tables(spark):
    v = spark.createDataFrame([], "shape_id int, idx int, lat double, lon double")
    p = spark.createDataFrame([(1, 1, 49.0, 1.0)], "shape_id int, stop int, plat double, plon double")
    assert PL.nearest_vertex(p, v, "stop", "plat", "plon", "i").collect() == []
    w = spark.createDataFrame([(1, k, 49.0, 1.0) for k in range(100)], v.schema)
    assert PL.nearest_vertex(p.limit(0), w, "stop", "plat", "plon", "i").collect() == []
    assert [r.i for r in PL.nearest_vertex(p, w, "stop", "plat", "plon", "i").collect()] == [0]
