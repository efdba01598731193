"""The vertex of a polyline that is nearest to a point, for polylines of any length.

A polyline's positions form a tree: runs of ``FAN`` vertices, runs of ``FAN`` such
runs, and so on, each with the bounding box of its vertices in space. A point goes
down from the top: at each level it keeps the runs whose box may hold a vertex as
near as the nearest one that another run is sure to hold, and meets their children.
A path that doesn't fold back on itself leaves a run or two a level, so a point meets
a number of vertices that grows with the logarithm of the polyline. The tree is a
table a level, built by grouping positions; no task sees a whole polyline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentier.functions.geo import with_geodesic_m
from sentier.operators.geojoin import _in_space, _slack, located
from sentier.session import materialize

FAN_BITS = 4
FAN = 1 << FAN_BITS
_AXES = ("_x", "_y", "_z")


def _boxes(rows: DataFrame, run, lo: str = "", hi: str = "") -> DataFrame:
    """(shape_id, run) with the box of its rows."""
    box = [f(F.col(f"{p}{c}")).alias(f"{n}{c}") for c in _AXES for n, p, f in (("lo", lo, F.min), ("hi", hi, F.max))]
    return rows.groupBy("shape_id", run.alias("run")).agg(*box)


def _kept(pairs: DataFrame, key: str) -> DataFrame:
    """The pairs of a (shape, point) whose run may hold its nearest vertex."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}"))
    span = lambda c: F.greatest(F.abs(F.col(f"lo{c}") - F.col(c)), F.abs(F.col(f"hi{c}") - F.col(c)))
    length = lambda f: F.sqrt(sum((f(c) * f(c) for c in _AXES), F.lit(0.0)))
    pairs = pairs.withColumns({"_least": length(gap), "_most": length(span)})
    limit = pairs.groupBy(F.col("shape_id").alias("_s"), F.col(key).alias("_k")).agg(F.min("_most").alias("_limit"))
    near = F.col("_least") <= _slack(F.col("_limit"), "geodesic") + 1e-9
    own = F.col("shape_id").eqNullSafe(F.col("_s")) & F.col(key).eqNullSafe(F.col("_k"))
    return pairs.join(limit, own).where(near)


def vertex_pairs(points: DataFrame, vertices: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(shape_id, key, lat, lon, idx, _plat, _plon): the vertices that a point's nearest one is among."""
    pts = located(vertices.select("shape_id", "idx", F.col("lat").alias("_plat"), F.col("lon").alias("_plon")), "_plat", "_plon")
    pts = pts.where(F.col("shape_id").isNotNull())
    longest = pts.agg(F.max("idx")).first()[0]
    ask = located(points.select("shape_id", key, lat, lon).distinct(), lat, lon)
    if longest is None or longest < 2 * FAN:
        return ask.join(pts, "shape_id")
    level = 1
    while longest >> (FAN_BITS * (level + 1)):
        level += 1
    runs = {1: materialize(_boxes(_in_space(pts, "_plat", "_plon", "geodesic"), F.shiftright("idx", FAN_BITS)), "runs")}
    for i in range(2, level + 1):
        runs[i] = materialize(_boxes(runs[i - 1], F.shiftright("run", FAN_BITS), "lo", "hi"), "runs")
    own = ["shape_id", key, lat, lon, *_AXES]
    kept = materialize(_in_space(ask, lat, lon, "geodesic"), "asked").join(runs[level], "shape_id")
    for i in range(level, 0, -1):
        kept = materialize(_kept(kept, key).select(*own, "run"), "kept-runs")
        if i > 1:
            down = runs[i - 1].withColumn("up", F.shiftright("run", FAN_BITS))
            kept = kept.withColumnRenamed("run", "up").join(down, ["shape_id", "up"]).drop("up")
    leaves = pts.withColumn("run", F.shiftright("idx", FAN_BITS))
    return kept.select("shape_id", key, lat, lon, "run").join(leaves, ["shape_id", "run"]).drop("run")


def nearest_vertex(points: DataFrame, vertices: DataFrame, key: str, lat: str, lon: str, out: str) -> DataFrame:
    """(shape_id, key, out): the position of the vertex of the shape that is nearest to
    the point (WGS-84), the first of equally near ones. Points and vertices without
    finite coordinates take no part; a point whose shape has no vertex gives no row."""
    pairs = with_geodesic_m(vertex_pairs(points, vertices, key, lat, lon), "_d", lat, lon, "_plat", "_plon")
    return pairs.groupBy("shape_id", key).agg(F.min_by("idx", F.struct("_d", "idx")).alias(out))
