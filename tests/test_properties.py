"""Property tests: pruned / gridded operators equal brute force."""

import math
import random

from pyspark.sql import functions as F

from sentier.functions import geo as G
from sentier.operators.geojoin import nearest_k, radius_join
from sentier.operators.ranking import global_row_number


def _gc(a, b, c, d, r=6371.009):
    p1, l1, p2, l2 = map(math.radians, (a, b, c, d))
    dl = l2 - l1
    num = math.hypot(math.cos(p2) * math.sin(dl), math.cos(p1) * math.sin(p2) - math.sin(p1) * math.cos(p2) * math.cos(dl))
    den = math.sin(p1) * math.sin(p2) + math.cos(p1) * math.cos(p2) * math.cos(dl)
    return r * math.atan2(num, den)


def _points(n, seed, lat=(-85, 85), lon=(-180, 180)):
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(*lat), rnd.uniform(*lon)) for i in range(n)]
    # clusters near the antimeridian and the poles
    pts += [(n + i, rnd.uniform(-1, 1) + 10, 179.99 - rnd.random() * 0.05) for i in range(20)]
    pts += [(n + 20 + i, rnd.uniform(-1, 1) + 10, -179.99 + rnd.random() * 0.05) for i in range(20)]
    pts += [(n + 40 + i, 89.5 + rnd.random() * 0.4, rnd.uniform(-180, 180)) for i in range(20)]
    return pts


def test_radius_join_equals_brute_force(spark):
    q = _points(150, 1)
    p = _points(300, 2)
    for radius in (50.0, 400.0, 3000.0):
        for bc in (True, False):
            qd = spark.createDataFrame(q, "qid long, qlat double, qlon double")
            pd_ = spark.createDataFrame(p, "pid long, plat double, plon double")
            got = radius_join(qd, pd_, radius, q_lat="qlat", q_lon="qlon", p_lat="plat", p_lon="plon",
                              broadcast=bc, q_key="qid")
            got = {(r.qid, r.pid) for r in got.collect()}
            want = {(a[0], b[0]) for a in q for b in p if _gc(a[1], a[2], b[1], b[2]) <= radius}
            # tolerate only pairs within 1e-6 km of the edge
            diff = got ^ want
            edge = [d for d in diff
                    if abs(_gc(*[x for x in q if x[0] == d[0]][0][1:], *[x for x in p if x[0] == d[1]][0][1:]) - radius) > 1e-6]
            assert not edge, (radius, bc, edge[:5])


def test_nearest_k_equals_brute_force(spark):
    q = _points(60, 3)
    p = _points(200, 4)
    qd = spark.createDataFrame(q, "qid long, qlat double, qlon double")
    pd_ = spark.createDataFrame(p, "pid long, plat double, plon double")
    got = nearest_k(qd, pd_, 5, q_key="qid", p_key="pid", q_lat="qlat", q_lon="qlon", p_lat="plat", p_lon="plon",
                    start_km=10.0)
    got = sorted((r.qid, r.rank, r.pid) for r in got.collect())
    want = []
    for a in q:
        ds = sorted((_gc(a[1], a[2], b[1], b[2]), b[0]) for b in p)[:5]
        want += [(a[0], i + 1, pid) for i, (_, pid) in enumerate(ds)]
    assert got == sorted(want)


def _vincenty(lat1, lon1, lat2, lon2):
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    L = math.radians(lon2 - lon1)
    U1, U2 = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2)))
    sU1, cU1, sU2, cU2 = math.sin(U1), math.cos(U1), math.sin(U2), math.cos(U2)
    lam = L
    for _ in range(200):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(cU2 * sl, cU1 * sU2 - sU1 * cU2 * cl)
        if ss == 0:
            return 0.0
        cs = sU1 * sU2 + cU1 * cU2 * cl
        sig = math.atan2(ss, cs)
        sa = cU1 * cU2 * sl / ss
        c2a = 1 - sa * sa
        c2sm = cs - 2 * sU1 * sU2 / c2a if c2a else 0.0
        C = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        prev = lam
        lam = L + (1 - C) * f * sa * (sig + C * ss * (c2sm + C * cs * (-1 + 2 * c2sm * c2sm)))
        if abs(lam - prev) < 1e-13:
            break
    u2 = c2a * (a * a - b * b) / (b * b)
    A = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    B = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    ds = B * ss * (c2sm + B / 4 * (cs * (-1 + 2 * c2sm * c2sm) - B / 6 * c2sm * (-3 + 4 * ss * ss) * (-3 + 4 * c2sm * c2sm)))
    return b * A * (sig - ds)


def test_geodesic_matches_vincenty_at_city_scale(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        la, lo = rnd.uniform(-60, 60), rnd.uniform(-180, 180)
        rows.append((la, lo, la + rnd.uniform(-0.2, 0.2), lo + rnd.uniform(-0.2, 0.2)))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(G.geodesic_m("a", "b", "c", "d")).collect()]
    for (a, b, c, d), m in zip(rows, got):
        v = _vincenty(a, b, c, d)
        assert abs(m - v) <= 2e-6 * v + 1e-6


def test_global_row_number_matches_sort(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, 1.0, 2.0, 3.5, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, s double").repartition(7)
    got = global_row_number(df, [F.asc_nulls_last("s"), F.asc("id")], "rank", num_partitions=5)
    got = sorted((r["rank"], r.id) for r in got.collect())
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0, r[0]))
    assert [g[1] for g in got] == [w[0] for w in want]
    assert [g[0] for g in got] == list(range(1, 3001))


def test_rank_within_groups_and_chunks(spark):
    from sentier.operators.ranking import rank_within_groups
    from sentier.plans.feedback import feedback_concat
    import datetime as dt
    rnd = random.Random(11)
    # one hot group holding most rows, many small ones
    rows = [(i, "hot" if i % 3 else f"g{i % 17}", dt.date(2020, 1, 1), f"t{i}") for i in range(2500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "fid long, tsid string, date date, feedback string").repartition(6)
    got = rank_within_groups(df, ["tsid"], [F.col("fid")], "pos", "n")
    got = {r.fid: (r.pos, r.n) for r in got.collect()}
    by = {}
    for fid, g, _, _ in sorted(rows):
        by.setdefault(g, []).append(fid)
    for g, fids in by.items():
        for i, fid in enumerate(fids):
            assert got[fid] == (i + 1, len(fids))
    chunks = feedback_concat(df, max_per_chunk=100).where("tsid = 'hot'").collect()
    assert sum(r.n_feedback for r in chunks) == len(by["hot"])
    assert max(r.n_feedback for r in chunks) == 100
    whole = ";".join(r.corpus for r in sorted(chunks, key=lambda r: r.chunk))
    assert whole == ";".join(f"t{f}" for f in by["hot"])


def test_running_sum_within_groups(spark):
    from sentier.operators.ranking import running_sum_within_groups
    rnd = random.Random(13)
    rows = [("hot" if rnd.random() < 0.6 else f"s{rnd.randrange(20)}", i, float(rnd.randrange(100))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, seq long, v double").repartition(5)
    got = running_sum_within_groups(df, ["g"], [F.col("seq")], "v", "cum", exclusive=True, num_partitions=6)
    got = {(r.g, r.seq): r.cum for r in got.collect()}
    acc = {}
    for g, seq, v in sorted(rows, key=lambda r: (r[0], r[1])):
        assert abs(got[(g, seq)] - acc.get(g, 0.0)) < 1e-6
        acc[g] = acc.get(g, 0.0) + v


def test_shape_points_match_a_plain_loop(spark):
    from sentier.plans.transit import shape_points
    from sentier.sources.tables import role
    from conftest import SMOKE
    shapes = role(spark, SMOKE, "v_shapes")
    got = {(r.shape_id, r.idx): r for r in shape_points(shapes).collect()}
    by = {}
    for r in shapes.collect():
        by.setdefault(r.shape_id, []).append((r.seq, r.lat, r.lon))
    assert len(got) == sum(map(len, by.values())) > 0
    for shape, pts in by.items():
        cum = 0.0
        for i, (_, lat, lon) in enumerate(sorted(pts)):
            r = got[(shape, i)]
            assert (r.lat, r.lon) == (lat, lon) and abs(r.cum_km - cum) < 1e-9
            assert (r.next_lat is None) == (i == len(pts) - 1)
            cum += r.seg_km


def test_running_sum_is_not_touched_by_other_groups(spark):
    from sentier.operators.ranking import running_sum_within_groups
    rows = [("a", i, 1e12) for i in range(10)] + [("b", 0, 0.1), ("b", 1, 0.2), ("b", 2, 0.3)] + [(None, i, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, seq long, v double")
    got = running_sum_within_groups(df, ["g"], [F.col("seq")], "v", "cum", num_partitions=5).collect()
    assert sorted(r.cum for r in got if r.g == "b") == [0.0, 0.1, 0.1 + 0.2]
    assert sorted(r.cum for r in got if r.g is None) == [0.0, 1.0, 2.0, 3.0]


def test_null_groups_keep_their_rows(spark):
    import datetime as dt
    from sentier.operators.ranking import rank_within_groups
    from sentier.plans.feedback import feedback_concat
    rows = [(1, "a", dt.date(2020, 1, 1), "x"), (2, None, dt.date(2020, 1, 1), "y"), (3, "a", None, "z"), (4, None, None, "w")]
    df = spark.createDataFrame(rows, "fid long, tsid string, date date, feedback string")
    assert rank_within_groups(df, ["tsid"], [F.col("fid")], "pos", "n").count() == 4
    assert sum(r.n_feedback for r in feedback_concat(df).collect()) == 4


def test_landing_keeps_every_row(spark, tmp_path):
    from sentier.streaming.common import land_in_order
    df = spark.range(100).select("id", F.when(F.col("id") % 5 != 0, F.col("id")).alias("k"))
    land_in_order(df, f"{tmp_path}/x", "k", 4)
    assert spark.read.parquet(f"{tmp_path}/x").count() == 100


def test_station_feeds_of_many_documents(spark, tmp_path):
    from sentier.sources import files as FI
    st = spark.range(5000).select(F.floor(F.col("id") / 1000).alias("d"), F.struct(
        F.col("id").cast("string").alias("station_id"), F.lit("n").alias("name"), F.lit(1.0).alias("lat"),
        F.lit(2.0).alias("lon")).alias("s"))
    docs = st.groupBy("d").agg(F.collect_list("s").alias("stations"))
    docs.select(F.lit(1).cast("long").alias("last_updated"), F.struct("stations").alias("data")).coalesce(1).write.json(f"{tmp_path}/i")
    assert FI.read_station_feed(spark, f"{tmp_path}/i", FI.STATION_INFO_SCHEMA).count() == 5000


def test_absent_and_broken_tables_differ(spark, tmp_path):
    import pytest
    from sentier.sources import files as FI
    path = f"{tmp_path}/t"
    assert FI.read_or_empty(spark, path, "a long").count() == 0
    built = []
    for _ in range(2):
        out = FI.compute_if_absent(spark, path, lambda: built.append(1) or spark.range(3).withColumnRenamed("id", "a"))
        assert out.count() == 3
    assert len(built) == 1 and FI.read_or_empty(spark, path, "a long").count() == 3
    (tmp_path / "t" / "part-bad.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        FI.read_or_empty(spark, path, "a long").collect()


def test_knn_with_null_vectors_ties_and_many_blocks(spark, monkeypatch):
    from sentier.operators import vectors as V
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 11)
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.0, float(i + 1)]) for i in range(20)]
    rows += [(900, None), (901, [1.0]), (902, [1.0, None]), (903, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    args = dict(q_id="id", q_vec="vec", v_id="id", v_vec="vec")
    got = {}
    for r in V.knn(v, v, 3, metric="l2sq", exclude_self=True, **args).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vid)
    assert got[5] == [0, 1, 2] and got[0] == [1, 2, 3] and got[105] == [104, 106, 103]
    assert set(got) == {r[0] for r in rows} - {900, 901, 902}
    cos = V.knn(v.where("id = 100"), v, 4, metric="cosine", **args).orderBy("rank").collect()
    assert [r.vid for r in cos] == [100, 101, 102, 103] and all(abs(r.score - 1.0) < 1e-12 for r in cos)


def test_trips_of_a_hub(spark):
    from sentier.plans import transit as TR
    # 40 trips call at the hub, each also at a stop of its own; stops 900, 901 share no trip
    st = spark.createDataFrame([(t, 0, 1) for t in range(40)] + [(t, 100 + t, 2) for t in range(40)] + [(50, 900, 1), (51, 901, 1)],
                               "trip_id long, stop_id long, stop_sequence int")
    pairs = spark.createDataFrame([(0, 105), (105, 0), (900, 901)], "start_stop_id long, end_stop_id long")
    got = sorted((r.start_stop_id, r.end_stop_id, r.trip_id, r.stop_sequence_start) for r in TR.trips_between_stops(pairs, st).collect())
    assert got == [(0, 105, 5, 1), (105, 0, 5, 2)]
    lonely = sorted((r.start_stop_id, r.side, r.trip_id) for r in TR.unconnected_stop_trips(pairs, st).collect())
    assert lonely == [(900, "end", 51), (900, "start", 50)]


def test_radius_join_with_hot_cell(spark):
    rnd = random.Random(17)
    q = [(i, 49.44 + rnd.random() * 0.001, 1.09 + rnd.random() * 0.001) for i in range(400)]   # one hot cell
    q += [(400 + i, rnd.uniform(48, 51), rnd.uniform(-1, 3)) for i in range(100)]
    p = [(i, rnd.uniform(49.3, 49.6), rnd.uniform(0.9, 1.3)) for i in range(300)]
    qd = spark.createDataFrame(q, "qid long, qlat double, qlon double")
    pd_ = spark.createDataFrame(p, "pid long, plat double, plon double")
    got = radius_join(qd, pd_, 5.0, q_lat="qlat", q_lon="qlon", p_lat="plat", p_lon="plon",
                      broadcast=False, q_key="qid")
    got = sorted((r.qid, r.pid) for r in got.collect())
    want = sorted((a[0], b[0]) for a in q for b in p if _gc(a[1], a[2], b[1], b[2]) <= 5.0)
    assert got == want


def test_nearest_k_of_far_queries(spark):
    from sentier.operators.geojoin import far_pairs, nearest_k
    rnd = random.Random(23)
    p = [(i, rnd.uniform(49.3, 49.6), rnd.uniform(0.9, 1.3)) for i in range(2000)]
    q = [(i, rnd.uniform(49.3, 49.6), rnd.uniform(0.9, 1.3)) for i in range(90)]
    q += [(90 + i, rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(10)]
    qd = spark.createDataFrame(q, "qid long, qlat double, qlon double")
    pd_ = spark.createDataFrame(p, "pid long, plat double, plon double")
    names = dict(q_key="qid", p_key="pid", q_lat="qlat", q_lon="qlon", p_lat="plat", p_lon="plon")
    got = {}
    for r in nearest_k(qd, pd_, 3, **names).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.pid
    for key, lat, lon in q:
        want = [b[0] for b in sorted(p, key=lambda b: (_gc(lat, lon, b[1], b[2]), b[0]))[:3]]
        assert [got[key][i] for i in (1, 2, 3)] == want
    pairs = far_pairs(qd.where("qid >= 90"), pd_, 3, **names).count()
    assert pairs <= 10 * 24 * 2          # of 20,000: a constant per query
