"""Hand-worked literal cases (FIXTURES.md section 4 and the semantics register)."""

from pyspark.sql import functions as F

from sentier.functions import geo as G
from sentier.functions import mobility as MO
from sentier.functions import text as T
from sentier.plans import loyalty as LO


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_route_mode(spark):
    got = one(spark, MO.route_mode(F.col("n")), "n string", [("Métro",), ("T4",), ("TEOR",), ("T",), ("F1",)])
    assert got == ["metro", "tram", "bus", "bus", "bus"]


def test_coins(spark):
    df = spark.createDataFrame([(1.999, "bike"), (1.999, "bus"), (2.0, "walk")], "km double, m string")
    got = [r[0] for r in df.select(MO.trip_coins(F.col("km"), F.col("m"))).collect()]
    assert got == [299.0, 199.0, 100.0]


def test_co2(spark):
    df = spark.createDataFrame([(2.0, "bus"), (2.0, "tram"), (2.0, "velo")], "km double, m string")
    got = [round(r[0], 6) for r in df.select(MO.co2_grams(F.col("km"), F.col("m"))).collect()]
    assert got == [111.8, 2.4, 0.0]


def test_levels(spark):
    w = spark.createDataFrame([(1, 0, 1999, None), (2, 0, 2000, None)], "user_id int, coins int, experience int, badges string")
    got = [(r.level, r.coins_for_next_level) for r in LO.user_levels(w).orderBy("user_id").collect()]
    assert got == [(1, 1), (2, 1000)]


def test_photo(spark):
    rows = [(" http://x/a.jpg credit ## http://x/b.jpg",), ("ftp://x",), (None,)]
    got = one(spark, T.first_photo(F.col("p")), "p string", rows)
    assert got == ["http://x/a.jpg", "static/imgs/no_photo.jpg", "static/imgs/no_photo.jpg"]


def test_address(spark):
    df = spark.createDataFrame([("1  rue", None, "76000", "Rouen")], "a string, b string, c string, d string")
    assert df.select(T.place_address("a", "b", "c", "d")).first()[0] == "1 rue 76000 Rouen"


def test_postal_distance(spark):
    df = spark.createDataFrame([("76000", "27000"), ("n/a", "76000")], "a string, b string")
    got = [r[0] for r in df.select(G.postal_distance("a", "b")).collect()]
    assert got == [49000.0, float("inf")]


def test_tier_edges(spark):
    coins = [999, 1000, 2000, 3000, 4999, 5000]
    w = spark.createDataFrame([(i, c, 0, None) for i, c in enumerate(coins)], "user_id int, coins int, experience int, badges string")
    acc = LO.tier_access(w).where("accessible").groupBy("coins").agg(F.sort_array(F.collect_list("tier")).alias("t"))
    got = {r.coins: r.t for r in acc.collect()}
    assert 999 not in got
    assert got[1000] == [1] and got[2000] == [1, 2] and got[3000] == [1, 2, 3]
    assert got[4999] == [1, 2, 3] and got[5000] == [1, 2, 3, 4]


def test_purchase_fold(spark):
    w = spark.createDataFrame([(7, 1000, 0, None)], "user_id long, coins int, experience int, badges string")
    s = spark.createDataFrame([(1, 7, 700), (2, 7, 500), (3, 7, 300)], "event_id long, user_id long, cost int")
    led = LO.wallet_ledger(w, s).orderBy("event_id").collect()
    assert [r.accepted for r in led] == [True, False, True]
    assert [r.balance for r in led] == [300, 300, 0]


def test_slug_and_theme_key(spark):
    got = one(spark, T.slug(F.col("s")), "s string", [("Château de Rouen (76)",)])
    assert got == ["chateau_de_rouen_76"]
    got = one(spark, T.theme_key(F.col("s")), "s string", [("Activités et loisirs",)])
    assert got == ["Activites_et_loisirs"]


def test_geodesic_close_to_reference_values(spark):
    # Paris -> London on WGS-84 is 343.92 km (ellipsoidal geodesic)
    df = spark.createDataFrame([(48.8566, 2.3522, 51.5074, -0.1278)], "a double, b double, c double, d double")
    m = df.select(G.geodesic_m("a", "b", "c", "d")).first()[0]
    assert abs(m - 343923.0) < 300


def test_keyset_pages_equal_offset_pages(spark):
    from conftest import SMOKE
    from sentier.plans import feedback as FB
    from sentier.sources.tables import role
    fb = role(spark, SMOKE, "v_feedback")
    after = None
    for page in range(1, 4):
        off = [r.fid for r in FB.feedback_paged(fb, page=page).orderBy("rank_in_page").collect()]
        rows = FB.feedback_page_after(fb, *(after or (None, None))).collect()
        assert [r.fid for r in rows] == off
        after = (rows[-1].date, rows[-1].fid)


def test_read_or_empty_and_compute_if_absent(spark, tmp_path):
    from sentier.sources import files as FI
    empty = FI.read_or_empty(spark, str(tmp_path / "missing"), "fid long, sentiment string")
    assert empty.count() == 0 and empty.columns == ["fid", "sentiment"]
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "x")
    a = FI.compute_if_absent(spark, str(tmp_path / "store"), build)
    b = FI.compute_if_absent(spark, str(tmp_path / "store"), build)
    assert a.count() == b.count() == 5 and len(calls) == 1


def test_unknown_station_gets_null_prediction(spark):
    import datetime as dt
    from sentier.plans import bikes as BK
    hist = spark.createDataFrame([(s, dt.datetime(2024, 1, 1 + d, h), float(s + h), float(20 - s)) for s in (1, 2, 3)
                                  for d in range(3) for h in (8, 9)],
                                 "station_id long, ts timestamp, bikes double, docks double")
    models = BK.availability_model(hist, num_trees=3)
    req = spark.createDataFrame([(1, 0, 8), (99, 0, 8)], "station_id long, weekday int, hour int")
    got = {r.station_id: r for r in BK.predict_availability(models, BK.station_means(hist), req).collect()}
    assert 9.0 <= got[1].predicted_bikes <= 12.0 and 17.0 <= got[1].predicted_docks <= 19.0
    assert got[99].predicted_bikes is None and got[99].predicted_docks is None


def test_accents_beyond_latin1(spark):
    df = spark.createDataFrame([("Škoda (ő) ﬁn",), ("é decomposed",), (None,), ("Château/x",)], "t string")
    got = [tuple(r) for r in df.select(T.theme_key("t"), T.slug("t")).collect()]
    assert got == [("Skoda_o_fin", "skoda_o_n"), ("e_decomposed", "e_decomposed"), (None, None), ("Chateaux", "chateaux")]


def test_search_ignores_case_of_accented_letters(spark):
    from sentier.plans.catalog import place_search
    df = spark.createDataFrame([("1", "Château fort"), ("2", "Musée"), ("3", None)], "tsid string, nom string")
    assert [r.tsid for r in place_search(df, "CHÂTEAU").collect()] == ["1"]
    assert [r.tsid for r in place_search(df, "m").collect()] == ["2"]
    assert place_search(df, "").collect() == []


def test_json_clean_drops_nan_at_any_depth(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, (1.0, nan), [(nan, "x")])], "a double, b struct<c:double,d:double>, e array<struct<f:double,g:string>>")
    assert df.select(T.json_clean(df, ["a", "b", "e"])).first()[0] == '{"b":{"c":1.0},"e":[{"g":"x"}]}'


def test_negative_alpha_is_refused(spark):
    import pytest
    from sentier.plans.recommend import recommend_places
    with pytest.raises(ValueError):
        recommend_places(None, None, alpha=-1.0)


def test_kernels_run_where_the_package_is_not_installed(tmp_path):
    """A job started from another folder: workers can't import the package."""
    import subprocess
    import sys
    from conftest import ROOT, SMOKE
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\nimport __spark_entry__ as e\n"
            "from sentier.session import build_session\ns = build_session('local[2]', 2)\n"
            f"print('rows', e.queries()['vector_knn'](s, {SMOKE!r}).count())")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert "rows" in out.stdout, out.stderr[-2000:]
