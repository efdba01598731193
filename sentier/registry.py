"""Query registry: one callable per operator key of the blueprint.

Each entry takes ``(spark, sf_dir)``, reads the driver tables through the role
views and returns a DataFrame (never collected here).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentier.sources.tables import role, table

AS_OF = "2001-12-01"   # dashboards are evaluated as of this date on the fixtures

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn
    return deco


def _fb(spark, sf):
    return role(spark, sf, "v_feedback")


# ---------------------------------------------------------------- C4 feedback
from sentier.plans import feedback as FB  # noqa: E402


@register("sentiment_counts")
def _q_sentiment_counts(spark, sf):
    return FB.sentiment_counts(_fb(spark, sf))


@register("theme_counts")
def _q_theme_counts(spark, sf):
    return FB.theme_counts(_fb(spark, sf))


@register("top_negative_places")
def _q_top_negative(spark, sf):
    return FB.top_negative_places(_fb(spark, sf))


def _as_text(df, *cols):
    """Nullable ids / flags leave the registry as text (NULL stays NULL), so
    the engines' different pandas nullable types cannot split the hash."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _as_double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _iso_date(df):
    """Dates leave the registry as ISO text so both engines hash them alike."""
    return df.withColumn("date", F.col("date").cast("string"))


@register("recent_negatives")
def _q_recent_negatives(spark, sf):
    return _iso_date(FB.recent_negatives(_fb(spark, sf)))


@register("sentiment_trend")
def _q_sentiment_trend(spark, sf):
    return FB.sentiment_trend(_fb(spark, sf), AS_OF)


@register("feedback_paged")
def _q_feedback_paged(spark, sf):
    return _iso_date(FB.feedback_paged(_fb(spark, sf), page=3))


@register("feedback_concat")
def _q_feedback_concat(spark, sf):
    return FB.feedback_concat(_fb(spark, sf))


@register("feedback_dashboard")
def _q_feedback_dashboard(spark, sf):
    return FB.dashboard_summary(_fb(spark, sf), AS_OF)


# ---------------------------------------------------------------- catalogue
from sentier.functions import text as T  # noqa: E402
from sentier.plans import catalog as CA  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _places(spark, sf):
    return role(spark, sf, "v_places")


def _restos(spark, sf):
    return role(spark, sf, "v_restaurants")


@register("places_dedup")
def _q_places_dedup(spark, sf):
    return CA.places_dedup(_places(spark, sf))


@register("restaurants_scan")
def _q_restaurants_scan(spark, sf):
    return _restos(spark, sf)


@register("map_export")
def _q_map_export(spark, sf):
    return CA.map_export(_places(spark, sf), _restos(spark, sf))


@register("records_export")
def _q_records_export(spark, sf):
    """Both catalogues as JSON records, written line by line and read back."""
    path = shared_path(spark, "records")
    out = CA.map_export(_places(spark, sf), _restos(spark, sf))
    CA.export_records_json(out).write.mode("errorifexists").partitionBy("kind").text(path)
    back = spark.read.schema("value string, kind string").text(path)
    record = F.from_json("value", out.drop("kind").schema).alias("r")
    return back.select(record, "kind").select("r.*", "kind")


@register("map_markers")
def _q_map_markers(spark, sf):
    return CA.map_markers(CA.map_export(_places(spark, sf), _restos(spark, sf)))


@register("place_detail")
def _q_place_detail(spark, sf):
    return CA.place_detail(_places(spark, sf), _fb(spark, sf))


@register("restaurants_county")
def _q_restaurants_county(spark, sf):
    return CA.restaurants_county(_restos(spark, sf), "76")


@register("place_search")
def _q_place_search(spark, sf):
    return CA.place_search(_places(spark, sf), "BLU(e|sh) [a-c]")


@register("places_paged")
def _q_places_paged(spark, sf):
    return CA.places_paged(_places(spark, sf), "2")


@register("restaurants_paged")
def _q_restaurants_paged(spark, sf):
    return CA.restaurants_paged(_restos(spark, sf))


@register("restaurant_detail")
def _q_restaurant_detail(spark, sf):
    r = _restos(spark, sf)
    return CA.restaurant_detail(r, r.select("tsid"), role(spark, sf, "v_access"))


@register("page_counts")
def _q_page_counts(spark, sf):
    p = _places(spark, sf)
    return CA.page_counts({
        "monuments": (p.where(F.col("codepostal").startswith("2")), 10),
        "restaurants": (CA.restaurants_county(_restos(spark, sf), "76"), 10),
        "feedback": (_fb(spark, sf), 8),
    })


@register("catalogue_union")
def _q_catalogue_union(spark, sf):
    return _as_text(CA.catalogue_union(_places(spark, sf), _restos(spark, sf)), "ord", "vegetarien")


@register("place_address")
def _q_place_address(spark, sf):
    p = _places(spark, sf)
    return p.select("tsid", T.place_address("adresse1", "adresse2", "codepostal", "commune").alias("addr"))


@register("restaurant_address")
def _q_restaurant_address(spark, sf):
    p = _restos(spark, sf)
    return p.select("tsid", T.restaurant_address("adresse1", "adresse2", "codepostal", "commune").alias("addr"))


@register("first_photo")
def _q_first_photo(spark, sf):
    p = _places(spark, sf)
    return p.select("tsid", T.first_photo("photo").alias("photo_url"),
                    T.first_photo_raw("photo").alias("photo_raw"))


@register("specialty_tags")
def _q_specialty_tags(spark, sf):
    return CA.specialty_tags(_restos(spark, sf))


@register("feature_text")
def _q_feature_text(spark, sf):
    p = _places(spark, sf)
    return p.select("tsid", T.feature_text("nom", "descriptif").alias("text"))


@register("retrieval_text")
def _q_retrieval_text(spark, sf):
    p = _places(spark, sf)
    return p.select("tsid", T.feature_text("descriptif", "commune", "codepostal", "adresse1", "envies", "equipements", "type").alias("text"))


@register("theme_key")
def _q_theme_key(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.theme_key("text").alias("key"))


@register("place_slug")
def _q_place_slug(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.slug("text").alias("slug"))


@register("description_teaser")
def _q_description_teaser(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.teaser_chars("text").alias("teaser"), T.teaser_words("text").alias("teaser_words"))


@register("date_parts")
def _q_date_parts(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id",
                    F.date_format("ts", "yyyy-MM-dd").alias("day"),
                    F.date_format("ts", "yyyy-MM").alias("month"),
                    F.date_format("ts", "dd/MM/yyyy").alias("day_fr"),
                    F.weekday("ts").alias("weekday"),
                    F.hour("ts").alias("hour"))


# ---------------------------------------------------------------- geo + transit
from sentier.functions import geo as G  # noqa: E402
from sentier.functions import mobility as MO  # noqa: E402
from sentier.plans import transit as TR  # noqa: E402


def _gtfs(spark, sf):
    return {n: role(spark, sf, "v_" + n) for n in ("requests", "stops", "stop_times", "trips", "routes", "shapes")}


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@register("geo_distance")
def _q_geo_distance(spark, sf):
    r = role(spark, sf, "v_requests")
    return r.select("req_id", F.round(G.great_circle_km("start_lat", "start_lon", "end_lat", "end_lon"), 6).alias("km"),
                    F.round(G.great_circle_km("start_lat", "start_lon", "end_lat", "end_lon") * 1000, 3).alias("meters"))


@register("geodesic_distance")
def _q_geodesic_distance(spark, sf):
    r = role(spark, sf, "v_requests")
    r = G.with_geodesic_m(r, "m", "start_lat", "start_lon", "end_lat", "end_lon")
    return r.select("req_id", F.round("m", 3).alias("meters"))


@register("postal_distance")
def _q_postal_distance(spark, sf):
    p = _places(spark, sf)
    return p.select("tsid", G.postal_distance(F.col("codepostal"), F.lit("76000")).alias("postal_dist"))


@register("nearest_stop")
def _q_nearest_stop(spark, sf):
    g = _gtfs(spark, sf)
    best = TR.nearest_stop(g["requests"], g["stops"], "req_id", "start_lat", "start_lon")
    return _as_text(best.select("req_id", "stop_id", "stop_name", _r("dist_m", 3)), "stop_id")


@register("nearest_stop_shared_route")
def _q_nearest_shared(spark, sf):
    g = _gtfs(spark, sf)
    start = TR.nearest_stop(g["requests"], g["stops"], "req_id", "start_lat", "start_lon")
    ref = start.where(F.col("stop_id").isNotNull()).select("req_id", F.col("stop_id").alias("ref_stop_id"))
    ref = materialize(ref, "start-stops")
    sr = materialize(TR.stop_routes(g["stop_times"], g["trips"]), "stop-routes")
    end = TR.nearest_shared_stop(g["requests"], ref, g["stops"], sr)
    return ref.join(end, "req_id").select("req_id", "ref_stop_id", "end_stop_id", _r("end_dist_m", 3))


def _plain_pairs(g):
    s = TR.nearest_stop(g["requests"], g["stops"], "req_id", "start_lat", "start_lon")
    e = TR.nearest_stop(g["requests"], g["stops"], "req_id", "end_lat", "end_lon")
    return (s.select("req_id", F.col("stop_id").alias("start_stop_id"))
            .join(e.select("req_id", F.col("stop_id").alias("end_stop_id")), "req_id")
            .where(F.col("start_stop_id").isNotNull() & F.col("end_stop_id").isNotNull()))


@register("trips_between_stops")
def _q_trips_between(spark, sf):
    g = _gtfs(spark, sf)
    return TR.trips_between_stops(_plain_pairs(g), g["stop_times"])


@register("trips_unconnected")
def _q_trips_unconnected(spark, sf):
    g = _gtfs(spark, sf)
    return TR.unconnected_stop_trips(_plain_pairs(g), g["stop_times"])


@register("routes_per_stop")
def _q_routes_per_stop(spark, sf):
    g = _gtfs(spark, sf)
    return TR.stop_routes(g["stop_times"], g["trips"])


@register("trip_route_shape")
def _q_trip_route_shape(spark, sf):
    g = _gtfs(spark, sf)
    return (g["trips"].join(g["routes"], "route_id", "left")
            .select("trip_id", "route_id", "shape_id", "route_short_name",
                    MO.route_mode(F.col("route_short_name")).alias("transport_mode")))


@register("route_mode")
def _q_route_mode(spark, sf):
    r = role(spark, sf, "v_routes")
    return r.select("route_id", "route_short_name", MO.route_mode(F.col("route_short_name")).alias("transport_mode"))


@register("trip_co2")
def _q_trip_co2(spark, sf):
    r = G.with_geodesic_m(role(spark, sf, "v_requests"), "m", "start_lat", "start_lon", "end_lat", "end_lon")
    r = r.select("req_id", (F.col("m") / 1000).alias("km"))
    m = r.select("req_id", "km", F.explode(F.array(*[F.lit(x) for x in ("bike", "bus", "tram", "metro", "walk")])).alias("mode"))
    return m.select("req_id", "mode", F.round(MO.co2_grams(F.col("km"), F.col("mode")), 6).alias("co2_g"))


@register("trip_coins")
def _q_trip_coins(spark, sf):
    r = G.with_geodesic_m(role(spark, sf, "v_requests"), "m", "start_lat", "start_lon", "end_lat", "end_lon")
    r = r.select("req_id", (F.col("m") / 1000).alias("km"))
    m = r.select("req_id", "km", F.explode(F.array(*[F.lit(x) for x in ("bike", "bus", "walk")])).alias("mode"))
    return m.select("req_id", "mode", F.round(MO.trip_coins(F.col("km"), F.col("mode")), 6).alias("coins"))


@register("path_segments")
def _q_path_segments(spark, sf):
    pts = TR.shape_points(role(spark, sf, "v_shapes"))
    return pts.select("shape_id", "seq", "idx", "next_lat", "next_lon", _r("seg_km"))


@register("path_length")
def _q_path_length(spark, sf):
    pts = TR.shape_points(role(spark, sf, "v_shapes"))
    return pts.groupBy("shape_id").agg(F.round(F.sum("seg_km"), 6).alias("length_km"),
                                       F.count(F.lit(1)).alias("n_points"))


@register("path_bbox")
def _q_path_bbox(spark, sf):
    s = role(spark, sf, "v_shapes")
    return s.groupBy("shape_id").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
                                     F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def _plan(spark, sf, path=None):
    g = _gtfs(spark, sf)
    return TR.plan_transit_trips(g["requests"], g["stops"], g["stop_times"], g["trips"], g["routes"],
                                 g["shapes"], path=path)


@register("plan_transit_trips")
def _q_plan_transit(spark, sf):
    p = _plan(spark, sf)
    p = p.select("req_id", "status", "start_stop_id", "end_stop_id", "trip_id", "route_id", "transport_mode",
                 "shape_id", "start_idx", "end_idx", "n_points", _r("transit_km"), _r("walk_km"), _r("co2_g"),
                 "coins", "start_stop_name", "end_stop_name", "start_stop_lat", "start_stop_lon", "end_stop_lat", "end_stop_lon")
    p = _as_text(p, "start_stop_id", "end_stop_id", "trip_id", "route_id", "shape_id")
    return _as_double(p, "start_idx", "end_idx", "n_points")


@register("nearest_vertex")
def _q_nearest_vertex(spark, sf):
    p = _plan(spark, sf).where(F.col("status") == "ok")
    return p.select("req_id", "shape_id", "start_idx", "end_idx")


@register("trip_path")
def _q_trip_path(spark, sf):
    return _plan(spark, sf, path="whole")


# ---------------------------------------------------------------- vectors, recommendation, retrieval
from sentier.operators import vectors as VE  # noqa: E402
from sentier.plans import rag as RG  # noqa: E402
from sentier.plans import recommend as RE  # noqa: E402


@register("vector_knn")
def _q_vector_knn(spark, sf):
    q, v = role(spark, sf, "v_queries"), role(spark, sf, "v_vectors")
    nn = VE.knn(q, v, 100, q_id="qid", q_vec="vector", v_id="tsid", v_vec="vector", metric="l2sq")
    return nn.select("qid", F.col("vid").alias("tsid"), "rank", F.round("score", 6).alias("dist"))


@register("cosine_pairs")
def _q_cosine_pairs(spark, sf):
    v = role(spark, sf, "v_vectors")
    nn = VE.knn(v, v, 10, q_id="tsid", q_vec="vector", v_id="tsid", v_vec="vector", metric="cosine",
                exclude_self=True)
    return nn.select(F.col("qid").alias("tsid"), "rank", F.col("vid").alias("neighbour"),
                     F.round("score", 6).alias("cosine"))


def _recs(spark, sf):
    return RE.recommend_places(_places(spark, sf), role(spark, sf, "v_vectors"))


@register("recommend_places")
def _q_recommend_places(spark, sf):
    r = _recs(spark, sf)
    return r.select("ref_tsid", "rank", "tsid", F.round("distance_m", 3).alias("distance_m"), "photo_url",
                    F.round("score", 6).alias("score"))


@register("nearest_places")
def _q_nearest_places(spark, sf):
    r = role(spark, sf, "v_requests")
    n = RE.nearest_places(r, _places(spark, sf), "req_id", "start_lat", "start_lon", 10)
    return n.select("req_id", "rank", "tsid", F.round("distance_m", 3).alias("distance_m"))


@register("user_recommendations")
def _q_user_recommendations(spark, sf):
    u = RE.user_recommendations(_fb(spark, sf), _recs(spark, sf))
    return u.select("username", "ref_tsid", "rank", "rec_tsid", F.round("distance_m", 3).alias("distance_m"))


@register("query_location")
def _q_query_location(spark, sf):
    return RG.query_location(role(spark, sf, "v_queries"), _places(spark, sf))


def _rag(spark, sf):
    return RG.rag_retrieve(role(spark, sf, "v_queries"), _places(spark, sf), role(spark, sf, "v_vectors"))


@register("rag_retrieve")
def _q_rag_retrieve(spark, sf):
    return _rag(spark, sf).select("qid", "rank", "tsid", "location", F.round("embedding_distance", 6).alias("embedding_distance"),
                                  "geo_distance", F.round("combined_score", 6).alias("combined_score"))


@register("rag_context")
def _q_rag_context(spark, sf):
    return RG.rag_context(_rag(spark, sf), _places(spark, sf))


# ---------------------------------------------------------------- loyalty
from sentier.plans import loyalty as LO  # noqa: E402
from sentier.session import materialize, shared_path  # noqa: E402


def _wallet(spark, sf):
    return role(spark, sf, "v_wallet")


@register("user_levels")
def _q_user_levels(spark, sf):
    return LO.user_levels(_wallet(spark, sf))


@register("user_badges")
def _q_user_badges(spark, sf):
    return LO.user_badges(_wallet(spark, sf), LO.badges_dim(spark))


@register("tier_access")
def _q_tier_access(spark, sf):
    return LO.tier_access(_wallet(spark, sf))


@register("tiers_dim")
def _q_tiers_dim(spark, sf):
    """Users per tier band, with the band's rewards count (dimension x wallet)."""
    acc = LO.tier_access(_wallet(spark, sf)).where(F.col("accessible"))
    d = LO.tiers_dim(spark).select("tier", F.size("rewards").alias("n_rewards"))
    return acc.groupBy("tier").agg(F.count(F.lit(1)).alias("n_users")).join(F.broadcast(d), "tier")


@register("tier_progress")
def _q_tier_progress(spark, sf):
    return _as_double(LO.tier_progress(_wallet(spark, sf)), "next_tier", "coins_needed")


@register("wallet_balances")
def _q_wallet_balances(spark, sf):
    return LO.wallet_balances(_wallet(spark, sf), role(spark, sf, "v_spends"))


@register("wallet_ledger")
def _q_wallet_ledger(spark, sf):
    return LO.wallet_ledger(_wallet(spark, sf), role(spark, sf, "v_spends"))


def _registrations(spark, sf):
    # everyone who ordered registers; customers are known, their guests are new
    who = F.when(F.col("o_orderstatus") == "P", F.lit("Guest")).otherwise(F.lit("User"))
    return table(spark, sf, "orders").select(F.upper(F.concat(who, F.col("o_custkey"))).alias("username"),
                    F.concat(F.lit("Nom "), F.col("o_custkey")).alias("name"))


def _existing_users(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("user"), F.col("c_custkey")).alias("username"), F.col("c_name").alias("name"))


@register("users_insert_new")
def _q_users_insert_new(spark, sf):
    return LO.users_insert_new(_existing_users(spark, sf), _registrations(spark, sf))


@register("users_snapshot")
def _q_users_snapshot(spark, sf):
    from sentier.sources.snapshots import SnapshotTable
    users = SnapshotTable(spark, shared_path(spark, "users"))
    first = users.commit(_existing_users(spark, sf).select("username", "name"), 0)
    users.commit(LO.users_insert_new(users.read(first), _registrations(spark, sf)), first)
    return users.read()


# ---------------------------------------------------------------- calendar
from sentier.plans import calendar as CL  # noqa: E402
from sentier.sources import files as FI  # noqa: E402

CAL_AS_OF = "2024-01-15T00:00:00"


def _agenda(spark, sf):
    return CL.agenda_from_events(table(spark, sf, "events"))


@register("json_flatten")
def _q_json_flatten(spark, sf):
    return FI.flatten(_agenda(spark, sf).drop("timings"))


@register("event_calendar")
def _q_event_calendar(spark, sf):
    return CL.event_calendar(_agenda(spark, sf))


@register("events_per_day")
def _q_events_per_day(spark, sf):
    return CL.events_per_day(CL.event_calendar(_agenda(spark, sf)))


@register("events_by_day_nested")
def _q_events_by_day(spark, sf):
    return CL.events_by_day(CL.event_calendar(_agenda(spark, sf)))


@register("events_upcoming")
def _q_events_upcoming(spark, sf):
    return CL.events_upcoming(_agenda(spark, sf), CAL_AS_OF)


@register("json_event_pages")
def _q_json_event_pages(spark, sf):
    agenda = _agenda(spark, sf)
    path = shared_path(spark, "agenda-pages")
    pages = CL.event_pages(agenda)
    pages.write.mode("errorifexists").json(path)
    events = FI.read_event_pages(spark, path, pages.schema)
    return CL.calendar_rows(FI.flatten(events.drop("timings")))


# ---------------------------------------------------------------- feedback ingest
INGEST_DATE = "2001-12-01"


def _raw(spark, sf):
    return role(spark, sf, "v_raw_feedback")


@register("verbatim_explode")
def _q_verbatim_explode(spark, sf):
    return FB.verbatim_explode(_raw(spark, sf)).select("fid", "pos", "verbatim", "theme", "sentiment")


@register("feedback_tsid")
def _q_feedback_tsid(spark, sf):
    r = _raw(spark, sf).select("fid", "longitude", "latitude")
    return FB.resolve_tsid(r, _places(spark, sf), _restos(spark, sf)).select("fid", "tsid")


def _ingested(spark, sf):
    return FB.ingest_feedback(_raw(spark, sf), _places(spark, sf), _restos(spark, sf), INGEST_DATE)


@register("ingest_feedback")
def _q_ingest_feedback(spark, sf):
    return _iso_date(_ingested(spark, sf).select("fid", "username", "longitude", "latitude", "nom", "feedback",
                                                 "pos", "verbatim", "theme", "sentiment", "tsid", "date"))


@register("feedback_append")
def _q_feedback_append(spark, sf):
    path = shared_path(spark, "feedback")
    FB.append_feedback(path, FB.to_feedback_table(_fb(spark, sf), "history"))
    FB.append_feedback(path, FB.to_feedback_table(_ingested(spark, sf), "ingest"))
    t = spark.read.parquet(path)
    return t.groupBy("month", "source", "sentiment").agg(F.count(F.lit(1)).alias("n"))


@register("feedback_newest")
def _q_feedback_newest(spark, sf):
    path = shared_path(spark, "feedback")
    FB.append_feedback(path, FB.to_feedback_table(_fb(spark, sf), "history"), 1)
    FB.append_feedback(path, FB.to_feedback_table(_ingested(spark, sf), "ingest"), 2)
    return FB.newest_first(spark.read.parquet(path)).select("fid", "source", "verbatim", "rank", "page")


@register("feedback_restore")
def _q_feedback_restore(spark, sf):
    from sentier.sources.snapshots import SnapshotTable
    table_ = SnapshotTable(spark, shared_path(spark, "feedback"))
    backup = table_.commit(FB.to_feedback_table(_fb(spark, sf), "history"), 0)
    table_.commit(FB.to_feedback_table(_ingested(spark, sf), "ingest"), backup)
    table_.restore(backup)
    t = table_.read()
    return _iso_date(t.select("fid", "username", "date", "tsid", "nom", "theme", "sentiment", "feedback"))


# ---------------------------------------------------------------- accessibility
from sentier.plans import access as AC  # noqa: E402


def _access(spark, sf):
    return AC.accessibility_join(_places(spark, sf), role(spark, sf, "v_access"), "ord")


@register("accessibility_join")
def _q_accessibility_join(spark, sf):
    a = _access(spark, sf)
    a = a.select("tsid", "matched", "entree_pmr", "stationnement_pmr", "accueil_personnels",
                 F.array_join("labels", "|").alias("labels"))
    return _as_text(a, "entree_pmr", "stationnement_pmr")


@register("place_page")
def _q_place_page(spark, sf):
    """P4 + J9 + P12: a place's page with its accessibility as the page shows it."""
    pages = CA.place_detail(_places(spark, sf), _fb(spark, sf))
    return pages.join(AC.accessibility_labels(_access(spark, sf)).select("tsid", "entree_pmr", "accueil_personnels"), "tsid")


@register("accessibility_labels")
def _q_accessibility_labels(spark, sf):
    return AC.accessibility_labels(_access(spark, sf)).select("tsid", "entree_pmr", "sanitaires_adaptes",
                                                               "accueil_personnels", "labels")


# ---------------------------------------------------------------- sources and sinks
@register("csv_semicolon_roundtrip")
def _q_csv_roundtrip(spark, sf):
    p = _places(spark, sf)
    path = shared_path(spark, "places-csv")
    # columns land in another order, with one that nobody asked for
    FI.write_csv(p.select(F.lit("x").alias("extra"), *reversed(p.columns)), path, sep=";")
    return FI.read_csv(spark, path, p.schema, sep=";")


@register("csv_comma_roundtrip")
def _q_csv_comma(spark, sf):
    a = role(spark, sf, "v_access").select("name", "ord", "entree_pmr", "accueil_personnels")
    path = shared_path(spark, "access-csv")
    FI.write_csv(a.select(*reversed(a.columns)), path, sep=",")
    back = FI.read_csv(spark, path, a.schema, sep=",")
    return back.withColumn("entree_pmr", F.col("entree_pmr").cast("string"))


@register("feedback_or_empty")
def _q_feedback_or_empty(spark, sf):
    """A feedback table that exists, and one that was never written."""
    fb = _fb(spark, sf)
    path = shared_path(spark, "feedback-table")
    FI.write_snapshot(fb, path)
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("theme").alias("n_themes")
                                  ).select(F.lit(name).alias("feed"), "n_rows", "n_themes")
    absent = FI.read_or_empty(spark, shared_path(spark, "no-feedback"), fb.schema)
    return one("landed", FI.read_or_empty(spark, path, fb.schema)).unionByName(one("absent", absent))


def _gtfs_frames(spark, sf):
    g = _gtfs(spark, sf)
    return {
        "stops": g["stops"].select(F.col("stop_id").cast("string"), "stop_name", "stop_lat", "stop_lon"),
        "stop_times": g["stop_times"].select(F.col("trip_id").cast("string"), F.col("stop_id").cast("string"),
                                             "stop_sequence"),
        "trips": g["trips"].select(*[F.col(c).cast("string") for c in ("trip_id", "route_id", "shape_id")]),
        "routes": g["routes"].select(F.col("route_id").cast("string"), "route_short_name"),
        "shapes": g["shapes"].select(F.col("shape_id").cast("string"), F.col("lat").alias("shape_pt_lat"),
                                     F.col("lon").alias("shape_pt_lon"), F.col("seq").cast("int").alias("shape_pt_sequence")),
    }


def _landed_gtfs(spark, sf, broken: bool):
    """The feed as real ones come: columns in another order and more of them. With
    ``broken``, each 50th number is no number."""
    base = shared_path(spark, "gtfs")
    number = {"stops": "stop_lat", "stop_times": "stop_sequence", "shapes": "shape_pt_lat"}
    for name, df in _gtfs_frames(spark, sf).items():
        if broken and name in number:
            c = number[name]
            own = [x for x in df.columns if x != c]
            bad = F.pmod(F.col(own[0]).cast("long"), F.lit(50)) == 0
            df = df.withColumn(c, F.when(bad, F.lit("n/a")).otherwise(F.col(c).cast("string")))
        more = df.select(F.lit("agency 1").alias("agency_id"), *reversed(df.columns), F.lit('a "b", c').alias(f"{name}_desc"))
        more.write.mode("errorifexists").options(header=True, escape='"').csv(f"{base}/{name}.txt")
    return base


@register("gtfs_scan_counts")
def _q_gtfs_scan_counts(spark, sf):
    feed = FI.read_gtfs(spark, _landed_gtfs(spark, sf, broken=False))
    out = None
    for name in sorted(feed):
        one = feed[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("gtfs_feed_content")
def _q_gtfs_feed_content(spark, sf):
    """What the feed's tables hold (rows, keys, sum of one number) and what was
    quarantined."""
    feed = FI.read_gtfs_checked(spark, _landed_gtfs(spark, sf, broken=True))
    asks = {"stops": ("stop_id", "stop_lat"), "stop_times": ("trip_id", "stop_sequence"), "trips": ("shape_id", None),
            "routes": ("route_short_name", None), "shapes": ("shape_id", "shape_pt_lat")}
    bad = FI.write_quarantine(feed, shared_path(spark, "gtfs-quarantine"))
    n_bad = bad.groupBy(F.col("source").alias("table_name")).agg(F.count(F.lit(1)).alias("n_bad"))
    out = None
    for name, (key, number) in asks.items():
        total = F.round(F.sum(number).cast("double"), 2) if number else F.lit(0.0)
        one = feed[name].good.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"),
                                  F.coalesce(total, F.lit(0.0)).alias("total"))
        one = one.select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(n_bad), "table_name", "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))


def _landed_stations(spark, sf):
    """Station feeds landed as GBFS JSON documents of at most 1000 stations, one
    document per line."""
    from sentier.operators.ranking import global_row_number
    st = role(spark, sf, "v_stations").withColumn("station_id", F.col("station_id").cast("string"))
    ranked = global_row_number(st, [F.col("station_id")], "_r").withColumn("_doc", F.floor((F.col("_r") - 1) / 1000))
    base = shared_path(spark, "gbfs")
    info = ranked.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("station_id", "name", "lat", "lon"))).alias("stations"))
    status = ranked.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct(
        "station_id", F.col("num_bikes_available").cast("int").alias("num_bikes_available"),
        F.col("num_docks_available").cast("int").alias("num_docks_available")))).alias("stations"))
    info.select(F.lit(1).cast("long").alias("last_updated"), F.struct("stations").alias("data")).write.json(f"{base}/info")
    status.select(F.lit(1).cast("long").alias("last_updated"), F.struct("stations").alias("data")).write.json(f"{base}/status")
    return (FI.read_station_feed(spark, f"{base}/info", FI.STATION_INFO_SCHEMA),
            FI.read_station_feed(spark, f"{base}/status", FI.STATION_STATUS_SCHEMA))


@register("json_stations_inline")
def _q_json_stations(spark, sf):
    info, _ = _landed_stations(spark, sf)
    return info.select("station_id", "name", "lat", "lon")


@register("geojson_points")
def _q_geojson_points(spark, sf):
    from sentier.plans.catalog import osm_nodes_from_places, water_features
    feats = water_features(osm_nodes_from_places(_places(spark, sf)))
    path = shared_path(spark, "water-geojson")
    FI.write_geojson_seq(feats, path)
    back = FI.read_geojson_seq(spark, path)
    # round trip through the sink: coordinates come back in (lon, lat) order
    return back.select("id", F.col("geometry.coordinates")[0].alias("lon"),
                       F.col("geometry.coordinates")[1].alias("lat"), F.to_json("properties").alias("properties"))


@register("geojson_nodes")
def _q_geojson_nodes(spark, sf):
    """Every node of the extract, also those without tags (empty properties)."""
    from sentier.plans.catalog import node_features, osm_nodes_from_places
    path = shared_path(spark, "nodes-geojson")
    FI.write_geojson_seq(node_features(osm_nodes_from_places(_places(spark, sf))), path)
    back = FI.read_geojson_seq(spark, path)
    return back.select("id", F.col("geometry.coordinates")[0].alias("lon"),
                       F.col("geometry.coordinates")[1].alias("lat"), F.to_json("properties").alias("properties"))


@register("json_clean")
def _q_json_clean(spark, sf):
    from sentier.functions.text import json_clean
    p = _plan(spark, sf)
    return p.select("req_id", json_clean(p, ["status", "start_stop_id", "end_stop_id", "trip_id", "transport_mode"]).alias("json"))


@register("vector_store_roundtrip")
def _q_vector_store(spark, sf):
    v = role(spark, sf, "v_vectors")
    store = VE.VectorStore.write(v, shared_path(spark, "vectors"), "tsid", "vector", block_rows=256)
    return VE.VectorStore(spark, store.path).vectors().select("tsid", F.size("vector").alias("dim"), F.round("norm", 6).alias("norm"))


@register("vector_store_knn")
def _q_vector_store_knn(spark, sf):
    """The questions' nearest places, from the store's partitions."""
    store = VE.VectorStore.write(role(spark, sf, "v_vectors"), shared_path(spark, "vectors"), "tsid", "vector", block_rows=256)
    nn = store.nearest(role(spark, sf, "v_queries"), 10, q_id="qid", q_vec="vector")
    return nn.select("qid", "rank", F.col("vid").alias("tsid"), F.round("score", 6).alias("dist"))


def _place_texts(spark, sf):
    return _places(spark, sf).select("tsid", T.feature_text("nom", "descriptif").alias("text"))


@register("embed_incremental")
def _q_embed_incremental(spark, sf):
    """The places with a given vector are embedded first, the others later, by the
    saved model: every vector equals the one that the model gives the place today."""
    from sentier.plans.ml import embed, embed_incremental, stored_embedder
    items, path = _place_texts(spark, sf), shared_path(spark, "embedder")
    first = items.join(role(spark, sf, "v_vectors").select("tsid"), "tsid", "left_semi")
    store = FI.write_snapshot(embed(stored_embedder(spark, path, first, "text"), first, "text").select("tsid", "vector"),
                              shared_path(spark, "vectors"))
    model = stored_embedder(spark, path, items, "text")  # found, not fitted again
    out = embed_incremental(store, items, "tsid", "text", model)
    whole = embed(model, items, "text").select("tsid", F.col("vector").alias("own"))
    return out.join(whole, "tsid").select("tsid", "source", F.size("vector").alias("dim"), (F.col("vector") == F.col("own")).alias("same_space"))


def _text_vectors(spark, sf):
    """A vector for every place, and the model that made them."""
    from sentier.plans.ml import embed, stored_embedder
    items = _place_texts(spark, sf)
    model = stored_embedder(spark, shared_path(spark, "embedder"), items, "text")
    return embed(model, items, "text").select("tsid", "vector"), model


@register("recommend_by_text")
def _q_recommend_by_text(spark, sf):
    """C1 over every place, by vectors of the places' texts."""
    vectors, _ = _text_vectors(spark, sf)
    return RE.recommend_places(_places(spark, sf), vectors).select("ref_tsid", "rank", "tsid", _r("score", 9))


@register("rag_by_text")
def _q_rag_by_text(spark, sf):
    """C5 over every place: questions and places embedded by one model."""
    from sentier.plans.ml import embed
    vectors, model = _text_vectors(spark, sf)
    asked = embed(model, role(spark, sf, "v_queries").select("qid", "query"), "query")
    return RG.rag_retrieve(asked, _places(spark, sf), vectors).select("qid", "rank", "tsid", _r("combined_score", 9))


@register("embed_places")
def _q_embed_places(spark, sf):
    from sentier.plans.ml import embed_texts
    items = _places(spark, sf).select("tsid", T.feature_text("nom", "descriptif").alias("text"))
    out = embed_texts(items, "text", 64)
    return out.select("tsid", F.size("vector").alias("dim"), F.round(VE.norm("vector"), 3).alias("norm"))


@register("classify_text")
def _q_classify_text(spark, sf):
    """Two targets (quality, toxic) for every document, fitted on three quarters
    of the labels; the rest say whether at least three in four agree."""
    from sentier.plans.ml import classify_texts
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lab = table(spark, sf, "labels").na.drop()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out, agrees = docs.select("doc_id"), []
    for target in ("quality", "toxic"):
        fit = docs.join(lab.where(~held).select("doc_id", F.col(target).cast("double").alias("label")), "doc_id")
        scored = classify_texts(fit, docs, "text", "label").select("doc_id", F.col("prediction").cast("int").alias(f"p_{target}"))
        out = out.join(scored, "doc_id", "left")
        agrees.append(F.avg((F.col(f"p_{target}") == F.col(target)).cast("int")) >= 0.75)
    out = materialize(out, "classified")
    ok = out.join(lab.where(held), "doc_id").agg((agrees[0] & agrees[1]).alias("held_out_agrees"))
    return out.join(F.broadcast(ok)).select("doc_id", F.col("p_quality").isin(0, 1).alias("has_quality"),
                                            F.col("p_toxic").isin(0, 1).alias("has_toxic"), "held_out_agrees")


# ---------------------------------------------------------------- bikes
from sentier.plans import bikes as BK  # noqa: E402

def _history(spark, sf):
    return role(spark, sf, "v_bike_history")


@register("stations_joined")
def _q_stations_joined(spark, sf):
    info, status = _landed_stations(spark, sf)
    return BK.stations_joined(info, status)


def _stations(spark, sf):
    return role(spark, sf, "v_stations")


@register("nearest_station")
def _q_nearest_station(spark, sf):
    r, st = role(spark, sf, "v_requests"), _stations(spark, sf)
    s = BK.nearest_station(r, st, "req_id", "start_lat", "start_lon", "bikes")
    e = BK.nearest_station(r, st, "req_id", "end_lat", "end_lon", "docks")
    return (s.select("req_id", F.col("station_id").alias("start_station_id"), F.round("dist_m", 3).alias("start_dist_m"))
            .join(e.select("req_id", F.col("station_id").alias("end_station_id"), F.round("dist_m", 3).alias("end_dist_m")),
                  "req_id"))


@register("availability_baseline")
def _q_availability_baseline(spark, sf):
    b = BK.availability_baseline(_history(spark, sf))
    return b.select("station_id", "weekday", "hour", F.round("predicted_bikes", 6).alias("predicted_bikes"),
                    F.round("predicted_docks", 6).alias("predicted_docks"), "n_obs")


@register("nearest_station_predicted")
def _q_nearest_station_predicted(spark, sf):
    preds, r, st = BK.availability_baseline(_history(spark, sf)), role(spark, sf, "v_requests"), _stations(spark, sf)
    n = BK.nearest_station_predicted(r, st, preds, "req_id", "start_lat", "start_lon", "bikes")
    e = BK.nearest_station_predicted(r, st, preds, "req_id", "end_lat", "end_lon", "docks")
    return (r.select("req_id").join(n.select("req_id", F.col("station_id").alias("bikes_at"), F.round("dist_m", 3).alias("bikes_m")).hint("merge"), "req_id", "left")
            .join(e.select("req_id", F.col("station_id").alias("docks_at"), F.round("dist_m", 3).alias("docks_m")).hint("merge"), "req_id", "left"))


def _bike_trips(spark, sf, requests):
    return BK.plan_bike_trips(requests, _stations(spark, sf), BK.availability_baseline(_history(spark, sf)))


@register("plan_bike_trips")
def _q_plan_bike_trips(spark, sf):
    p = _bike_trips(spark, sf, role(spark, sf, "v_requests"))
    return p.select("req_id", "start_station_id", "start_station", "start_station_lat", "start_bikes", "end_station_id",
                    "end_station", "end_station_lon", "end_docks", F.round("pred_bikes", 6).alias("pred_bikes"),
                    F.round("pred_docks", 6).alias("pred_docks"), F.round("bike_km", 6).alias("bike_km"),
                    F.round("total_km", 6).alias("total_km"), "coins", "transport_mode")


@register("find_routes")
def _q_find_routes(spark, sf):
    g = _gtfs(spark, sf)
    r = BK.find_routes(role(spark, sf, "v_requests"), lambda q: _bike_trips(spark, sf, q),
                       lambda q: TR.plan_transit_trips(q, g["stops"], g["stop_times"], g["trips"], g["routes"], g["shapes"]))
    return r.select("req_id", "mode", "status", "start_id", "end_id", F.round("total_km", 6).alias("total_km"), "coins",
                    "transport_mode")


@register("availability_model")
def _q_availability_model(spark, sf):
    """Every station at every hour of the week, and one that nobody knows; both
    predictions lie in the range that history has."""
    h = _history(spark, sf)
    ids = _stations(spark, sf).select("station_id").union(spark.range(1).select(F.lit(-1).cast("long")))
    slots = ids.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    p = BK.predict_availability(BK.availability_model(h), BK.station_means(h), slots)
    lim = h.agg(*[f(c).alias(f"{n}_{c}") for c in ("bikes", "docks") for n, f in (("lo", F.min), ("hi", F.max))])
    inside = lambda c: F.col(f"predicted_{c}").between(F.col(f"lo_{c}") - 1e-6, F.col(f"hi_{c}") + 1e-6)
    return p.join(F.broadcast(lim)).select("station_id", "weekday", "hour", inside("bikes").alias("bikes_in_range"),
                                           inside("docks").alias("docks_in_range"))


# ---------------------------------------------------------------- streaming
from sentier.streaming import common as SC  # noqa: E402
from sentier.streaming import feedback_stream as SF  # noqa: E402
from sentier.streaming import sentiment_windows as SW  # noqa: E402
from sentier.streaming import wallet_stream as SWA  # noqa: E402


@register("stream_feedback_ingest")
def _q_stream_feedback_ingest(spark, sf):
    # received over three hours in fid order, landed in four slices of 45 minutes
    raw = materialize(_raw(spark, sf), "raw")
    lo, hi = raw.agg(F.min("fid"), F.max("fid")).first()
    share = (F.col("fid") - F.lit(lo or 0)) / F.lit(max((hi or 0) - (lo or 0), 1))
    raw = raw.withColumn("received_at", F.timestamp_seconds(F.lit(1007164800.0) + share * 10800))
    src = shared_path(spark, "raw-feedback")
    SC.land_in_order(raw, src, "fid", 4)
    # every comment made away from any catalogue point lands twice: duplicates
    # of the last hour are found in state, older ones are late; neither counts
    raw.where(F.col("longitude") == 0.5).write.mode("append").parquet(src)
    out = SF.ingest_stream(spark, src, raw.schema, _places(spark, sf), _restos(spark, sf), INGEST_DATE,
                           shared_path(spark, "feedback-sink"), shared_path(spark, "ckpt-feedback"))
    return _iso_date(out.select("fid", "username", "longitude", "latitude", "nom", "feedback", "pos", "verbatim",
                                "theme", "sentiment", "tsid", "date"))


@register("stream_sentiment_windows")
def _q_stream_sentiment_windows(spark, sf):
    fb = _fb(spark, sf)
    src = shared_path(spark, "feedback-src")
    SC.land_in_order(fb, src, "date", 6)
    return SW.sentiment_windows_stream(spark, src, fb.schema, shared_path(spark, "windows-sink"),
                                       shared_path(spark, "ckpt-windows"))


def _landed_spends(spark, sf):
    """The spends with their event time, landed in four slices of about a week."""
    when = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    sp = role(spark, sf, "v_spends").join(when, "event_id")
    src = shared_path(spark, "spends-src")
    SC.land_in_order(sp, src, "ts", 4)
    SC.land_marker(spark, src, sp.schema, "ts", "2100-01-01")
    return sp, src


@register("stream_wallet")
def _q_stream_wallet(spark, sf):
    sp, src = _landed_spends(spark, sf)
    return SWA.wallet_stream(spark, src, sp.schema, _wallet(spark, sf), shared_path(spark, "wallet-sink"),
                             shared_path(spark, "ckpt-wallet"))


@register("shape_slice")
def _q_shape_slice(spark, sf):
    return _plan(spark, sf, path="slice")


@register("user_collection")
def _q_user_collection(spark, sf):
    return _as_double(LO.user_collection(_wallet(spark, sf), LO.badges_dim(spark)), "next_tier", "coins_needed")
