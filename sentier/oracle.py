"""DuckDB oracle SQL, one statement per registry key.

Written independently of the Spark code: brute force where the Spark side
prunes (all pairs instead of grid cells, full sorts instead of top-k), over the
same role views (inlined as CTEs; DuckDB has the base tables as views).
"""

from __future__ import annotations

from sentier.sources.tables import oracle_ctes as W

AS_OF = "DATE '2001-12-01'"

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- C4 feedback
ORACLE["sentiment_counts"] = W("v_feedback") + """
SELECT upper(substr(sentiment, 1, 1)) || lower(substr(sentiment, 2)) AS label, count(*) AS n
FROM v_feedback WHERE sentiment IS NOT NULL GROUP BY sentiment"""

ORACLE["theme_counts"] = W("v_feedback") + """
SELECT theme, count(*) AS n FROM v_feedback WHERE theme IS NOT NULL GROUP BY theme"""

ORACLE["top_negative_places"] = W("v_feedback") + """
SELECT nom, count(*) AS n_negative FROM v_feedback WHERE sentiment = 'Négatif'
GROUP BY nom ORDER BY n_negative DESC, nom LIMIT 3"""

ORACLE["recent_negatives"] = W("v_feedback") + """
SELECT fid, CAST(date AS VARCHAR) AS date, nom, feedback FROM v_feedback WHERE sentiment = 'Négatif'
ORDER BY v_feedback.date DESC, fid LIMIT 5"""

ORACLE["sentiment_trend"] = W("v_feedback") + f"""
SELECT strftime(date, '%Y-%m') AS month,
  count(*) FILTER (WHERE sentiment = 'Positif') AS trend_positive,
  count(*) FILTER (WHERE sentiment = 'Neutre') AS trend_neutral,
  count(*) FILTER (WHERE sentiment = 'Négatif') AS trend_negative
FROM v_feedback WHERE date < {AS_OF} - 120 GROUP BY 1"""

ORACLE["feedback_paged"] = W("v_feedback") + """
, s AS (SELECT *, row_number() OVER (ORDER BY date DESC, fid) AS rn, count(*) OVER () AS total FROM v_feedback)
SELECT fid, username, CAST(date AS VARCHAR) AS date, tsid, nom, feedback, theme, sentiment,
  CAST(rn - 16 AS INTEGER) AS rank_in_page, (24 < total) AS has_next, true AS has_prev, CAST(3 AS INTEGER) AS page
FROM s WHERE rn BETWEEN 17 AND 24"""

ORACLE["feedback_concat"] = W("v_feedback") + """
SELECT tsid, month, CAST(floor((rn - 1) / 1000) AS BIGINT) AS chunk, string_agg(feedback, ';' ORDER BY fid) AS corpus,
  count(*) AS n_feedback
FROM (SELECT tsid, strftime(date, '%Y-%m') AS month, fid, feedback,
  row_number() OVER (PARTITION BY tsid, strftime(date, '%Y-%m') ORDER BY fid) AS rn
  FROM v_feedback WHERE feedback IS NOT NULL) GROUP BY 1, 2, 3"""

ORACLE["feedback_dashboard"] = W("v_feedback") + f"""
, neg AS (SELECT * FROM v_feedback WHERE sentiment = 'Négatif')
, trend AS (
  SELECT strftime(date, '%Y-%m') AS month,
    count(*) FILTER (WHERE sentiment = 'Positif') AS p, count(*) FILTER (WHERE sentiment = 'Neutre') AS u,
    count(*) FILTER (WHERE sentiment = 'Négatif') AS g
  FROM v_feedback WHERE date < {AS_OF} - 120 GROUP BY 1)
SELECT 'sentiment' AS panel, upper(substr(sentiment, 1, 1)) || lower(substr(sentiment, 2)) AS label, count(*) AS value
  FROM v_feedback WHERE sentiment IS NOT NULL GROUP BY sentiment
UNION ALL SELECT 'theme', theme, count(*) FROM v_feedback WHERE theme IS NOT NULL GROUP BY theme
UNION ALL SELECT * FROM (SELECT 'top_negative', nom, count(*) AS c FROM neg GROUP BY nom ORDER BY c DESC, nom LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'recent_negative', concat_ws(' | ', CAST(date AS VARCHAR), nom, feedback), fid
  FROM neg ORDER BY date DESC, fid LIMIT 5)
UNION ALL SELECT 'trend', month || ' positive', p FROM trend
UNION ALL SELECT 'trend', month || ' neutral', u FROM trend
UNION ALL SELECT 'trend', month || ' negative', g FROM trend"""

# ---------------------------------------------------------------- catalogue
PHOTO = """CASE WHEN photo IS NOT NULL AND photo <> '' AND regexp_matches(
  split_part(regexp_replace(split_part(photo, ' ## ', 1), '^\\s+|\\s+$', '', 'g'), ' ', 1), '^https?://')
  THEN split_part(regexp_replace(split_part(photo, ' ## ', 1), '^\\s+|\\s+$', '', 'g'), ' ', 1)
  ELSE 'static/imgs/no_photo.jpg' END"""
ADDR = """trim(regexp_replace(concat_ws(' ', coalesce(adresse1, ''), coalesce(adresse2, ''),
  coalesce(codepostal, ''), coalesce(commune, '')), '\\s+', ' ', 'g'))"""

ORACLE["places_dedup"] = W("v_places") + """
SELECT DISTINCT tsid, nom, longitude, latitude, descriptif, photo, adresse1, adresse2, codepostal, commune FROM v_places"""

ORACLE["restaurants_scan"] = W("v_restaurants") + "SELECT * FROM v_restaurants"

_EXPORT = W("v_places", "v_restaurants") + """
, ex AS (
  SELECT nom, latitude, longitude, coalesce(descriptif, '') AS descriptif, coalesce(photo, '') AS photo, tsid, 'lieu' AS kind
  FROM v_places WHERE nom IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND tsid IS NOT NULL
  UNION ALL
  SELECT nom, latitude, longitude, coalesce(descriptif, ''), coalesce(photo, ''), tsid, 'restaurant'
  FROM v_restaurants WHERE nom IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND tsid IS NOT NULL)
"""
ORACLE["map_export"] = _EXPORT + "SELECT * FROM ex"
ORACLE["records_export"] = ORACLE["map_export"]
ORACLE["map_markers"] = _EXPORT + """SELECT * FROM ex
WHERE nom <> '' AND descriptif <> '' AND latitude <> 0 AND longitude <> 0"""

ORACLE["place_detail"] = W("v_places", "v_feedback") + f"""
, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tsid ORDER BY ord) AS rn FROM v_places
  WHERE nom IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND tsid IS NOT NULL) WHERE rn = 1)
SELECT tsid, nom, latitude, longitude, coalesce(descriptif, '') AS descriptif, {ADDR} AS addr,
  coalesce(codepostal, '') AS codepostal, coalesce(commune, '') AS commune, {PHOTO} AS photo_url
FROM first WHERE tsid IN (SELECT tsid FROM v_feedback)"""

ORACLE["restaurants_county"] = W("v_restaurants") + """
SELECT tsid, nom, codepostal, coalesce(specialites, '') AS specialites FROM v_restaurants
WHERE nom IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND tsid IS NOT NULL
  AND starts_with(codepostal, '76')"""

ORACLE["place_search"] = W("v_places") + """
SELECT nom, tsid FROM v_places WHERE coalesce(regexp_matches(nom, '(?i)BLU(e|sh) [a-c]'), false)"""

ORACLE["places_paged"] = W("v_places") + f"""
SELECT tsid, nom, commune, coalesce(descriptif, '') AS descriptif, {PHOTO} AS photo_url, frequentation_score,
  row_number() OVER (ORDER BY frequentation_score ASC NULLS LAST, ord) AS rank,
  CAST(ceil(row_number() OVER (ORDER BY frequentation_score ASC NULLS LAST, ord) / 10) AS BIGINT) AS page
FROM v_places WHERE starts_with(codepostal, '2')"""

ORACLE["page_counts"] = W("v_places", "v_restaurants", "v_feedback") + """
SELECT 'monuments' AS list, count(*) AS n_rows, CAST(ceil(count(*) / 10) AS BIGINT) AS n_pages
  FROM v_places WHERE starts_with(codepostal, '2')
UNION ALL SELECT 'restaurants', count(*), CAST(ceil(count(*) / 10) AS BIGINT) FROM v_restaurants
  WHERE nom IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND tsid IS NOT NULL AND starts_with(codepostal, '76')
UNION ALL SELECT 'feedback', count(*), CAST(ceil(count(*) / 8) AS BIGINT) FROM v_feedback"""

ORACLE["catalogue_union"] = W("v_places", "v_restaurants") + """
SELECT * REPLACE (CAST(ord AS VARCHAR) AS ord, CAST(vegetarien AS VARCHAR) AS vegetarien) FROM (
  SELECT *, 'lieu' AS kind FROM v_places UNION ALL BY NAME SELECT *, 'restaurant' AS kind FROM v_restaurants)"""

ORACLE["restaurants_paged"] = W("v_restaurants") + f"""
SELECT tsid, nom, coalesce(commune, '') AS commune, coalesce(descriptif, '') AS descriptif, {PHOTO} AS photo_url,
  coalesce(specialites, '') AS specialites, row_number() OVER (ORDER BY tsid) AS rank,
  CAST(ceil(row_number() OVER (ORDER BY tsid) / 10) AS BIGINT) AS page
FROM v_restaurants WHERE starts_with(codepostal, '76')"""

ORACLE["restaurant_detail"] = W("v_restaurants", "v_access") + """
SELECT r.tsid, r.nom, coalesce(r.adresse1, '') || ' ' || coalesce(r.adresse2, '') || ' ' || coalesce(r.codepostal, '') || ' ' ||
  coalesce(r.commune, '') AS addr, coalesce(r.telephone, '') AS telephone, coalesce(r.web, '') AS web,
  coalesce(CAST(r.vegetarien AS VARCHAR), '') AS vegetarien, a.name IS NOT NULL AS matched,
  CASE WHEN a.name IS NULL THEN NULL ELSE coalesce(a.accueil_personnels, 'Non disponible') END AS accueil_personnels
FROM v_restaurants r LEFT JOIN (SELECT * FROM v_access QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1) a ON a.name = r.nom"""

ORACLE["geojson_nodes"] = W("v_places") + """
SELECT ord AS id, longitude AS lon, latitude AS lat, CASE WHEN descriptif IS NULL THEN '{}' ELSE json_object('amenity',
  CASE WHEN starts_with(descriptif, 'PROMO') THEN 'drinking_water' ELSE 'bench' END, 'name', nom)::VARCHAR END AS properties
FROM v_places"""

ORACLE["place_address"] = W("v_places") + f"SELECT tsid, {ADDR} AS addr FROM v_places"

ORACLE["restaurant_address"] = W("v_restaurants") + """
SELECT tsid, coalesce(adresse1, '') || ' ' || coalesce(adresse2, '') || ' ' || coalesce(codepostal, '') || ' '
  || coalesce(commune, '') AS addr FROM v_restaurants"""

ORACLE["first_photo"] = W("v_places") + f"""
SELECT tsid, {PHOTO} AS photo_url,
  CASE WHEN photo IS NULL THEN 'static/imgs/no_photo.jpg' ELSE split_part(photo, ' ## ', 1) END AS photo_raw
FROM v_places"""

ORACLE["specialty_tags"] = W("v_restaurants") + """
SELECT tag, count(DISTINCT tsid) AS n_restaurants
FROM (SELECT tsid, unnest(string_split(specialites, ' ## ')) AS tag FROM v_restaurants WHERE specialites IS NOT NULL)
GROUP BY tag"""

ORACLE["feature_text"] = W("v_places") + "SELECT tsid, concat_ws(' ', nom, descriptif) AS text FROM v_places"

ORACLE["retrieval_text"] = W("v_places") + """
SELECT tsid, concat_ws(' ', descriptif, commune, codepostal, adresse1, envies, equipements, type) AS text FROM v_places"""

ORACLE["theme_key"] = """
SELECT doc_id, strip_accents(regexp_replace(replace(text, ' ', '_'), '[/()]', '', 'g')) AS key FROM documents"""

ORACLE["place_slug"] = """
SELECT doc_id, lower(regexp_replace(regexp_replace(strip_accents(text), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', '_', 'g')) AS slug
FROM documents"""

ORACLE["description_teaser"] = """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS teaser,
  CASE WHEN len(string_split(text, ' ')) > 30
    THEN array_to_string(string_split(text, ' ')[1:30], ' ') || '...' ELSE text END AS teaser_words
FROM documents"""

ORACLE["date_parts"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, strftime(ts, '%d/%m/%Y') AS day_fr,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour FROM events"""


# ---------------------------------------------------------------- geo + transit
def _gc_km(p1, l1, p2, l2):
    """Great-circle km (sphere R = 6371.009) as DuckDB SQL."""
    a1, o1, a2, o2 = (f"radians({x})" for x in (p1, l1, p2, l2))
    return (f"(6371.009 * atan2(sqrt(pow(cos({a2}) * sin({o2} - {o1}), 2) + pow(cos({a1}) * sin({a2}) - "
            f"sin({a1}) * cos({a2}) * cos({o2} - {o1}), 2)), sin({a1}) * sin({a2}) + cos({a1}) * cos({a2}) * "
            f"cos({o2} - {o1})))")


def _geo_m(p1, l1, p2, l2):
    """WGS-84 metres by Lambert's formula as DuckDB SQL (macro-free text)."""
    f = "(1 / 298.257223563)"
    b1 = f"atan((1 - {f}) * tan(radians({p1})))"
    b2 = f"atan((1 - {f}) * tan(radians({p2})))"
    dl = f"(radians({l2}) - radians({l1}))"
    sig = (f"atan2(sqrt(pow(cos({b2}) * sin({dl}), 2) + pow(cos({b1}) * sin({b2}) - sin({b1}) * cos({b2}) * cos({dl}), 2)),"
           f" sin({b1}) * sin({b2}) + cos({b1}) * cos({b2}) * cos({dl}))")
    P, Q = f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    x = f"(({sig}) - sin({sig})) * pow(sin({P}), 2) * pow(cos({Q}), 2) / pow(cos(({sig}) / 2), 2)"
    y = f"(({sig}) + sin({sig})) * pow(cos({P}), 2) * pow(sin({Q}), 2) / pow(sin(({sig}) / 2), 2)"
    return f"(CASE WHEN ({sig}) = 0 THEN 0.0 ELSE 6378137.0 * (({sig}) - {f} / 2 * (({x}) + ({y}))) END)"


ORACLE["geo_distance"] = W("v_requests") + f"""
SELECT req_id, round({_gc_km('start_lat', 'start_lon', 'end_lat', 'end_lon')}, 6) AS km,
  round({_gc_km('start_lat', 'start_lon', 'end_lat', 'end_lon')} * 1000, 3) AS meters FROM v_requests"""

ORACLE["geodesic_distance"] = W("v_requests") + f"""
SELECT req_id, round({_geo_m('start_lat', 'start_lon', 'end_lat', 'end_lon')}, 3) AS meters FROM v_requests"""

ORACLE["postal_distance"] = W("v_places") + """
SELECT tsid, CASE WHEN regexp_matches(codepostal, '^[0-9]+$') THEN abs(CAST(codepostal AS DOUBLE) - 76000)
  ELSE 'inf'::DOUBLE END AS postal_dist FROM v_places"""

_GT = W("v_requests", "v_stops", "v_stop_times", "v_trips", "v_routes", "v_shapes")
_NEAR = f"""
, sc AS (SELECT r.req_id, s.stop_id, s.stop_name, {_geo_m('r.start_lat', 'r.start_lon', 's.stop_lat', 's.stop_lon')} AS d
  FROM v_requests r CROSS JOIN v_stops s)
, start_s AS (SELECT req_id, stop_id, stop_name, d FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY d, stop_id) AS rn
  FROM sc WHERE d <= 2000) WHERE rn = 1)
, sr AS (SELECT DISTINCT st.stop_id, t.route_id FROM v_stop_times st JOIN v_trips t USING (trip_id))
, ec AS (SELECT r.req_id, st.stop_id AS ref_stop_id, s.stop_id AS cand_id,
    {_geo_m('r.end_lat', 'r.end_lon', 's.stop_lat', 's.stop_lon')} AS d
  FROM v_requests r JOIN start_s st USING (req_id) CROSS JOIN v_stops s)
, end_s AS (SELECT req_id, ref_stop_id, cand_id AS end_stop_id, d FROM (
    SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY d, cand_id) AS rn FROM ec
    WHERE d <= 2000 AND (ref_stop_id, cand_id) IN (SELECT (a.stop_id, b.stop_id) FROM sr a JOIN sr b ON a.route_id = b.route_id))
  WHERE rn = 1)
"""

ORACLE["nearest_stop"] = _GT + _NEAR + """
SELECT r.req_id, CAST(s.stop_id AS VARCHAR) AS stop_id, s.stop_name, round(s.d, 3) AS dist_m
FROM v_requests r LEFT JOIN start_s s USING (req_id)"""

ORACLE["nearest_stop_shared_route"] = _GT + _NEAR + """
SELECT req_id, ref_stop_id, end_stop_id, round(d, 3) AS end_dist_m FROM end_s"""

_PAIRS = f"""
, ecp AS (SELECT r.req_id, s.stop_id, {_geo_m('r.end_lat', 'r.end_lon', 's.stop_lat', 's.stop_lon')} AS d
  FROM v_requests r CROSS JOIN v_stops s)
, end_p AS (SELECT req_id, stop_id FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY d, stop_id) AS rn
  FROM ecp WHERE d <= 2000) WHERE rn = 1)
, pairs AS (SELECT DISTINCT a.stop_id AS start_stop_id, b.stop_id AS end_stop_id FROM start_s a JOIN end_p b USING (req_id))
, conn AS (SELECT p.start_stop_id, p.end_stop_id, a.trip_id, a.stop_sequence AS stop_sequence_start,
    b.stop_sequence AS stop_sequence_end
  FROM pairs p JOIN v_stop_times a ON a.stop_id = p.start_stop_id JOIN v_stop_times b ON b.trip_id = a.trip_id AND b.stop_id = p.end_stop_id)
"""
ORACLE["trips_between_stops"] = _GT + _NEAR + _PAIRS + "SELECT * FROM conn"

ORACLE["trips_unconnected"] = _GT + _NEAR + _PAIRS + """
, lonely AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM conn c WHERE c.start_stop_id = p.start_stop_id
  AND c.end_stop_id = p.end_stop_id))
, st AS (SELECT DISTINCT trip_id, stop_id FROM v_stop_times)
SELECT l.start_stop_id, l.end_stop_id, st.trip_id, 'start' AS side FROM lonely l JOIN st ON st.stop_id = l.start_stop_id
UNION ALL
SELECT l.start_stop_id, l.end_stop_id, st.trip_id, 'end' FROM lonely l JOIN st ON st.stop_id = l.end_stop_id"""

ORACLE["routes_per_stop"] = _GT + """
SELECT DISTINCT st.stop_id, t.route_id FROM v_stop_times st JOIN v_trips t USING (trip_id)"""

_MODE = """CASE WHEN contains(lower(route_short_name), 'métro') THEN 'metro'
  WHEN regexp_matches(lower(route_short_name), '^t[0-9]+$') THEN 'tram' ELSE 'bus' END"""

ORACLE["trip_route_shape"] = _GT + f"""
SELECT trip_id, route_id, shape_id, route_short_name, {_MODE} AS transport_mode
FROM v_trips LEFT JOIN v_routes USING (route_id)"""

ORACLE["route_mode"] = W("v_routes") + f"""
SELECT route_id, route_short_name, {_MODE} AS transport_mode FROM v_routes"""

_KM = f"({_geo_m('start_lat', 'start_lon', 'end_lat', 'end_lon')} / 1000)"
ORACLE["trip_co2"] = W("v_requests") + f"""
SELECT req_id, mode, round(km * CASE mode WHEN 'bike' THEN 0.0 WHEN 'bus' THEN 55.9 WHEN 'tram' THEN 1.2
  WHEN 'metro' THEN 1.42 ELSE 0.0 END, 6) AS co2_g
FROM (SELECT req_id, {_KM} AS km FROM v_requests)
CROSS JOIN (VALUES ('bike'), ('bus'), ('tram'), ('metro'), ('walk')) m(mode)"""

ORACLE["trip_coins"] = W("v_requests") + f"""
SELECT req_id, mode, round(CASE mode WHEN 'bike' THEN floor(km * 150) WHEN 'bus' THEN floor(km * 100)
  ELSE km * 50 END, 6) AS coins
FROM (SELECT req_id, {_KM} AS km FROM v_requests)
CROSS JOIN (VALUES ('bike'), ('bus'), ('walk')) m(mode)"""

_PTS = f"""
, pts0 AS (SELECT shape_id, seq, lat, lon, CAST(row_number() OVER (PARTITION BY shape_id ORDER BY seq) - 1 AS INTEGER) AS idx,
   lead(lat) OVER (PARTITION BY shape_id ORDER BY seq) AS next_lat, lead(lon) OVER (PARTITION BY shape_id ORDER BY seq) AS next_lon
   FROM v_shapes)
, pts AS (SELECT *, CASE WHEN next_lat IS NULL THEN 0.0 ELSE {_geo_m('lat', 'lon', 'next_lat', 'next_lon')} / 1000 END AS seg_km FROM pts0)
"""
ORACLE["path_segments"] = _GT + _PTS + "SELECT shape_id, seq, idx, next_lat, next_lon, round(seg_km, 6) AS seg_km FROM pts"
ORACLE["path_length"] = _GT + _PTS + """
SELECT shape_id, round(sum(seg_km), 6) AS length_km, count(*) AS n_points FROM pts GROUP BY shape_id"""
ORACLE["path_bbox"] = W("v_shapes") + """
SELECT shape_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM v_shapes GROUP BY shape_id"""

_PLAN = _GT + _NEAR + _PTS + f"""
, pr AS (SELECT s.req_id, s.stop_id AS start_stop_id, e.end_stop_id FROM start_s s JOIN end_s e USING (req_id))
, tr AS (SELECT pr.req_id, min(a.trip_id) AS trip_id FROM pr JOIN v_stop_times a ON a.stop_id = pr.start_stop_id
   JOIN v_stop_times b ON b.trip_id = a.trip_id AND b.stop_id = pr.end_stop_id GROUP BY pr.req_id)
, lg AS (SELECT pr.*, tr.trip_id, t.route_id, t.shape_id, ro.route_short_name,
    ss.stop_lat AS s_lat, ss.stop_lon AS s_lon, es.stop_lat AS e_lat, es.stop_lon AS e_lon,
    ss.stop_name AS start_stop_name, es.stop_name AS end_stop_name
  FROM pr JOIN tr USING (req_id) JOIN v_trips t ON t.trip_id = tr.trip_id LEFT JOIN v_routes ro ON ro.route_id = t.route_id
  JOIN v_stops ss ON ss.stop_id = pr.start_stop_id JOIN v_stops es ON es.stop_id = pr.end_stop_id)
, vx AS (SELECT lg.req_id,
    (SELECT idx FROM pts WHERE pts.shape_id = lg.shape_id ORDER BY {_geo_m('lg.s_lat', 'lg.s_lon', 'pts.lat', 'pts.lon')}, idx LIMIT 1) AS start_idx,
    (SELECT idx FROM pts WHERE pts.shape_id = lg.shape_id ORDER BY {_geo_m('lg.e_lat', 'lg.e_lon', 'pts.lat', 'pts.lon')}, idx LIMIT 1) AS end_idx
  FROM lg)
, lg2 AS (SELECT lg.*, vx.start_idx, vx.end_idx, least(vx.start_idx, vx.end_idx) AS lo, greatest(vx.start_idx, vx.end_idx) AS hi
  FROM lg JOIN vx USING (req_id))
, lg3 AS (SELECT lg2.*, coalesce((SELECT sum(seg_km) FROM pts WHERE pts.shape_id = lg2.shape_id AND pts.idx >= lg2.lo AND pts.idx < lg2.hi), 0.0) AS transit_km,
    {_MODE} AS transport_mode FROM lg2)
, plan AS (
  SELECT r.req_id,
    CASE WHEN s.stop_id IS NULL THEN 'no_stop' WHEN e.end_stop_id IS NULL THEN 'no_shared_stop'
         WHEN l.trip_id IS NULL THEN 'no_trip' ELSE 'ok' END AS status,
    s.stop_id AS start_stop_id, e.end_stop_id, l.trip_id, l.route_id, l.transport_mode, l.shape_id,
    l.start_idx, l.end_idx, CAST(l.hi - l.lo + 1 AS INTEGER) AS n_points, l.transit_km,
    ({_geo_m('r.start_lat', 'r.start_lon', 'l.s_lat', 'l.s_lon')} + {_geo_m('l.e_lat', 'l.e_lon', 'r.end_lat', 'r.end_lon')}) / 1000 AS walk_km,
    r.start_lat, r.start_lon, r.end_lat, r.end_lon, l.s_lat, l.s_lon, l.e_lat, l.e_lon, l.lo, l.hi,
    l.start_stop_name, l.end_stop_name
  FROM v_requests r LEFT JOIN start_s s USING (req_id) LEFT JOIN end_s e USING (req_id) LEFT JOIN lg3 l USING (req_id))
"""
ORACLE["plan_transit_trips"] = _PLAN + """
SELECT req_id, status, CAST(start_stop_id AS VARCHAR) AS start_stop_id, CAST(end_stop_id AS VARCHAR) AS end_stop_id,
  CAST(trip_id AS VARCHAR) AS trip_id, CAST(route_id AS VARCHAR) AS route_id, transport_mode, CAST(shape_id AS VARCHAR) AS shape_id,
  CAST(start_idx AS DOUBLE) AS start_idx, CAST(end_idx AS DOUBLE) AS end_idx,
  CAST(n_points AS DOUBLE) AS n_points, round(transit_km, 6) AS transit_km, round(walk_km, 6) AS walk_km,
  round(transit_km * CASE transport_mode WHEN 'bus' THEN 55.9 WHEN 'tram' THEN 1.2 WHEN 'metro' THEN 1.42 ELSE 0.0 END, 6) AS co2_g,
  floor((walk_km + transit_km) * 100) AS coins, start_stop_name, end_stop_name,
  s_lat AS start_stop_lat, s_lon AS start_stop_lon, e_lat AS end_stop_lat, e_lon AS end_stop_lon
FROM plan"""

ORACLE["nearest_vertex"] = _PLAN + "SELECT req_id, shape_id, start_idx, end_idx FROM plan WHERE status = 'ok'"

ORACLE["trip_path"] = _PLAN + """
, ok AS (SELECT * FROM plan WHERE status = 'ok')
SELECT req_id, 0 AS pos, start_lat AS lat, start_lon AS lon FROM ok
UNION ALL SELECT req_id, 1, s_lat, s_lon FROM ok
UNION ALL SELECT ok.req_id, CAST(2 + CASE WHEN ok.start_idx >= ok.end_idx THEN ok.hi - p.idx ELSE p.idx - ok.lo END AS INTEGER),
  p.lat, p.lon FROM ok JOIN pts p ON p.shape_id = ok.shape_id AND p.idx BETWEEN ok.lo AND ok.hi
UNION ALL SELECT req_id, CAST(2 + coalesce(n_points, 0) AS INTEGER), e_lat, e_lon FROM ok
UNION ALL SELECT req_id, CAST(3 + coalesce(n_points, 0) AS INTEGER), end_lat, end_lon FROM ok"""


# ---------------------------------------------------------------- vectors, recommendation, retrieval
ORACLE["vector_knn"] = W("v_queries", "v_vectors") + """
SELECT qid, tsid, CAST(rn AS INTEGER) AS rank, round(d, 6) AS dist FROM (
  SELECT q.qid, v.tsid, pow(list_distance(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 2) AS d,
    row_number() OVER (PARTITION BY q.qid ORDER BY pow(list_distance(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 2), v.tsid) AS rn
  FROM v_queries q CROSS JOIN v_vectors v) WHERE rn <= 100"""

ORACLE["vector_store_knn"] = ORACLE["vector_knn"].replace("rn <= 100", "rn <= 10")

_COS = """CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
  ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END"""

ORACLE["cosine_pairs"] = W("v_vectors") + f"""
, vv AS (SELECT tsid, CAST(vector AS DOUBLE[]) AS v FROM v_vectors)
SELECT tsid, CAST(rn AS INTEGER) AS rank, neighbour, round(c, 6) AS cosine FROM (
  SELECT a.tsid, b.tsid AS neighbour, {_COS} AS c,
    row_number() OVER (PARTITION BY a.tsid ORDER BY {_COS} DESC, b.tsid) AS rn
  FROM vv a JOIN vv b ON a.tsid <> b.tsid) WHERE rn <= 10"""

_RECS = W("v_places", "v_vectors", "v_feedback") + f"""
, pv AS (SELECT p.tsid, p.nom, p.latitude, p.longitude, p.photo, CAST(v.vector AS DOUBLE[]) AS v
  FROM v_places p JOIN v_vectors v USING (tsid))
, sc AS (SELECT a.tsid AS ref_tsid, b.tsid, b.photo, {_gc_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km,
    {_COS} - 0.5 * {_gc_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS score
  FROM pv a JOIN pv b ON a.tsid <> b.tsid)
, recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_tsid ORDER BY score DESC, tsid) AS rn FROM sc) WHERE rn <= 8)
"""
ORACLE["recommend_places"] = _RECS + """
SELECT ref_tsid, CAST(rn AS INTEGER) AS rank, tsid, round(km * 1000, 3) AS distance_m,
  CASE WHEN photo IS NULL THEN 'static/imgs/no_photo.jpg' ELSE split_part(photo, ' ## ', 1) END AS photo_url,
  round(score, 6) AS score FROM recs"""

ORACLE["user_recommendations"] = _RECS + """
, last AS (SELECT username, tsid FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY date DESC, fid DESC) AS rn
  FROM v_feedback) WHERE rn = 1)
SELECT l.username, r.ref_tsid, CAST(r.rn AS INTEGER) AS rank, r.tsid AS rec_tsid, round(r.km * 1000, 3) AS distance_m
FROM last l JOIN recs r ON r.ref_tsid = l.tsid"""

ORACLE["nearest_places"] = W("v_requests", "v_places") + f"""
SELECT req_id, CAST(rn AS INTEGER) AS rank, tsid, round(d * 1000, 3) AS distance_m FROM (
  SELECT r.req_id, p.tsid, {_gc_km('r.start_lat', 'r.start_lon', 'p.latitude', 'p.longitude')} AS d,
    row_number() OVER (PARTITION BY r.req_id ORDER BY {_gc_km('r.start_lat', 'r.start_lon', 'p.latitude', 'p.longitude')}, p.tsid) AS rn
  FROM v_requests r CROSS JOIN v_places p) WHERE rn <= 10"""

_LOC = W("v_queries", "v_places", "v_vectors") + """
, com AS (SELECT commune, min(ord) AS first_ord FROM v_places WHERE commune IS NOT NULL GROUP BY commune)
, loc AS (SELECT qid, commune AS location FROM (SELECT q.qid, c.commune,
    row_number() OVER (PARTITION BY q.qid ORDER BY c.first_ord) AS rn
  FROM v_queries q JOIN com c ON contains(lower(q.query), lower(c.commune))) WHERE rn = 1)
, pst AS (SELECT location, codepostal AS postal FROM (SELECT c.commune AS location, p.codepostal,
    row_number() OVER (PARTITION BY c.commune ORDER BY p.ord) AS rn
  FROM com c JOIN v_places p ON contains(lower(p.commune), lower(c.commune))) WHERE rn = 1)
, ql AS (SELECT q.qid, l.location, s.postal FROM v_queries q LEFT JOIN loc l USING (qid) LEFT JOIN pst s USING (location))
"""
ORACLE["query_location"] = _LOC + "SELECT qid, location, postal FROM ql"

_RAG = _LOC + """
, nn AS (SELECT * FROM (SELECT q.qid, p.tsid, p.codepostal,
    pow(list_distance(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 2) AS ed,
    row_number() OVER (PARTITION BY q.qid ORDER BY pow(list_distance(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 2), p.tsid) AS rn
  FROM v_queries q CROSS JOIN (v_places p JOIN v_vectors v USING (tsid))) WHERE rn <= 100)
, sc AS (SELECT nn.qid, nn.tsid, ql.location, nn.ed,
    CASE WHEN ql.location IS NULL THEN 0.0 WHEN ql.postal IS NULL THEN 'inf'::DOUBLE
         WHEN regexp_matches(ql.postal, '^[0-9]+$') AND regexp_matches(nn.codepostal, '^[0-9]+$')
         THEN abs(CAST(ql.postal AS DOUBLE) - CAST(nn.codepostal AS DOUBLE)) ELSE 'inf'::DOUBLE END AS gd
  FROM nn JOIN ql USING (qid))
, rk AS (SELECT *, 0.5 * ed + 0.5 * gd AS cs, row_number() OVER (PARTITION BY qid ORDER BY 0.5 * ed + 0.5 * gd, ed, tsid) AS rn FROM sc)
"""
ORACLE["rag_retrieve"] = _RAG + """
SELECT qid, CAST(rn AS INTEGER) AS rank, tsid, location, round(ed, 6) AS embedding_distance, gd AS geo_distance,
  round(cs, 6) AS combined_score FROM rk WHERE rn <= 10"""

ORACLE["rag_context"] = _RAG + """
SELECT r.qid, string_agg('Nom : ' || coalesce(p.nom, 'nan') || ', Description : ' || coalesce(p.descriptif, 'nan')
    || ', Lieu : ' || coalesce(p.commune, 'nan'), chr(10) ORDER BY r.rn) AS context,
  string_agg(r.tsid, ',' ORDER BY r.rn) AS tsids
FROM rk r JOIN v_places p USING (tsid) WHERE r.rn <= 10 GROUP BY r.qid"""


# ---------------------------------------------------------------- loyalty
ORACLE["user_levels"] = W("v_wallet") + """
SELECT user_id, coins, CAST(floor(experience / 1000) AS INTEGER) AS level,
  CAST((floor(experience / 1000) + 1) * 1000 - experience AS INTEGER) AS coins_for_next_level FROM v_wallet"""

ORACLE["user_badges"] = W("v_wallet") + """
, b AS (SELECT * FROM (VALUES ('Incontournable de la Normandie', 'A visité la Cathédrale de Rouen'),
  ('Connaisseur de la région', 'A visité 50% de la Normandie'),
  ('Ami des deux roues', 'S''est déplacé en vélo sur plus de 10 km')) t(badge, description))
, ex AS (SELECT user_id, CAST(generate_subscripts(string_split(badges, ';'), 1) - 1 AS INTEGER) AS pos,
  unnest(string_split(badges, ';')) AS badge FROM v_wallet WHERE badges IS NOT NULL)
SELECT ex.user_id, ex.pos, ex.badge, coalesce(b.description, 'Description non disponible') AS description
FROM ex LEFT JOIN b USING (badge)"""

_TIERS = """
, tiers AS (SELECT * FROM (VALUES (1, 1000, 2000, 3), (2, 2000, 3000, 3), (3, 3000, 5000, 3), (4, 5000, NULL, 3))
  t(tier, min_nc, max_nc, n_rewards))
, hi AS (SELECT w.user_id, w.coins, coalesce(max(t.tier) FILTER (WHERE t.min_nc <= w.coins AND (t.max_nc IS NULL OR w.coins < t.max_nc)), 0) AS hi
  FROM v_wallet w CROSS JOIN tiers t GROUP BY w.user_id, w.coins)
"""
ORACLE["tier_access"] = W("v_wallet") + _TIERS + """
SELECT h.user_id, h.coins, t.tier, t.min_nc, coalesce(CAST(t.max_nc AS VARCHAR), '∞') AS max_nc, t.tier <= h.hi AS accessible
FROM hi h CROSS JOIN tiers t"""

ORACLE["tiers_dim"] = W("v_wallet") + _TIERS + """
SELECT t.tier, count(*) AS n_users, t.n_rewards FROM hi h JOIN tiers t ON t.tier <= h.hi GROUP BY t.tier, t.n_rewards"""

ORACLE["tier_progress"] = W("v_wallet") + _TIERS + """
SELECT h.user_id, h.coins, h.hi AS current_tier,
  CASE WHEN h.hi > 0 THEN least((h.hi - 1) * 100.0 / 3, 100.0) ELSE 0.0 END AS position_pct,
  CAST(CASE WHEN h.hi > 0 AND h.hi < 4 THEN h.hi + 1 END AS DOUBLE) AS next_tier,
  CAST(CASE WHEN h.hi > 0 AND h.hi < 4 THEN (SELECT min_nc FROM tiers WHERE tier = h.hi + 1) - h.coins END AS DOUBLE) AS coins_needed
FROM hi h"""

_LEDGER = W("v_wallet", "v_spends").replace("WITH ", "WITH RECURSIVE ", 1) + """
, sp AS (SELECT s.user_id, s.event_id, s.cost, row_number() OVER (PARTITION BY s.user_id ORDER BY s.event_id) AS rn
  FROM v_spends s JOIN v_wallet USING (user_id))
, rec(user_id, rn, bal, acc, ok) AS (
  SELECT user_id, CAST(0 AS BIGINT), coins, 0, false FROM v_wallet
  UNION ALL
  SELECT r.user_id, r.rn + 1,
    CASE WHEN sp.cost > 0 AND r.bal >= sp.cost THEN r.bal - sp.cost ELSE r.bal END,
    r.acc + CASE WHEN sp.cost > 0 AND r.bal >= sp.cost THEN 1 ELSE 0 END,
    sp.cost > 0 AND r.bal >= sp.cost
  FROM rec r JOIN sp ON sp.user_id = r.user_id AND sp.rn = r.rn + 1)
"""
ORACLE["wallet_balances"] = _LEDGER + """
SELECT user_id, arg_max(bal, rn) AS balance, CAST(arg_max(acc, rn) AS BIGINT) AS n_accepted,
  CAST(max(rn) - arg_max(acc, rn) AS BIGINT) AS n_rejected FROM rec GROUP BY user_id"""

ORACLE["wallet_ledger"] = _LEDGER + """
SELECT sp.user_id, sp.event_id, sp.cost, r.ok AS accepted, r.bal AS balance
FROM sp JOIN rec r ON r.user_id = sp.user_id AND r.rn = sp.rn"""

ORACLE["users_insert_new"] = """
WITH ex AS (SELECT 'user' || c_custkey AS username, c_name AS name FROM customer)
, reg AS (SELECT lower(upper(CASE WHEN o_orderstatus = 'P' THEN 'Guest' ELSE 'User' END || o_custkey)) AS username,
  min('Nom ' || o_custkey) AS name FROM orders GROUP BY 1)
SELECT username, name FROM ex
UNION ALL SELECT username, name FROM reg WHERE username NOT IN (SELECT username FROM ex)"""

ORACLE["users_snapshot"] = ORACLE["users_insert_new"]


# ---------------------------------------------------------------- calendar
_AG = """
WITH ag AS (SELECT event_id AS uid, event_type || ' #' || event_id AS title, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS start,
  strftime(ts + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S') AS "end", props AS description, 'Rue ' || user_id AS location,
  strftime(ts, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 2 DAY, '%Y-%m-%dT%H:%M:%S') AS later FROM events)
"""
ORACLE["json_flatten"] = _AG + """
SELECT uid, title AS "title.fr", start AS "firstTiming.begin", "end" AS "lastTiming.end", description AS "description.fr",
  location AS "location.address" FROM ag"""
ORACLE["event_calendar"] = _AG + 'SELECT uid, title, start, "end", description, location, day FROM ag'
ORACLE["json_event_pages"] = ORACLE["event_calendar"]
ORACLE["events_per_day"] = _AG + "SELECT day, count(*) AS n_events FROM ag GROUP BY day"
ORACLE["events_by_day_nested"] = _AG + """
SELECT day, count(*) OVER (PARTITION BY day) AS n_events, row_number() OVER (PARTITION BY day ORDER BY start, uid) AS pos,
  uid, start, title FROM ag"""
ORACLE["events_upcoming"] = _AG + """
SELECT uid, title, start FROM ag WHERE start >= '2024-01-15T00:00:00' OR later >= '2024-01-15T00:00:00'"""

# ---------------------------------------------------------------- feedback ingest
_THEMES_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in __import__("sentier.constants", fromlist=["THEMES"]).THEMES) + "]"
_EXPL = W("v_raw_feedback") + f"""
, parsed AS (SELECT *, CASE WHEN json_valid(raw) THEN from_json(raw, '{{"results":[{{"verbatim":"VARCHAR","theme":"VARCHAR","sentiment":"VARCHAR"}}]}}').results END AS res
  FROM v_raw_feedback)
, chk AS (SELECT *, coalesce(res IS NOT NULL AND len(res) > 0 AND list_bool_and(list_transform(res, lambda x:
    x.verbatim IS NOT NULL AND list_contains({_THEMES_SQL}, x.theme) AND list_contains(['Négatif', 'Neutre', 'Positif'], x.sentiment))), false) AS ok
  FROM parsed)
, items AS (SELECT *, CASE WHEN ok THEN res ELSE [{{'verbatim': feedback, 'theme': 'Autres', 'sentiment': 'Neutre'}}] END AS its FROM chk)
, ex AS (SELECT fid, username, longitude, latitude, nom, feedback, CAST(generate_subscripts(its, 1) - 1 AS INTEGER) AS pos, unnest(its) AS it FROM items)
, exploded AS (SELECT fid, username, longitude, latitude, nom, feedback, pos, it.verbatim AS verbatim, it.theme AS theme,
  it.sentiment AS sentiment FROM ex)
"""
ORACLE["verbatim_explode"] = _EXPL + "SELECT fid, pos, verbatim, theme, sentiment FROM exploded"

_TSID = """
, pk AS (SELECT round(longitude, 7) AS lo, round(latitude, 7) AS la, arg_min(tsid, ord) AS tp FROM v_places
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2)
, rk AS (SELECT round(longitude, 7) AS lo, round(latitude, 7) AS la, min(tsid) AS tr FROM v_restaurants
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2)
"""
ORACLE["feedback_tsid"] = W("v_raw_feedback") + _TSID + """
SELECT f.fid, coalesce(pk.tp, rk.tr, 'XXXXXX') AS tsid FROM v_raw_feedback f
LEFT JOIN pk ON pk.lo = round(f.longitude, 7) AND pk.la = round(f.latitude, 7)
LEFT JOIN rk ON rk.lo = round(f.longitude, 7) AND rk.la = round(f.latitude, 7)"""

_ING = _EXPL + _TSID + """
, ing AS (SELECT e.*, coalesce(pk.tp, rk.tr, 'XXXXXX') AS tsid, DATE '2001-12-01' AS date FROM exploded e
  LEFT JOIN pk ON pk.lo = round(e.longitude, 7) AND pk.la = round(e.latitude, 7)
  LEFT JOIN rk ON rk.lo = round(e.longitude, 7) AND rk.la = round(e.latitude, 7))
"""
ORACLE["ingest_feedback"] = _ING + """
SELECT fid, username, longitude, latitude, nom, feedback, pos, verbatim, theme, sentiment, tsid,
  CAST(date AS VARCHAR) AS date FROM ing"""

ORACLE["feedback_append"] = _ING.replace("WITH ", "WITH v_feedback AS (" + __import__("sentier.sources.tables", fromlist=["ROLE_VIEWS"]).ROLE_VIEWS["v_feedback"].replace("{orders}", "orders").strip() + "),\n", 1) + """
SELECT month, source, sentiment, count(*) AS n FROM (
  SELECT strftime(date, '%Y-%m') AS month, 'history' AS source, sentiment FROM v_feedback
  UNION ALL SELECT strftime(date, '%Y-%m'), 'ingest', sentiment FROM ing) GROUP BY 1, 2, 3"""

ORACLE["feedback_newest"] = ORACLE["feedback_append"].rsplit("SELECT month, source, sentiment, count(*) AS n", 1)[0] + """
SELECT fid, source, verbatim, rank, CAST(ceil(rank / 8) AS BIGINT) AS page FROM (
  SELECT fid, source, verbatim, row_number() OVER (ORDER BY seq DESC, fid, verbatim NULLS FIRST) AS rank FROM (
    SELECT fid, 'history' AS source, CAST(NULL AS VARCHAR) AS verbatim, 1 AS seq FROM v_feedback
    UNION ALL SELECT fid, 'ingest', verbatim, 2 FROM ing))"""

ORACLE["feedback_restore"] = W("v_feedback") + """
SELECT fid, username, CAST(date AS VARCHAR) AS date, tsid, nom, theme, sentiment, feedback FROM v_feedback"""

# ---------------------------------------------------------------- accessibility
_ACC = W("v_places", "v_access") + """
, j AS (SELECT p.tsid, a.name IS NOT NULL AS matched, a.entree_pmr, a.accueil_personnels FROM v_places p
  LEFT JOIN (SELECT * FROM v_access QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1) a ON a.name = p.nom)
"""
ORACLE["accessibility_join"] = _ACC + """
SELECT tsid, matched, CAST(CASE WHEN matched THEN coalesce(entree_pmr, false) END AS VARCHAR) AS entree_pmr,
  CAST(CASE WHEN matched THEN false END AS VARCHAR) AS stationnement_pmr,
  CASE WHEN matched THEN coalesce(accueil_personnels, 'Non disponible') END AS accueil_personnels,
  CASE WHEN matched THEN '' END AS labels FROM j"""
ORACLE["accessibility_labels"] = _ACC + """
SELECT tsid, CASE WHEN matched AND entree_pmr THEN 'Oui' ELSE 'Non disponible' END AS entree_pmr,
  'Non disponible' AS sanitaires_adaptes,
  CASE WHEN matched AND coalesce(accueil_personnels, 'Non disponible') <> '' THEN coalesce(accueil_personnels, 'Non disponible')
       ELSE 'Non disponible' END AS accueil_personnels,
  'Non disponible' AS labels FROM j"""

ORACLE["place_page"] = ("WITH pages AS (" + ORACLE["place_detail"] + "), shown AS (" + ORACLE["accessibility_labels"]
                        + ") SELECT pages.*, entree_pmr, accueil_personnels FROM pages JOIN shown USING (tsid)")


# ---------------------------------------------------------------- sources, bikes
ORACLE["csv_semicolon_roundtrip"] = W("v_places") + "SELECT * FROM v_places"

ORACLE["gtfs_scan_counts"] = W("v_stops", "v_stop_times", "v_trips", "v_routes", "v_shapes") + """
SELECT 'routes' AS table_name, count(*) AS n_rows FROM v_routes
UNION ALL SELECT 'shapes', count(*) FROM v_shapes UNION ALL SELECT 'stop_times', count(*) FROM v_stop_times
UNION ALL SELECT 'stops', count(*) FROM v_stops UNION ALL SELECT 'trips', count(*) FROM v_trips"""

ORACLE["csv_comma_roundtrip"] = W("v_access") + """
SELECT name, ord, CAST(entree_pmr AS VARCHAR) AS entree_pmr, accueil_personnels FROM v_access"""

ORACLE["feedback_or_empty"] = W("v_feedback") + """
SELECT 'landed' AS feed, count(*) AS n_rows, count(theme) AS n_themes FROM v_feedback UNION ALL SELECT 'absent', 0, 0"""

ORACLE["gtfs_feed_content"] = W("v_stops", "v_stop_times", "v_trips", "v_routes", "v_shapes") + """
SELECT 'stops' AS table_name, count(*) FILTER (stop_id % 50 <> 0) AS n_rows, count(DISTINCT stop_id) FILTER (stop_id % 50 <> 0) AS n_keys,
  coalesce(round(sum(stop_lat) FILTER (stop_id % 50 <> 0), 2), 0.0) AS total, count(*) FILTER (stop_id % 50 = 0) AS n_bad FROM v_stops
UNION ALL SELECT 'stop_times', count(*) FILTER (trip_id % 50 <> 0), count(DISTINCT trip_id) FILTER (trip_id % 50 <> 0),
  coalesce(round(CAST(sum(stop_sequence) FILTER (trip_id % 50 <> 0) AS DOUBLE), 2), 0.0), count(*) FILTER (trip_id % 50 = 0) FROM v_stop_times
UNION ALL SELECT 'trips', count(*), count(DISTINCT shape_id), 0.0, 0 FROM v_trips
UNION ALL SELECT 'routes', count(*), count(DISTINCT route_short_name), 0.0, 0 FROM v_routes
UNION ALL SELECT 'shapes', count(*) FILTER (shape_id % 50 <> 0), count(DISTINCT shape_id) FILTER (shape_id % 50 <> 0),
  coalesce(round(sum(lat) FILTER (shape_id % 50 <> 0), 2), 0.0), count(*) FILTER (shape_id % 50 = 0) FROM v_shapes"""

ORACLE["json_stations_inline"] = W("v_stations") + """
SELECT CAST(station_id AS VARCHAR) AS station_id, name, lat, lon FROM v_stations"""

ORACLE["stations_joined"] = W("v_stations") + """
SELECT CAST(station_id AS VARCHAR) AS station_id, name, lat, lon, CAST(num_bikes_available AS INTEGER) AS num_bikes_available,
  CAST(num_docks_available AS INTEGER) AS num_docks_available FROM v_stations"""

ORACLE["geojson_points"] = W("v_places") + """
SELECT ord AS id, longitude AS lon, latitude AS lat,
  json_object('amenity', 'drinking_water', 'name', nom)::VARCHAR AS properties FROM v_places
WHERE descriptif IS NOT NULL AND starts_with(descriptif, 'PROMO') AND latitude BETWEEN 49.0 AND 50.0 AND longitude BETWEEN -1.7 AND 1.5"""

ORACLE["json_clean"] = _PLAN + """
SELECT req_id, '{' || concat_ws(',', '"status":' || to_json(status), '"start_stop_id":' || start_stop_id,
  '"end_stop_id":' || end_stop_id, '"trip_id":' || trip_id, '"transport_mode":' || to_json(transport_mode)) || '}' AS json
FROM plan"""

ORACLE["vector_store_roundtrip"] = W("v_vectors") + """
SELECT tsid, CAST(len(vector) AS INTEGER) AS dim,
  round(sqrt(list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 6) AS norm FROM v_vectors"""

ORACLE["embed_incremental"] = W("v_places", "v_vectors") + """
SELECT tsid, CASE WHEN tsid IN (SELECT tsid FROM v_vectors) THEN 'store' ELSE 'new' END AS source, 64 AS dim,
  true AS same_space FROM v_places"""

_HIST = """
, base AS (SELECT station_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
  avg(bikes) AS predicted_bikes, avg(docks) AS predicted_docks, count(*) AS n_obs FROM v_bike_history GROUP BY 1, 2, 3)
"""
ORACLE["availability_baseline"] = W("v_bike_history") + _HIST + """
SELECT station_id, weekday, hour, round(predicted_bikes, 6) AS predicted_bikes, round(predicted_docks, 6) AS predicted_docks,
  n_obs FROM base"""

ORACLE["availability_model"] = W("v_stations", "v_bike_history") + """
, ids AS (SELECT station_id, EXISTS (SELECT 1 FROM v_bike_history h WHERE h.station_id = s.station_id) AS known FROM v_stations s
  UNION ALL SELECT -1, false)
SELECT station_id, CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, CASE WHEN known THEN true END AS bikes_in_range,
  CASE WHEN known THEN true END AS docks_in_range FROM ids CROSS JOIN (SELECT unnest(range(24)) AS hour)
  CROSS JOIN (SELECT unnest(range(7)) AS weekday)"""

_NS_TAIL = _HIST + f"""
, d AS (SELECT r.*, s.station_id, s.num_bikes_available AS nb, s.num_docks_available AS nd, s.lat, s.lon,
    {_geo_m('r.start_lat', 'r.start_lon', 's.lat', 's.lon')} AS ds, {_geo_m('r.end_lat', 'r.end_lon', 's.lat', 's.lon')} AS de,
    b.predicted_bikes AS pb, b.predicted_docks AS pd
  FROM v_requests r CROSS JOIN v_stations s
  LEFT JOIN base b ON b.station_id = s.station_id AND b.weekday = r.weekday AND b.hour = r.hour)
, s0 AS (SELECT req_id, arg_min(station_id, (ds, station_id)) AS sid, min(ds) AS dm FROM d WHERE nb > 0 GROUP BY req_id)
, e0 AS (SELECT req_id, arg_min(station_id, (de, station_id)) AS sid, min(de) AS dm FROM d WHERE nd > 0 GROUP BY req_id)
, s1 AS (SELECT req_id, arg_min(station_id, (ds, station_id)) AS sid, min(ds) AS dm FROM d WHERE pb > 0 GROUP BY req_id)
, e1 AS (SELECT req_id, arg_min(station_id, (de, station_id)) AS sid, min(de) AS dm FROM d WHERE pd > 0 GROUP BY req_id)
"""
_NS = W("v_requests", "v_stations", "v_bike_history") + _NS_TAIL
_BIKE = f"""
, ch AS (SELECT r.req_id, r.mode, r.start_lat, r.start_lon, r.end_lat, r.end_lon, ps.predicted_bikes AS pred_bikes, pe.predicted_docks AS pred_docks,
    CASE WHEN coalesce(ps.predicted_bikes, 0) < 1 THEN s1.sid ELSE s0.sid END AS start_station_id,
    CASE WHEN coalesce(pe.predicted_docks, 0) < 1 THEN e1.sid ELSE e0.sid END AS end_station_id
  FROM v_requests r LEFT JOIN s0 USING (req_id) LEFT JOIN e0 USING (req_id) LEFT JOIN s1 USING (req_id) LEFT JOIN e1 USING (req_id)
  LEFT JOIN base ps ON ps.station_id = s0.sid AND ps.weekday = r.weekday AND ps.hour = r.hour
  LEFT JOIN base pe ON pe.station_id = e0.sid AND pe.weekday = r.weekday AND pe.hour = r.hour)
, bike AS (SELECT ch.*, a.name AS start_station, a.lat AS start_station_lat, a.num_bikes_available AS start_bikes,
    b.name AS end_station, b.lon AS end_station_lon, b.num_docks_available AS end_docks,
    {_geo_m('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1000 AS bike_km,
    ({_geo_m('ch.start_lat', 'ch.start_lon', 'a.lat', 'a.lon')} + {_geo_m('a.lat', 'a.lon', 'b.lat', 'b.lon')}
    + {_geo_m('b.lat', 'b.lon', 'ch.end_lat', 'ch.end_lon')}) / 1000 AS total_km
  FROM ch LEFT JOIN v_stations a ON a.station_id = ch.start_station_id LEFT JOIN v_stations b ON b.station_id = ch.end_station_id)
"""
ORACLE["nearest_station"] = _NS + """
SELECT s0.req_id, s0.sid AS start_station_id, round(s0.dm, 3) AS start_dist_m, e0.sid AS end_station_id, round(e0.dm, 3) AS end_dist_m
FROM s0 JOIN e0 USING (req_id)"""

ORACLE["nearest_station_predicted"] = _NS + """
SELECT r.req_id, s1.sid AS bikes_at, round(s1.dm, 3) AS bikes_m, e1.sid AS docks_at, round(e1.dm, 3) AS docks_m
FROM v_requests r LEFT JOIN s1 USING (req_id) LEFT JOIN e1 USING (req_id)"""

ORACLE["plan_bike_trips"] = _NS + _BIKE + """
SELECT req_id, start_station_id, start_station, start_station_lat, start_bikes, end_station_id, end_station, end_station_lon,
  end_docks, round(pred_bikes, 6) AS pred_bikes, round(pred_docks, 6) AS pred_docks, round(bike_km, 6) AS bike_km,
  round(total_km, 6) AS total_km, floor(total_km * 150) AS coins, 'velo' AS transport_mode FROM bike"""


ORACLE["find_routes"] = (W("v_requests", "v_stops", "v_stop_times", "v_trips", "v_routes", "v_shapes", "v_stations", "v_bike_history")
                         + _PLAN[len(_GT):] + _NS_TAIL + _BIKE + """
, ask AS (SELECT req_id, coalesce(mode, 'bike') AS mode FROM v_requests)
SELECT a.req_id, a.mode,
  CASE WHEN a.mode = 'bike' THEN CASE WHEN b.total_km IS NULL THEN 'no_station' ELSE 'ok' END
    WHEN a.mode = 'bus' THEN CASE WHEN p.status = 'ok' THEN 'ok' ELSE 'no_route' END ELSE 'bad_mode' END AS status,
  CASE WHEN a.mode = 'bike' THEN CAST(b.start_station_id AS VARCHAR) WHEN a.mode = 'bus' AND p.status = 'ok' THEN CAST(p.start_stop_id AS VARCHAR) END AS start_id,
  CASE WHEN a.mode = 'bike' THEN CAST(b.end_station_id AS VARCHAR) WHEN a.mode = 'bus' AND p.status = 'ok' THEN CAST(p.end_stop_id AS VARCHAR) END AS end_id,
  round(CASE WHEN a.mode = 'bike' THEN b.total_km WHEN a.mode = 'bus' AND p.status = 'ok' THEN p.walk_km + p.transit_km END, 6) AS total_km,
  CASE WHEN a.mode = 'bike' THEN floor(b.total_km * 150) WHEN a.mode = 'bus' AND p.status = 'ok' THEN floor((p.walk_km + p.transit_km) * 100) END AS coins,
  CASE WHEN a.mode = 'bike' THEN 'velo' WHEN a.mode = 'bus' AND p.status = 'ok' THEN p.transport_mode END AS transport_mode
FROM ask a LEFT JOIN bike b USING (req_id) LEFT JOIN plan p USING (req_id)""")


# ---------------------------------------------------------------- models: what SQL can say about their output
ORACLE["embed_places"] = W("v_places") + "SELECT tsid, 64 AS dim, 1.0 AS norm FROM v_places"
ORACLE["classify_text"] = "SELECT doc_id, true AS has_quality, true AS has_toxic, true AS held_out_agrees FROM documents"


# ---------------------------------------------------------------- streaming (same answers as batch)
ORACLE["stream_feedback_ingest"] = ORACLE["ingest_feedback"]
ORACLE["stream_wallet"] = ORACLE["wallet_ledger"]
ORACLE["stream_sentiment_windows"] = W("v_feedback") + """
SELECT CAST(DATE '1970-01-01' + CAST(floor(datediff('day', DATE '1970-01-01', date) / 30) * 30 AS INTEGER) AS VARCHAR) AS window_start,
  sentiment, count(*) AS n FROM v_feedback GROUP BY 1, 2"""

ORACLE["shape_slice"] = _PLAN + """
SELECT ok.req_id, CAST(CASE WHEN ok.start_idx >= ok.end_idx THEN ok.hi - p.idx ELSE p.idx - ok.lo END AS INTEGER) AS pos,
  p.lat, p.lon FROM (SELECT * FROM plan WHERE status = 'ok') ok JOIN pts p ON p.shape_id = ok.shape_id AND p.idx BETWEEN ok.lo AND ok.hi"""

ORACLE["user_collection"] = W("v_wallet") + _TIERS + """
, b AS (SELECT * FROM (VALUES ('Incontournable de la Normandie', 'A visité la Cathédrale de Rouen'),
  ('Connaisseur de la région', 'A visité 50% de la Normandie'),
  ('Ami des deux roues', 'S''est déplacé en vélo sur plus de 10 km')) t(badge, description))
, ex AS (SELECT user_id, generate_subscripts(string_split(badges, ';'), 1) AS pos,
  unnest(string_split(badges, ';')) AS badge FROM v_wallet WHERE badges IS NOT NULL)
, bl AS (SELECT ex.user_id, string_agg(ex.badge || ': ' || coalesce(b.description, 'Description non disponible'), ' | ' ORDER BY ex.pos) AS badges
  FROM ex LEFT JOIN b USING (badge) GROUP BY ex.user_id)
SELECT w.user_id, w.coins, CAST(floor(w.experience / 1000) AS INTEGER) AS level,
  CAST((floor(w.experience / 1000) + 1) * 1000 - w.experience AS INTEGER) AS coins_for_next_level,
  coalesce(bl.badges, '') AS badges, h.hi AS current_tier,
  CAST(CASE WHEN h.hi > 0 AND h.hi < 4 THEN h.hi + 1 END AS DOUBLE) AS next_tier,
  CAST(CASE WHEN h.hi > 0 AND h.hi < 4 THEN (SELECT min_nc FROM tiers WHERE tier = h.hi + 1) - h.coins END AS DOUBLE) AS coins_needed
FROM v_wallet w LEFT JOIN bl USING (user_id) JOIN hi h USING (user_id)"""
