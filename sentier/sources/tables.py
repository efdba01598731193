"""Driver tables and the role views that map them onto the app's data model.

The role views are written once as SQL text with ``{table}`` placeholders.
Spark runs the text through ``spark.sql(text, **frames)`` (frames are bound as
scoped views, so nothing leaks between scale factors); the DuckDB oracle runs
the same text as CTEs over its pre-registered tables. Doubles are built from
integer arithmetic so both engines hold identical values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Role views (fixture mapping, fixed text shared with the DuckDB oracle).
# Every view covers its whole source table (no id subsets): requests are all
# orders, questions all embeddings, shapes all events; the accessibility
# table names the parts with p_size > 30 otherwise, so that some places have no
# match, and names some twice (the first by ord counts). Trips map onto all shapes.
ROLE_VIEWS: dict[str, str] = {
    "v_places": """
SELECT concat('P', p_partkey) AS tsid, concat(p_name, ' ', p_partkey) AS nom, p_partkey AS ord,
  CAST(490000 + (p_partkey * 7919) % 10000 AS DOUBLE) / 10000 AS latitude,
  CAST(-17000 + (p_partkey * 104729) % 32000 AS DOUBLE) / 10000 AS longitude,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(p_type, '  ', p_brand) END AS descriptif,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a url'
    WHEN 2 THEN concat('https://img/', p_partkey, '.jpg credit ## https://img/b.jpg')
    ELSE concat(' http://img/', p_partkey, '.png') END AS photo,
  concat(p_size, ' rue  ', p_brand) AS adresse1,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'bis' END AS adresse2,
  CASE WHEN p_partkey % 10 = 0 THEN 'n/a' WHEN p_partkey % 13 = 0 THEN NULL
    ELSE CAST(14000 + (p_partkey * 31) % 63000 AS STRING) END AS codepostal,
  concat('NATION_', p_partkey % 25) AS commune,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS frequentation_score,
  p_brand AS envies, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat('taille ', p_size) END AS equipements, p_type AS type
FROM {part}""",
    "v_restaurants": """
SELECT concat('R', s_suppkey) AS tsid, s_name AS nom,
  CAST(494000 + (s_suppkey * 7919) % 1000 AS DOUBLE) / 10000 AS latitude,
  CAST(10500 + (s_suppkey * 104729) % 1500 AS DOUBLE) / 10000 AS longitude,
  CASE WHEN s_suppkey % 2 = 0 THEN '76000' ELSE '27000' END AS codepostal,
  CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Cidre ## Crêpes' ELSE 'Poisson' END AS specialites,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('table de ', s_name) END AS descriptif,
  CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(' https://img/r', s_suppkey, '.jpg credit ## x') ELSE 'photo' END AS photo,
  concat(s_suppkey, ' quai ') AS adresse1, CASE WHEN s_suppkey % 5 = 0 THEN 'bis' ELSE NULL END AS adresse2,
  concat('NATION_', s_nationkey) AS commune, concat('02 35 ', s_suppkey) AS telephone,
  concat('http://resto', s_suppkey, '.fr') AS web, s_suppkey % 2 = 1 AS vegetarien
FROM {supplier}""",
    "v_feedback": """
SELECT o_orderkey AS fid, concat('user', o_custkey) AS username, CAST(o_orderdate AS DATE) AS date,
  concat('P', o_custkey + o_orderkey % 3) AS tsid,
  concat('Lieu ', o_custkey + o_orderkey % 3) AS nom, o_orderpriority AS theme,
  CASE o_orderstatus WHEN 'F' THEN 'Négatif' WHEN 'O' THEN 'Neutre' ELSE 'Positif' END AS sentiment,
  concat('avis ', o_orderkey, ' ', o_orderpriority) AS feedback
FROM {orders}""",
    "v_stops": """
SELECT s_suppkey AS stop_id, s_name AS stop_name,
  CAST(494000 + (s_suppkey * 7919) % 1000 AS DOUBLE) / 10000 AS stop_lat,
  CAST(10500 + (s_suppkey * 104729) % 1500 AS DOUBLE) / 10000 AS stop_lon
FROM {supplier}""",
    "v_stop_times": """
SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, min(l_linenumber) AS stop_sequence
FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    "v_trips": """
SELECT o_orderkey AS trip_id, o_custkey AS route_id, CAST(floor(o_custkey / 10) AS BIGINT) AS shape_id FROM {orders}""",
    "v_routes": """
SELECT c_custkey AS route_id, CASE c_custkey % 4 WHEN 0 THEN 'Métro' WHEN 1 THEN concat('T', c_custkey % 9)
  WHEN 2 THEN 'TEOR' ELSE concat('F', c_custkey % 9) END AS route_short_name
FROM {customer}""",
    "v_shapes": """
SELECT user_id AS shape_id, event_id AS seq,
  CAST(494000 + (event_id * 613) % 1000 AS DOUBLE) / 10000 AS lat,
  CAST(10500 + (event_id * 977) % 1500 AS DOUBLE) / 10000 AS lon
FROM {events}""",
    "v_requests": """
SELECT o_orderkey AS req_id,
  CAST(494000 + (o_orderkey * 3571) % 1000 + CASE WHEN o_orderkey % 10 = 0 THEN 5000 ELSE 0 END AS DOUBLE) / 10000 AS start_lat,
  CAST(10500 + (o_orderkey * 2221) % 1500 AS DOUBLE) / 10000 AS start_lon,
  CAST(494000 + (o_custkey * 4409) % 1000 + CASE WHEN o_orderkey % 10 = 1 THEN 5000 ELSE 0 END AS DOUBLE) / 10000 AS end_lat,
  CAST(10500 + (o_custkey * 5081) % 1500 AS DOUBLE) / 10000 AS end_lon,
  CAST(o_orderkey % 7 AS INT) AS weekday, CAST(o_orderkey % 24 AS INT) AS hour,
  CASE o_orderkey % 5 WHEN 0 THEN 'bus' WHEN 1 THEN NULL WHEN 2 THEN 'car' ELSE 'bike' END AS mode
FROM {orders}""",
    "v_bike_history": """
SELECT user_id AS station_id, ts, value AS bikes, CAST(event_id % 17 AS DOUBLE) AS docks FROM {events}""",
    "v_stations": """
SELECT stop_id AS station_id, stop_name AS name, stop_lat AS lat, stop_lon AS lon,
  (stop_id * 13) % 7 AS num_bikes_available, (stop_id * 11) % 5 AS num_docks_available
FROM {v_stops}""",
    "v_wallet": """
SELECT c_custkey AS user_id, CAST(floor(c_acctbal) AS INT) AS coins,
  CAST((c_custkey * 37) % 12000 AS INT) AS experience,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Ami des deux roues'
    ELSE 'Ami des deux roues;Badge inconnu' END AS badges
FROM {customer}""",
    "v_spends": """
SELECT event_id, user_id, CAST(floor(value * 10) AS INT) AS cost FROM {events} WHERE event_type = 'purchase'""",
    "v_access": """
SELECT concat(CASE WHEN p_size <= 30 THEN '' ELSE 'ancien ' END, p_name, ' ', p_partkey) AS name, p_partkey AS ord,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS entree_pmr,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS accueil_personnels
FROM {part}
UNION ALL SELECT concat(p_name, ' ', p_partkey) AS name, p_partkey + 1000000000 AS ord, TRUE, 'doublon'
FROM {part} WHERE p_partkey % 5 = 0 AND p_size <= 40""",
    "v_queries": """
SELECT vec_id AS qid, embedding AS vector, concat('que voir vers nation_', vec_id % 25, ' ?') AS query
FROM {embeddings}""",
    "v_vectors": """
SELECT concat('P', vec_id) AS tsid, embedding AS vector FROM {embeddings}""",
}



def _raw_feedback_view() -> str:
    """Classified comments as the app's model returned them, in a 4-cycle:
    valid two-item JSON, malformed JSON, unknown theme, empty list."""
    from sentier.constants import SENTIMENTS, THEMES

    def pick(values, expr):
        whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
        return f"CASE {expr} {whens} END"
    item = ("'{{\"verbatim\": \"{tag} ', c.conv_id, '-', c.turn, '\", \"theme\": \"', {theme}, "
            "'\", \"sentiment\": \"', {sent}, '\"}}'")
    a = item.format(tag="a", theme=pick(THEMES, "c.conv_id % 12"), sent=pick(SENTIMENTS, "c.turn % 3"))
    b = item.format(tag="b", theme=pick(THEMES, "(c.conv_id + 1) % 12"), sent=pick(SENTIMENTS, "(c.turn + 1) % 3"))
    return f"""
SELECT c.conv_id * 1000 + c.turn AS fid, concat('user', c.conv_id % 50) AS username,
  CASE c.turn % 3 WHEN 0 THEN p.longitude WHEN 1 THEN r.longitude ELSE 0.5 END AS longitude,
  CASE c.turn % 3 WHEN 0 THEN p.latitude WHEN 1 THEN r.latitude ELSE 49.5 END AS latitude,
  concat('Lieu ', c.conv_id) AS nom, c.text AS feedback,
  CASE c.turn % 4
    WHEN 0 THEN concat('{{"results": [', {a}, ', ', {b}, ']}}')
    WHEN 1 THEN '{{"results": [{{"verbatim": '
    WHEN 2 THEN concat('{{"results": [{{"verbatim": "c ', c.conv_id, '", "theme": "Météo", "sentiment": "Positif"}}]}}')
    ELSE '{{"results": []}}' END AS raw
FROM {{conversations}} c LEFT JOIN {{v_places}} p ON p.ord = c.conv_id
  LEFT JOIN {{v_restaurants}} r ON r.tsid = concat('R', c.conv_id)"""


def _escape_braces(text: str, placeholders: tuple[str, ...]) -> str:
    """Literal braces doubled (str.format style), placeholders kept single."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in placeholders:
        text = text.replace("{{" + name + "}}", "{" + name + "}")
    return text


ROLE_VIEWS["v_raw_feedback"] = _escape_braces(_raw_feedback_view(), ("conversations", "v_places", "v_restaurants"))

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _deps(name: str) -> list[str]:
    return _PLACEHOLDER.findall(ROLE_VIEWS[name])


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a role view as a DataFrame over the driver tables in ``sf_dir``."""
    frames = {}
    for dep in _deps(name):
        frames[dep] = role(spark, sf_dir, dep) if dep in ROLE_VIEWS else table(spark, sf_dir, dep)
    return spark.sql(ROLE_VIEWS[name], **frames)


def oracle_ctes(*names: str) -> str:
    """``WITH`` clause defining the named role views (and their dependencies)
    for the DuckDB oracle, where base tables are pre-registered views."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in _deps(n):
            if d in ROLE_VIEWS:
                visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in ordered:
        body = _PLACEHOLDER.sub(lambda m: m.group(1), ROLE_VIEWS[n]).strip()
        body = body.replace("{{", "{").replace("}}", "}")
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
