"""Place and restaurant catalogue jobs: cleaning, export, lookup, search, paging.

Inputs use the role columns (lower case): places ``tsid, nom, ord, latitude,
longitude, descriptif, photo, adresse1, adresse2, codepostal, commune,
frequentation_score``; restaurants ``tsid, nom, latitude, longitude,
codepostal, specialites``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentier import constants as K
from sentier.functions import text as T
from sentier.operators.ranking import global_row_number, page_of

PLACE_COLUMNS = ["tsid", "nom", "longitude", "latitude", "descriptif", "photo",
                 "adresse1", "adresse2", "codepostal", "commune"]
EXPORT_COLUMNS = ["nom", "latitude", "longitude", "descriptif", "photo", "tsid"]
REQUIRED = ["nom", "latitude", "longitude", "tsid"]


def places_dedup(places: DataFrame) -> DataFrame:
    """Project the ten catalogue columns and drop duplicate rows."""
    return places.select(*PLACE_COLUMNS).dropDuplicates()


def with_address(places: DataFrame) -> DataFrame:
    return places.withColumn("addr", T.place_address("adresse1", "adresse2", "codepostal", "commune"))


def _fill_blank(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def map_export(places: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Both catalogues as map records: rows missing a required
    field dropped, other nulls shown as ''."""
    def prep(df, kind):
        for c in EXPORT_COLUMNS:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        df = df.select(*EXPORT_COLUMNS).na.drop(subset=REQUIRED)
        return _fill_blank(df, ["descriptif", "photo"]).withColumn("kind", F.lit(kind))
    return prep(places, "lieu").unionByName(prep(restaurants, "restaurant"))


def export_records_json(export: DataFrame) -> DataFrame:
    """One JSON record per row (``orient='records'`` shape)."""
    return export.select("kind", F.to_json(F.struct(*EXPORT_COLUMNS)).alias("record"))


def map_markers(export: DataFrame) -> DataFrame:
    """P10: markers the map draws: name, description non-empty and
    coordinates non-zero (JavaScript truthiness)."""
    return export.where((F.col("nom") != "") & (F.col("descriptif") != "")
                        & (F.col("latitude") != 0) & (F.col("longitude") != 0)
                        & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in ``order`` (file order of the app)."""
    cols = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return picked.select(key, "_r.*")


def place_detail(places: DataFrame, keys: DataFrame) -> DataFrame:
    """P4 batch form: for every requested tsid, the first catalogue row with
    that tsid, required fields present, blanks filled, address and photo."""
    clean = places.na.drop(subset=REQUIRED)
    first = first_by_key(clean, "tsid", "ord")
    hit = keys.select("tsid").distinct().join(first, "tsid", "inner")
    hit = with_address(hit).withColumn("photo_url", T.first_photo("photo"))
    return _fill_blank(hit.select("tsid", "nom", "latitude", "longitude", "descriptif", "addr",
                                  "codepostal", "commune", "photo_url"),
                       ["descriptif", "codepostal", "commune"])


def restaurants_county(restaurants: DataFrame, county: str = "76") -> DataFrame:
    """P5: restaurants whose postal code starts with ``county`` (pushed to the
    Parquet scan as StringStartsWith when read directly)."""
    r = restaurants.na.drop(subset=REQUIRED)
    r = r.where(F.col("codepostal").startswith(county))
    return _fill_blank(r.select("tsid", "nom", "codepostal", "specialites"), ["specialites"])


def place_search(places: DataFrame, query: str, regex: bool = True) -> DataFrame:
    """Case-insensitive (regex) name search, nulls never match; an empty
    query finds nothing."""
    if not query:
        return places.select("nom", "tsid").limit(0)
    return places.where(T.name_matches("nom", query, regex)).select("nom", "tsid")


def places_paged(places: DataFrame, county: str = "76", per_page: int = K.PLACES_PER_PAGE) -> DataFrame:
    """County places sorted by attendance score ascending (nulls last,
    then file order); every row gets its global rank and page number."""
    sub = places.where(F.col("codepostal").startswith(county))
    ranked = global_row_number(sub, [F.asc_nulls_last("frequentation_score"), F.asc("ord")])
    return (ranked.select("tsid", "nom", "commune",
                          F.coalesce(F.col("descriptif"), F.lit("")).alias("descriptif"),
                          T.first_photo("photo").alias("photo_url"),
                          "frequentation_score", "rank")
            .withColumn("page", page_of("rank", per_page)))


def places_page(places: DataFrame, page: int, county: str = "76", per_page: int = K.PLACES_PER_PAGE) -> DataFrame:
    """O1 single page: ``orderBy().offset().limit()`` (a top-k, no full sort)."""
    page = max(int(page), 1)
    sub = places.where(F.col("codepostal").startswith(county))
    return (sub.orderBy(F.asc_nulls_last("frequentation_score"), F.asc("ord"))
            .offset((page - 1) * per_page).limit(per_page)
            .select("tsid", "nom", "commune", T.first_photo("photo").alias("photo_url")))


def restaurants_paged(restaurants: DataFrame, county: str = "76", per_page: int = K.PLACES_PER_PAGE) -> DataFrame:
    """The county's restaurants in catalogue order (tsid), with rank and page,
    first photo, description and specialities (blank if missing)."""
    sub = restaurants.na.drop(subset=REQUIRED).where(F.col("codepostal").startswith(county))
    ranked = global_row_number(sub, [F.asc("tsid")])
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return (ranked.select("tsid", "nom", blank("commune"), blank("descriptif"), T.first_photo("photo").alias("photo_url"),
                          blank("specialites"), "rank").withColumn("page", page_of("rank", per_page)))


def restaurant_detail(restaurants: DataFrame, keys: DataFrame, access: DataFrame) -> DataFrame:
    """P4 for restaurants: the asked rows with address and accessibility by name."""
    from sentier.plans.access import accessibility_join
    hit = restaurants.na.drop(subset=REQUIRED).join(keys.select("tsid").distinct(), "tsid", "left_semi")
    info = accessibility_join(hit, access, "ord").select("tsid", "matched", "accueil_personnels")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return (hit.select("tsid", "nom", T.restaurant_address("adresse1", "adresse2", "codepostal", "commune").alias("addr"),
                       blank("telephone"), blank("web"), blank("vegetarien")).join(info, "tsid"))


def page_counts(lists: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Rows and ceil page count for each named list."""
    out = None
    for name, (df, per_page) in lists.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("list"), "n_rows",
            F.ceil(F.col("n_rows") / F.lit(per_page)).cast("long").alias("n_pages"))
        out = one if out is None else out.unionByName(one)
    return out


def catalogue_union(places: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Both catalogues as one table, columns aligned by name."""
    return (places.withColumn("kind", F.lit("lieu"))
            .unionByName(restaurants.withColumn("kind", F.lit("restaurant")), allowMissingColumns=True))


def specialty_tags(restaurants: DataFrame) -> DataFrame:
    """restaurants per speciality tag."""
    return (restaurants.where(F.col("specialites").isNotNull())
            .select("tsid", F.explode(T.split_list("specialites")).alias("tag"))
            .groupBy("tag").agg(F.countDistinct("tsid").alias("n_restaurants")))


def slug_collisions(df: DataFrame, name_col: str, key_col: str) -> DataFrame:
    """F9 companion: slugs shared by more than one key."""
    return (df.select(T.slug(name_col).alias("slug"), key_col)
            .groupBy("slug").agg(F.countDistinct(key_col).alias("n_keys"))
            .where(F.col("n_keys") > 1))


def osm_nodes_from_places(places: DataFrame) -> DataFrame:
    """Fixture mapping: places as OSM nodes (id, lat, lon, tags); the amenity
    tag comes from the description ('PROMO' kinds are drinking water)."""
    amenity = F.when(F.col("descriptif").startswith("PROMO"), F.lit("drinking_water")).otherwise(F.lit("bench"))
    tags = F.when(F.col("descriptif").isNull(), F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("amenity"), amenity, F.lit("name"), F.col("nom")))
    return places.select(F.col("ord").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
                         tags.alias("tags"))


def _as_feature(nodes: DataFrame) -> DataFrame:
    geom = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    tags = F.coalesce("tags", F.create_map().cast("map<string,string>"))
    feat = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), geom.alias("geometry"), tags.alias("properties")))
    return nodes.select("id", "lon", "lat", F.to_json(tags).alias("properties"), feat.alias("feature"))


def node_features(nodes: DataFrame) -> DataFrame:
    """Every node as a GeoJSON point feature (coordinates in lon, lat
    order), untagged ones with empty properties; ``feature`` holds one JSON
    feature per row, ready for a line-delimited FeatureCollection."""
    return _as_feature(nodes)


def water_features(nodes: DataFrame, bbox=K.WATER_BBOX, amenity: str = "drinking_water") -> DataFrame:
    """The features of nodes inside the box with the amenity tag."""
    s, w, n, e = bbox
    return _as_feature(nodes.where(F.col("lat").between(s, n) & F.col("lon").between(w, e)
                                   & (F.element_at("tags", "amenity") == amenity)))
