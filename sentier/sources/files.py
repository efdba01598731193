"""File sources and sinks: delimited text, GTFS, nested JSON feeds, snapshots.

Writers always write a new directory under the cluster's shared folder (the
session's ``spark.checkpoint.dir``) and read it back, so a job that loses an
executor re-reads committed files instead of recomputing lineage.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Whole-table rewrite as a new snapshot directory (never over the
    path being read); returns the committed snapshot."""
    df.write.mode("errorifexists").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("errorifexists").options(sep=sep, header=True, quote='"', escape='"',
                                           ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


BROKEN = "_broken_record"


class Checked(NamedTuple):
    """A source split in its good rows and its quarantine (file, reason, record); each
    row of the source stands in one of the two. Both read the same files."""

    good: DataFrame
    quarantine: DataFrame

    def counts(self) -> tuple[int, int]:
        """(good rows, quarantined rows)."""
        return self.good.count(), self.quarantine.count()


def _as_struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _whole() -> Column:
    """Whether a row was read whole. Not a plain IS NULL: that would be pushed into
    the parser, which knows of a broken record only after its filters."""
    return F.length(F.coalesce(F.col(BROKEN), F.lit(""))) == 0


def _delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str, multiline: bool,
               optional: tuple[str, ...]) -> DataFrame:
    """Every row as text, cast column by column: the schema's columns, the broken
    record (null if the row has the header's number of fields), the names of the
    cells that don't fit their type, and the file."""
    # a pruned parser would not see that a row has too few fields
    how = dict(columnPruning=False, sep=sep, header=True, quote='"', escape='"', multiLine=multiline, ignoreLeadingWhiteSpace=False,
               ignoreTrailingWhiteSpace=False)
    header = spark.read.options(**how).csv(path).columns  # the first file's
    # names are matched without a byte order mark, blanks around them and case
    names = {c.strip("\ufeff \t").lower(): i for i, c in enumerate(header)}
    missing = [f.name for f in schema if f.name.lower() not in names and f.name not in optional]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {', '.join(header)}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField(BROKEN, T.StringType())])
    raw = (spark.read.schema(text).options(**how, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
           .csv(path))
    cells, unfit = [], []
    for f in schema:
        at = names.get(f.name.lower())
        if at is None:
            cells.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        cell = F.col(f"`{header[at]}`")
        value = cell if isinstance(f.dataType, T.StringType) else F.trim(cell).try_cast(f.dataType)
        cells.append(value.alias(f.name))
        unfit.append(F.when(cell.isNotNull() & value.isNull(), F.lit(f.name)))
    return raw.select(*cells, F.col(BROKEN), F.concat_ws(", ", *unfit).alias("_unfit"),
                      F.to_json(F.struct(*[F.col(f"`{c}`") for c in header])).alias("_row"),
                      F.col("_metadata.file_path").alias("_file"))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";",
                     multiline: bool = False, optional: tuple[str, ...] = ()) -> Checked:
    """Delimited text with a header, read by column name: columns may come in
    any order, further ones are ignored, those in ``optional`` may be absent (NULL).
    A row with another number of fields than the header, or with a cell that doesn't
    fit its type, goes to the quarantine. All files of a path must share one header.
    ``multiline`` allows line breaks inside quotes, at the price of one task per file."""
    schema = _as_struct(schema)
    rows = _delimited(spark, path, schema, sep, multiline, optional)
    fine = _whole() & (F.col("_unfit") == "")
    why = F.when(~_whole(), F.lit("number of fields")).otherwise(F.concat(F.lit("not of its type: "), "_unfit"))
    bad = rows.where(~fine).select(F.col("_file").alias("file"), why.alias("reason"), F.coalesce(BROKEN, "_row").alias("record"))
    return Checked(rows.where(fine).select(*[f.name for f in schema]), bad)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";",
             multiline: bool = False, optional: tuple[str, ...] = ()) -> DataFrame:
    """As ``read_csv_checked``, for text that must be whole: a broken row fails the read."""
    schema = _as_struct(schema)
    rows = _delimited(spark, path, schema, sep, multiline, optional)
    fail = F.raise_error(F.concat(F.lit("broken row in "), "_file", F.lit(": "), F.coalesce(BROKEN, "_row")))
    fine = _whole() & (F.col("_unfit") == "")
    return rows.where(F.when(fine, F.lit(True)).otherwise(fail.cast("boolean"))).select(*[f.name for f in schema])


GTFS_SCHEMAS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "stop_times": "trip_id string, stop_id string, stop_sequence int",
    "trips": "trip_id string, route_id string, shape_id string",
    "routes": "route_id string, route_short_name string",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}
# the columns that a feed may leave out
GTFS_OPTIONAL = {"trips": ("shape_id",), "routes": ("route_short_name",), "stops": ("stop_name",)}


def read_gtfs_checked(spark: SparkSession, base: str) -> dict[str, Checked]:
    """The five GTFS text tables of a feed directory, ids as strings, read by the
    names in their headers; broken rows go to each table's quarantine."""
    return {name: read_csv_checked(spark, f"{base.rstrip('/')}/{name}.txt", schema, ",",
                                   optional=GTFS_OPTIONAL.get(name, ()))
            for name, schema in GTFS_SCHEMAS.items()}


def read_gtfs(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """S5 for feeds that must be whole: a broken row fails the read."""
    return {name: read_csv(spark, f"{base.rstrip('/')}/{name}.txt", schema, ",", optional=GTFS_OPTIONAL.get(name, ()))
            for name, schema in GTFS_SCHEMAS.items()}


STATION_INFO_SCHEMA = ("data struct<stations: array<struct<station_id: string, name: string, "
                       "lat: double, lon: double>>>, last_updated long")
STATION_STATUS_SCHEMA = ("data struct<stations: array<struct<station_id: string, num_bikes_available: int, "
                         "num_docks_available: int>>>, last_updated long")


def _documents(spark: SparkSession, path: str, schema: T.StructType | str, rows: str, keep: tuple[str, ...]) -> Checked:
    """Landed JSON documents, one per line (a file may hold many): one row per element of
    the list at ``rows``. Documents that don't parse, or hold no list, are quarantined."""
    schema = T.StructType([*_as_struct(schema).fields, T.StructField(BROKEN, T.StringType())])
    doc = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
           .withColumn("_file", F.col("_metadata.file_path")))
    found = _whole() & F.col(rows).isNotNull()
    why = F.when(~_whole(), F.lit("not a document of this schema")).otherwise(F.lit(f"no list at {rows}"))
    whole = F.to_json(F.struct(*[f.name for f in schema if f.name != BROKEN]))
    bad = doc.where(~found).select(F.col("_file").alias("file"), why.alias("reason"), F.coalesce(BROKEN, whole).alias("record"))
    return Checked(doc.where(found).select(*keep, F.inline(rows)), bad)


def read_station_feed_checked(spark: SparkSession, path: str, schema: str) -> Checked:
    """Landed GBFS documents → one row per station; broken documents apart."""
    return _documents(spark, path, schema, "data.stations", ("last_updated",))


def read_station_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S6 for feeds that must be whole: a broken document fails the read."""
    doc = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return doc.select("last_updated", F.inline("data.stations"))


def read_event_pages_checked(spark: SparkSession, path: str, schema) -> Checked:
    """Landed event pages (``{"events": [...], "after": ...}``) → one row per event;
    broken pages apart."""
    return _documents(spark, path, schema, "events", ())


def read_event_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    """S7 for pages that must be whole: a broken page fails the read."""
    pages = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return pages.select(F.inline("events"))


def write_quarantine(checked: dict[str, Checked], path: str) -> DataFrame:
    """The quarantines of several sources as one table (source, file, reason, record)."""
    for name, c in checked.items():
        c.quarantine.withColumn("source", F.lit(name)).write.mode("append").partitionBy("source").parquet(path)
    first = next(iter(checked.values())).quarantine
    return first.sparkSession.read.schema("file string, reason string, record string, source string").parquet(path)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs → flat columns named with dotted paths (arrays and
    maps kept as values), like a JSON normaliser."""
    def walk(dt: T.StructType, prefix: list[str]):
        cols = []
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                cols += walk(f.dataType, path)
            else:
                ref = F.col(".".join(f"`{p}`" for p in path))
                cols.append(ref.alias(sep.join(path)))
        return cols
    return df.select(*walk(df.schema, []))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether a finished write stands at ``path`` (its success marker)."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path`` with a fixed schema, or an empty table of
    that schema when nothing has been committed there yet. Other read errors
    are raised."""
    return spark.read.schema(schema).parquet(path) if _committed(spark, path) else spark.createDataFrame([], schema)


def compute_if_absent(spark: SparkSession, path: str, build, schema=None) -> DataFrame:
    """Reuse the committed output at ``path`` or run ``build()`` and commit
    it. The leftovers of a write that never finished are written over."""
    if not _committed(spark, path):
        out = build()
        schema = schema or out.schema
        out.write.mode("overwrite").parquet(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


FEATURE_SCHEMA = ("type string, id long, geometry struct<type: string, coordinates: array<double>>, "
                  "properties map<string, string>")


def write_geojson_seq(features: DataFrame, path: str, feature_col: str = "feature") -> None:
    """S17 sink: line-delimited GeoJSON (RFC 8142), one Feature per line,
    written in parallel; no single document has to hold every feature."""
    features.select(F.col(feature_col).alias("value")).write.mode("errorifexists").text(path)


def read_geojson_seq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", FEATURE_SCHEMA).alias("f")).select("f.*")
