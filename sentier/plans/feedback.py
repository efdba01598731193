"""Feedback analytics (dashboard, paging, corpus) over the feedback table.

Input columns: fid, username, date (DATE), tsid, nom, theme, sentiment,
feedback. Every aggregate here groups on a low-cardinality key (or on the
place), so Spark's partial aggregation keeps the shuffle at one row per key
per task whatever the table size.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentier import constants as K
from sentier.functions.text import capitalize_first
from sentier.operators.ranking import global_row_number, page_of, rank_within_groups


def _as_of(as_of) -> F.Column:
    if isinstance(as_of, F.Column):
        return as_of
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def sentiment_counts(fb: DataFrame) -> DataFrame:
    """A1: rows per sentiment, label capitalised on its first letter only."""
    return (fb.where(F.col("sentiment").isNotNull())
            .groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
            .select(capitalize_first(F.col("sentiment")).alias("label"), "n")
            .orderBy(F.desc("n"), "label"))


def theme_counts(fb: DataFrame) -> DataFrame:
    """A2: rows per theme, descending."""
    return (fb.where(F.col("theme").isNotNull())
            .groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "theme"))


def top_negative_places(fb: DataFrame, n: int = K.TOP_NEGATIVE_N) -> DataFrame:
    """A3: the ``n`` places with most negative rows (ties by name)."""
    return (fb.where(F.col("sentiment") == K.SENTIMENT_NEGATIVE)
            .groupBy("nom").agg(F.count(F.lit(1)).alias("n_negative"))
            .orderBy(F.desc("n_negative"), F.asc("nom"))
            .limit(n))


def recent_negatives(fb: DataFrame, n: int = K.RECENT_NEGATIVE_N) -> DataFrame:
    """O3: the ``n`` most recent negative rows (ties: higher fid first is not
    defined by the app; we break by fid ascending)."""
    return (fb.where(F.col("sentiment") == K.SENTIMENT_NEGATIVE)
            .orderBy(F.desc_nulls_last("date"), F.asc("fid"))
            .select("fid", "date", "nom", "feedback")
            .limit(n))


def sentiment_trend(fb: DataFrame, as_of, cutoff_days: int = K.TREND_CUTOFF_DAYS,
                    mode: str = "before") -> DataFrame:
    """A4 + P8: month x sentiment counts, zero-filled, three fixed series.

    ``mode='before'`` keeps rows older than ``as_of - cutoff_days`` (the app's
    behaviour); ``mode='since'`` keeps the recent window instead.
    """
    cutoff = F.date_sub(_as_of(as_of), cutoff_days)
    cond = F.col("date") < cutoff if mode == "before" else F.col("date") >= cutoff
    return (fb.where(cond)
            .groupBy(F.date_format("date", "yyyy-MM").alias("month"))
            .pivot("sentiment", list(K.SENTIMENTS))
            .agg(F.count(F.lit(1)))
            .na.fill(0)
            .select("month",
                    F.col(K.SENTIMENT_POSITIVE).alias("trend_positive"),
                    F.col(K.SENTIMENT_NEUTRAL).alias("trend_neutral"),
                    F.col(K.SENTIMENT_NEGATIVE).alias("trend_negative"))
            .orderBy("month"))


def feedback_paged(fb: DataFrame, page: int = 1, per_page: int = K.FEEDBACK_PER_PAGE) -> DataFrame:
    """O2: one page of the table sorted by date descending, with prev/next flags.

    The page is cut with ``offset/limit`` over the global sort (planned as a
    top-k, never a full single-partition window). One extra row is fetched to
    decide ``has_next``; the window below runs over at most ``per_page+1`` rows.
    """
    page = max(int(page), 1)
    start = (page - 1) * per_page
    cut = (fb.orderBy(F.desc_nulls_last("date"), F.asc("fid"))
           .offset(start).limit(per_page + 1)
           .select("fid", "username", "date", "tsid", "nom", "feedback", "theme", "sentiment"))
    w = Window.orderBy(F.desc_nulls_last("date"), F.asc("fid"))
    return (cut.withColumn("rank_in_page", F.row_number().over(w))
            .withColumn("has_next", F.count(F.lit(1)).over(Window.partitionBy()) > per_page)
            .where(F.col("rank_in_page") <= per_page)
            .withColumn("has_prev", F.lit(start > 0))
            .withColumn("page", F.lit(page)))


def feedback_page_after(fb: DataFrame, after_date=None, after_fid=None,
                        per_page: int = K.FEEDBACK_PER_PAGE) -> DataFrame:
    """O2, keyset form: the page that follows the row (after_date, after_fid)
    in (date desc, fid asc) order. Cost does not grow with the page number,
    unlike ``offset``; pass ``None`` for the first page."""
    cur = fb
    if after_date is not None:
        d = _as_of(after_date)
        cur = fb.where((F.col("date") < d) | ((F.col("date") == d) & (F.col("fid") > F.lit(after_fid))))
    return (cur.orderBy(F.desc_nulls_last("date"), F.asc("fid")).limit(per_page)
            .select("fid", "username", "date", "tsid", "nom", "feedback", "theme", "sentiment"))


def feedback_concat(fb: DataFrame, sep: str = ";", max_per_chunk: int = 1000) -> DataFrame:
    """The ';'-joined corpus, per (place, month) and cut into chunks of at
    most ``max_per_chunk`` comments in fid order, so no row, group or task has
    to hold an unbounded text (a hot place-month becomes several chunks).
    Null texts are skipped."""
    src = (fb.where(F.col("feedback").isNotNull())
           .select("tsid", F.date_format("date", "yyyy-MM").alias("month"), "fid", "feedback"))
    ranked = rank_within_groups(src, ["tsid", "month"], [F.col("fid")], "pos")
    chunked = ranked.withColumn("chunk", F.floor((F.col("pos") - 1) / max_per_chunk).cast("long"))
    return (chunked.groupBy("tsid", "month", "chunk")
            .agg(F.expr(f"listagg(feedback, '{sep}') WITHIN GROUP (ORDER BY fid)").alias("corpus"),
                 F.count(F.lit(1)).alias("n_feedback")))


def feedback_dashboard(fb: DataFrame, as_of) -> dict[str, DataFrame]:
    """C4: the five dashboard aggregates over one (optionally cached) input."""
    return {
        "sentiment_counts": sentiment_counts(fb),
        "theme_counts": theme_counts(fb),
        "top_negative_places": top_negative_places(fb),
        "recent_negatives": recent_negatives(fb),
        "sentiment_trend": sentiment_trend(fb, as_of),
    }


def dashboard_summary(fb: DataFrame, as_of) -> DataFrame:
    """C4 as one long table (panel, label, value).

    The feedback table is read twice, not once per panel: one grouped pass
    (sentiment, theme, place, month, before-cutoff) is materialised and feeds
    the four count panels, and a pushed-down negative filter feeds the top-5
    most recent rows. (Left to the optimiser, each panel's filter is pushed
    below the shared aggregate and every panel scans the table again.)
    """
    from sentier.session import materialize
    cutoff = F.date_sub(_as_of(as_of), K.TREND_CUTOFF_DAYS)
    base = materialize(fb.groupBy("sentiment", "theme", "nom", F.date_format("date", "yyyy-MM").alias("month"),
                                  (F.col("date") < cutoff).alias("before"))
                       .agg(F.count(F.lit(1)).alias("c")), "dashboard-base")
    s = (base.where(F.col("sentiment").isNotNull()).groupBy("sentiment").agg(F.sum("c").alias("value"))
         .select(F.lit("sentiment").alias("panel"), capitalize_first(F.col("sentiment")).alias("label"), "value"))
    t = (base.where(F.col("theme").isNotNull()).groupBy("theme").agg(F.sum("c").alias("value"))
         .select(F.lit("theme").alias("panel"), F.col("theme").alias("label"), "value"))
    tn = (base.where(F.col("sentiment") == K.SENTIMENT_NEGATIVE).groupBy("nom").agg(F.sum("c").alias("value"))
          .orderBy(F.desc("value"), F.asc("nom")).limit(K.TOP_NEGATIVE_N)
          .select(F.lit("top_negative").alias("panel"), F.col("nom").alias("label"), "value"))
    rn = recent_negatives(fb).select(F.lit("recent_negative").alias("panel"),
                                     F.concat_ws(" | ", F.col("date").cast("string"), "nom", "feedback").alias("label"),
                                     F.col("fid").alias("value"))
    tr = (base.where(F.col("before"))
          .groupBy("month").pivot("sentiment", list(K.SENTIMENTS)).agg(F.sum("c")).na.fill(0))
    names = {K.SENTIMENT_POSITIVE: "positive", K.SENTIMENT_NEUTRAL: "neutral", K.SENTIMENT_NEGATIVE: "negative"}
    trend = tr.select(F.lit("trend").alias("panel"), F.explode(F.array(*[
        F.struct(F.concat(F.col("month"), F.lit(" " + names[x])).alias("label"), F.col(x).cast("long").alias("value"))
        for x in (K.SENTIMENT_POSITIVE, K.SENTIMENT_NEUTRAL, K.SENTIMENT_NEGATIVE)])).alias("p"))
    trend = trend.select("panel", "p.label", "p.value")
    return s.unionByName(t).unionByName(tn).unionByName(rn).unionByName(trend)


# ---------------------------------------------------------------- ingest
CLASSIFIED_SCHEMA = "results array<struct<verbatim:string,theme:string,sentiment:string>>"


def verbatim_explode(raw: DataFrame) -> DataFrame:
    """parse the model's JSON; if any item has an unknown theme or
    sentiment, the JSON is malformed, or the list is empty, the whole comment
    falls back to one row (verbatim = text, 'Autres', 'Neutre'). Then one row
    per item with its position."""
    parsed = F.from_json(F.col("raw"), CLASSIFIED_SCHEMA)
    themes = F.array(*[F.lit(t) for t in K.THEMES])
    sents = F.array(*[F.lit(s) for s in K.SENTIMENTS])
    res = parsed["results"]
    ok = (res.isNotNull() & (F.size(res) > 0)
          & F.forall(res, lambda r: r["verbatim"].isNotNull() & F.array_contains(themes, r["theme"])
                     & F.array_contains(sents, r["sentiment"])))
    fallback = F.array(F.struct(F.col("feedback").alias("verbatim"), F.lit(K.FALLBACK_THEME).alias("theme"),
                                F.lit(K.FALLBACK_SENTIMENT).alias("sentiment")))
    items = F.when(F.coalesce(ok, F.lit(False)), res).otherwise(fallback)
    cols = [c for c in raw.columns if c != "raw"]
    return (raw.select(*cols, F.posexplode(items).alias("pos", "it"))
            .select(*cols, "pos", "it.verbatim", "it.theme", "it.sentiment"))


def _coord_key(c: str) -> F.Column:
    return F.round(F.col(c), 7)


def resolve_tsid(rows: DataFrame, places: DataFrame, restaurants: DataFrame) -> DataFrame:
    """TSID of the place at exactly (lon, lat), else of the restaurant
    there, else 'XXXXXX'. Each catalogue is first reduced to one row per
    coordinate (first place in file order, smallest restaurant id)."""
    def by_coord(df, order, name):
        k = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
            _coord_key("longitude").alias("_lon"), _coord_key("latitude").alias("_lat"), "tsid", F.col(order).alias("_o"))
        return k.groupBy("_lon", "_lat").agg(F.min_by("tsid", "_o").alias(name))
    keyed = rows.withColumn("_lon", _coord_key("longitude")).withColumn("_lat", _coord_key("latitude"))
    out = (keyed.join(by_coord(places, "ord", "_tp"), ["_lon", "_lat"], "left")
           .join(by_coord(restaurants, "tsid", "_tr"), ["_lon", "_lat"], "left"))
    return out.withColumn("tsid", F.coalesce("_tp", "_tr", F.lit(K.UNKNOWN_TSID))).drop("_lon", "_lat", "_tp", "_tr")


def ingest_feedback(raw: DataFrame, places: DataFrame, restaurants: DataFrame, ingest_date) -> DataFrame:
    """validate/explode the classification, resolve the place, stamp the date."""
    ex = verbatim_explode(raw)
    return resolve_tsid(ex, places, restaurants).withColumn("date", _as_of(ingest_date))


FEEDBACK_TABLE_COLUMNS = ["fid", "username", "date", "tsid", "nom", "theme", "sentiment", "feedback", "verbatim"]


def to_feedback_table(df: DataFrame, source: str) -> DataFrame:
    for c in FEEDBACK_TABLE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return (df.select(*FEEDBACK_TABLE_COLUMNS)
            .withColumn("source", F.lit(source))
            .withColumn("month", F.date_format("date", "yyyy-MM")))


def append_feedback(table_path: str, batch: DataFrame, ingest_seq: int = 0) -> None:
    """Partitioned append (month); earlier files are never rewritten.
    ``ingest_seq`` (a batch number or time that grows) keeps the order of arrival."""
    (batch.withColumn("ingest_seq", F.lit(ingest_seq).cast("long"))
     .write.mode("append").partitionBy("month").parquet(table_path))


def newest_first(log: DataFrame, per_page: int = K.FEEDBACK_PER_PAGE) -> DataFrame:
    """The log as the app shows it, latest batch on top (then by comment,
    verbatim), with rank and page; numbered by range partitions."""
    order = [F.desc("ingest_seq"), F.asc("fid"), F.asc_nulls_first("verbatim")]
    ranked = global_row_number(log, order)
    return ranked.withColumn("page", page_of("rank", per_page))
