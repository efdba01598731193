"""Event calendar (C8): nested agenda records → flat rows → per-day roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentier.operators.ranking import rank_within_groups
from sentier.sources.files import flatten

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def agenda_from_events(events: DataFrame) -> DataFrame:
    """Fixture mapping: the driver's ``events`` table as nested agenda records
    (title.fr, firstTiming.begin, lastTiming.end, description.fr,
    location.address, timings[]) like the landed agenda feed."""
    begin = F.date_format("ts", ISO)
    end = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), ISO)
    later = F.date_format(F.col("ts") + F.expr("INTERVAL 2 DAYS"), ISO)
    return events.select(
        F.col("event_id").alias("uid"),
        F.struct(F.concat(F.col("event_type"), F.lit(" #"), F.col("event_id")).alias("fr")).alias("title"),
        F.struct(begin.alias("begin")).alias("firstTiming"),
        F.struct(later.alias("end")).alias("lastTiming"),
        F.struct(F.col("props").alias("fr")).alias("description"),
        F.struct(F.concat(F.lit("Rue "), F.col("user_id")).alias("address")).alias("location"),
        F.array(F.struct(begin.alias("begin"), end.alias("end")),
                F.struct(later.alias("begin"), later.alias("end"))).alias("timings"))


def calendar_rows(flat: DataFrame) -> DataFrame:
    """The five agenda fields under plain names plus the ISO day of the start."""
    return flat.select("uid", F.col("`title.fr`").alias("title"), F.col("`firstTiming.begin`").alias("start"),
                       F.col("`lastTiming.end`").alias("end"), F.col("`description.fr`").alias("description"),
                       F.col("`location.address`").alias("location"),
                       F.substring_index(F.col("`firstTiming.begin`"), "T", 1).alias("day"))


def event_calendar(agenda: DataFrame) -> DataFrame:
    """Flatten (S8) then rename."""
    return calendar_rows(flatten(agenda.drop("timings")))


def events_per_day(cal: DataFrame) -> DataFrame:
    """A5: events per start day."""
    return cal.groupBy("day").agg(F.count(F.lit(1)).alias("n_events"))


def events_by_day(cal: DataFrame) -> DataFrame:
    """The per-day grouping the calendar widget builds, as rows (day,
    day count, position in the day, event). No per-day list is collected and
    no window is partitioned by day, so a crowded day is spread over tasks."""
    ranked = rank_within_groups(cal, ["day"], [F.col("start"), F.col("uid")], "pos", "n_events")
    return ranked.select("day", "n_events", "pos", "uid", "start", "title")


def events_upcoming(agenda: DataFrame, as_of: str) -> DataFrame:
    """Events with at least one timing starting at or after ``as_of``."""
    return agenda.where(F.exists("timings", lambda t: t["begin"] >= F.lit(as_of))).select(
        "uid", F.col("title.fr").alias("title"), F.col("firstTiming.begin").alias("start"))


def event_pages(agenda: DataFrame, page_size: int = 100) -> DataFrame:
    """S7 landing shape: pages of at most ``page_size`` events with an
    ``after`` cursor (the last uid of the page)."""
    from sentier.operators.ranking import global_row_number
    ranked = global_row_number(agenda, [F.col("uid")], "_r")
    paged = ranked.withColumn("page", F.floor((F.col("_r") - 1) / page_size)).drop("_r")
    cols = [c for c in agenda.columns]
    return paged.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("events"),
                                     F.max("uid").alias("after"))
