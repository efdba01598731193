"""Ranks and running sums in hash order, for groups of any size.

The order inside a group is that of an md5 of the row, so a group's rows fall
into 16**DIGITS ranges of nearly equal size. Range totals (map-side combined,
one row per group and range) give every range its offset; the rows of one range
are then ordered by themselves. No task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentier.llm.shared import free_names

DIGITS = 3


def hex_hash(*parts: Column) -> Column:
    """md5 of the parts as text, joined by '|'; a null part counts as '~'."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))


def unit(h: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of a hash."""
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)


def sum_before(df: DataFrame, group: list[str], order: list[Column], hash_col: str, value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (long) over the rows of the same
    group that come before it by (hash_col, order). Group columns are non-null.
    With value 1 this is a gapless rank from 0. ``df`` is read twice."""
    part, v, total, start = free_names(df, "_range", "_v", "_t", "_before")
    df = df.withColumn(part, F.substring(F.col(hash_col), 1, DIGITS)).withColumn(v, value.cast("long"))
    totals = df.groupBy(*group, part).agg(F.sum(v).alias(total))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, part, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    inside = (Window.partitionBy(*group, part).orderBy(F.col(hash_col), *order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (df.join(totals, [*group, part])
            .withColumn(out, F.col(start) + F.coalesce(F.sum(v).over(inside), F.lit(0)))
            .drop(part, v, start))
