"""Ranking operators: per-group top-k and a global row number that scales.

``row_number().over(Window.orderBy(...))`` without a partition moves the whole
table into one task. ``global_row_number`` instead range-partitions on the sort
key, numbers rows inside each partition, and adds the row count of all earlier
partitions (a table with one row per partition, broadcast back).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition index << 33) + row index


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group (planned with WindowGroupLimit, so
    each task keeps at most k rows per group before the window)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def global_row_number(df: DataFrame, order_cols: list[Column], col: str = "rank",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row in the total order ``order_cols``.

    ``order_cols`` must be a total order (end with a unique key) for the
    numbering to be deterministic.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Materialised once (written to the shared folder): the per-partition sizes and the
    # rows must see the very same partitions, which two reads of one adaptive
    # shuffle do not guarantee (they may be coalesced differently).
    from sentier.session import materialize
    ranged = (materialize(df.repartitionByRange(n, *order_cols)
                          .sortWithinPartitions(*order_cols)
                          .withColumn("_mid", F.monotonically_increasing_id()), "row-numbers")
              .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS))
              .withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a window over it is bounded by the partition count
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(col, F.col("_off") + F.col("_loc") + 1)
            .drop("_mid", "_pid", "_loc", "_off"))


def page_of(rank_col: str, per_page: int) -> Column:
    return F.ceil(F.col(rank_col) / F.lit(per_page)).cast("long")


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join on ``cols`` in which NULL keys meet NULL keys."""
    b = b.withColumnsRenamed({c: f"_key_{c}" for c in cols})
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return a.join(b, on).drop(*[f"_key_{c}" for c in cols])


def rank_within_groups(df: DataFrame, group_cols: list[str], order_cols: list[Column], col: str = "pos",
                       count_col: str | None = None) -> DataFrame:
    """1-based position of each row inside its group, plus (optionally) the
    group size, without a window partitioned by the group: the global order
    (group, order) is numbered by ``global_row_number`` (range partitioning
    spreads a hot group over many tasks) and each group's first number is
    subtracted. NULL keys form a group; ``order_cols`` must be a total order.
    """
    g = global_row_number(df, [F.col(c) for c in group_cols] + list(order_cols), "_g")
    starts = g.groupBy(*group_cols).agg(F.min("_g").alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = _same(g, starts.select(*group_cols, "_s", "_n"), group_cols)
    j = j.withColumn(col, (F.col("_g") - F.col("_s") + 1).cast("long"))
    if count_col:
        j = j.withColumnRenamed("_n", count_col)
    drop = ["_g", "_s"] + ([] if count_col else ["_n"])
    return j.drop(*drop)


def running_sum_within_groups(df: DataFrame, group_cols: list[str], order_cols: list[Column], value: str,
                              out: str, exclusive: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` inside each group in ``order_cols`` order
    (``exclusive``: sum of the rows before; else including the row), without
    a window partitioned by the group.

    Rows are range-partitioned on (group, order). Each partition sums its own
    rows of a group, and a group's totals in earlier partitions (one row per
    group and partition) are its offset there, so only values of the group
    itself are ever added. A hot group simply spans several partitions. NULL
    keys form a group; ``order_cols`` must be a total order inside a group.
    """
    from sentier.session import materialize
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in group_cols] + list(order_cols)
    ranged = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id()), "running-sum")
    keys = [*group_cols, "_pid"]
    upto = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = ranged.withColumn("_loc", F.coalesce(F.sum(value).over(upto), F.lit(0.0)))
    totals = ranged.groupBy(*keys).agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*keys, F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_off"))
    return _same(local, offs, keys).withColumn(out, F.col("_off") + F.col("_loc")).drop("_pid", "_loc", "_off")
