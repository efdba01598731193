"""The coin ledger by halving the balance.

A spend is accepted when its cost is positive and the balance covers it; a rejected
spend changes nothing. That rule looks sequential, but with a balance b and the
largest power of two h below it,

- every cost up to h is accepted as long as the balance stays above h, which an
  integer running sum of those costs tells;
- a larger cost is accepted only where it fits, and takes the balance below h.

So one running sum settles all spends up to the first that takes the balance to h
or below, and the next pass starts with at most half the balance: 32 passes settle
any 32-bit balance, each a sum that can be cut anywhere.

Users' spends are dealt by user and settled by vector passes over whole sorted
batches, the balance carried from batch to batch. A user with more than
``hot_rows`` spends is not given to one task: those rows are range-partitioned by
(user, event) into chunks of ``chunk_rows``, and the same passes run as Spark jobs
over all chunks of all such users (chunk totals, their offsets, and the least row
that ends the pass).

Defined results: spends of unknown users (and null ones) are left out; null coins
count as 0, null costs are rejected; spends with one event id are taken by
ascending cost, nulls first; repeated rows are spends of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentier.operators.geojoin import fits_broadcast
from sentier.operators.ranking import global_row_number
from sentier.session import materialize

HOT_ROWS, CHUNK_ROWS = 1 << 20, 1 << 18
PASSES = 33


def settle(user: np.ndarray, cost: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, balance after) of each spend. ``user`` holds the ascending number
    of each row's user, ``start`` the balance of each user before its first row."""
    accepted = np.zeros(len(cost), bool)
    balance = start.astype(np.int64)
    live = np.flatnonzero((cost > 0) & (cost <= balance[user]))
    while len(live):
        u, c = user[live], cost[live]
        b = balance[u]
        half = np.left_shift(1, np.frexp((b - 1).astype(np.float64))[1].astype(np.int64)) >> 1
        small = c <= half
        spent = _sums(u, np.where(small, c, 0))
        fits = ~small & (c <= b - spent)
        row = np.arange(len(live))
        end = np.full(len(balance), len(live))
        at = np.flatnonzero(fits | (small & (spent >= b - half)))
        who, first = np.unique(u[at], return_index=True)
        end[who] = at[first]
        take = (small & (row <= end[u])) | (fits & (row == end[u]))
        accepted[live[take]] = True
        np.subtract.at(balance, u[take], c[take])
        live = live[(row > end[u]) & (c <= balance[u])]
    return accepted, start[user] - _sums(user, np.where(accepted, cost, 0))


def _sums(user: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Running sums within each user's rows."""
    total = np.cumsum(value)
    if not len(total):
        return total
    first = np.flatnonzero(np.r_[True, user[1:] != user[:-1]])
    return total - np.repeat((total - value)[first], np.diff(np.append(first, len(user))))


def _settle_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (user, event, cost); the last user's balance is carried on."""
    last, left = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("user_id").to_numpy(zero_copy_only=False)
        new = np.r_[ids[0] != last, ids[1:] != ids[:-1]]
        user = np.cumsum(new) - new[0]
        start = np.zeros(user[-1] + 1, np.int64)
        first = np.flatnonzero(np.r_[True, new[1:]])
        start[:] = b.column("coins").to_numpy(zero_copy_only=False)[first]
        if not new[0]:
            start[0] = left
        cost = b.column("cost").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        accepted, balance = settle(user, cost, start)
        last, left = ids[-1], balance[-1]
        yield pa.RecordBatch.from_arrays(
            [b.column("user_id"), b.column("event_id"), b.column("cost"), pa.array(accepted),
             pa.array(balance.astype(np.int32))], names=["user_id", "event_id", "cost", "accepted", "balance"])


def ledger(wallet: DataFrame, spends: DataFrame, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(user_id, event_id, cost, accepted, balance): every spend with its outcome."""
    coins = wallet.select("user_id", F.coalesce("coins", F.lit(0)).cast("int").alias("coins"))
    spends = spends.select("event_id", "user_id", F.col("cost").cast("int").alias("cost"))
    some = spends.count() > hot_rows  # else no user can have more
    if some:
        hot = materialize(spends.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
                          .select("user_id"), "hot-users")
        some = not hot.isEmpty()
    cold = spends.join(hot, "user_id", "left_anti") if some else spends
    schema = (f"user_id {dict(wallet.dtypes)['user_id']}, event_id {dict(spends.dtypes)['event_id']}, cost int, "
              "accepted boolean, balance int")
    ordered = cold.join(coins, "user_id").repartition("user_id").sortWithinPartitions("user_id", "event_id", "cost")
    out = ordered.mapInArrow(_settle_sorted, schema)
    if not some:
        return out
    return out.unionByName(_hot_ledger(spends.join(_small(hot), "user_id", "left_semi"),
                                       coins.join(_small(hot), "user_id", "left_semi"), chunk_rows))


def _small(users: DataFrame) -> DataFrame:
    """Hot users are at most rows / hot_rows; broadcast behind a check of the size."""
    return F.broadcast(users) if fits_broadcast(users) else users


def _half(balance: Column) -> Column:
    """The largest power of two below the balance (0 below 1)."""
    digits = F.length(F.bin(balance - 1))
    return F.when(balance <= 1, F.lit(0)).otherwise(F.pow(F.lit(2.0), digits - 1)).cast("long")


def _sum_upto(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` over (user_id, _seq), this row included:
    inside a chunk by a window, before it by the totals of the user's chunks."""
    rows = rows.withColumn("_v", value.cast("long"))
    totals = rows.groupBy("user_id", "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy("user_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select("user_id", "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("user_id", "_chunk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(offset, ["user_id", "_chunk"])
            .withColumn(out, F.col("_off") + F.sum("_v").over(inside)).drop("_v", "_off"))


def _hot_ledger(spends: DataFrame, coins: DataFrame, chunk_rows: int) -> DataFrame:
    order = [F.col(c) for c in ("user_id", "event_id", "cost")]
    rows = global_row_number(spends, order, "_seq")
    rows = materialize(rows.withColumn("_chunk", F.floor(F.col("_seq") / chunk_rows)), "hot-spends")
    state = materialize(coins.select("user_id", F.col("coins").cast("long").alias("bal"), F.lit(0).cast("long").alias("after"))
                        .where("bal > 0"), "hot-state")
    phases = None
    for _ in range(PASSES):
        if state.isEmpty():
            break
        live = rows.join(_small(state), "user_id").where("_seq > after AND cost > 0 AND cost <= bal")
        live = live.withColumn("half", _half(F.col("bal")))
        small = F.col("cost") <= F.col("half")
        live = _sum_upto(live, F.when(small, F.col("cost")).otherwise(0), "spent")
        left = F.col("bal") - F.col("spent")
        ends = F.when(small, left <= F.col("half")).otherwise(F.col("cost") <= left)
        left = left - F.when(small, F.lit(0)).otherwise(F.col("cost"))
        end = (live.where(ends).groupBy("user_id")
               .agg(F.min(F.struct(F.col("_seq").alias("upto"), left.alias("left"))).alias("e")))
        done = materialize(state.join(end, "user_id", "left")
                           .select("user_id", "bal", "after", "e.upto", "e.left"), "hot-phase")
        phases = done if phases is None else phases.unionByName(done)
        state = done.where("left > 0").select("user_id", F.col("left").alias("bal"), F.col("upto").alias("after"))
    if phases is None:
        flagged = rows.withColumn("accepted", F.lit(False))
    else:
        # at most PASSES phases a user, in one value
        per_user = materialize(phases.withColumn("half", _half(F.col("bal"))).groupBy("user_id")
                               .agg(F.collect_list(F.struct("after", "upto", "half", "bal")).alias("phases")), "hot-phases")
        mine = F.filter("phases", lambda p: (F.col("_seq") > p["after"])
                        & (p["upto"].isNull() | (F.col("_seq") <= p["upto"])))
        flagged = rows.join(_small(per_user), "user_id", "left").withColumn("p", F.get(mine, F.lit(0)))
        fits = (F.col("cost") <= F.col("p.half")) | (F.col("_seq") == F.col("p.upto"))
        flagged = flagged.withColumn("accepted", F.coalesce((F.col("cost") > 0) & fits, F.lit(False))).drop("p", "phases")
    spent = _sum_upto(flagged, F.when(F.col("accepted"), F.col("cost")).otherwise(0), "spent")
    return (spent.join(_small(coins), "user_id")
            .select("user_id", "event_id", "cost", "accepted", (F.col("coins") - F.col("spent")).cast("int").alias("balance")))
