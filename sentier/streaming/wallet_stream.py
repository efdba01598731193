"""R3 as a stream: the coin ledger with balances and waiting spends in state.

Spends are held in the state store until the watermark has passed their event time,
then released in event order, so the ledger doesn't depend on how the source is cut
into files: any disorder up to ``delay`` is put right. An event-time timer wakes a
user's state; what it releases is settled by the vector passes of the batch ledger.

A spend that arrives after the watermark has passed it is late: it can't be put
before spends already settled and is left out; ``late_spends`` gives them all, so
settled and late spends together are the rows landed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentier.streaming.common import run_available_now, session_setting

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "user_id long, event_id long, cost int, accepted boolean, balance int"


class Ledger(StatefulProcessor):
    """One user's balance, and the spends that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.balance = handle.getValueState("balance", "balance long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, cost int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        for p in rows:
            p = p[p["coins"].notna()]  # of users that the wallet table knows
            if not len(p):
                continue
            if not self.balance.exists():
                self.balance.update((int(p["coins"].iloc[0]),))
            at = p["at"].tolist()
            cost = [None if c is None or c != c else int(c) for c in p["cost"].tolist()]
            self.waiting.appendList(list(zip(at, p["event_id"].tolist(), cost)))
            self.handle.registerTimer(max(at) // 1000 + 1)  # the first whole millisecond after
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np
        import pandas as pd

        from sentier.plans.ledger import settle
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        due = sorted((r for r in rows if r[0] < passed), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
        if due:
            later = [tuple(r) for r in rows if r[0] >= passed]
            self.waiting.put(later) if later else self.waiting.clear()
            cost = np.array([r[2] or 0 for r in due], np.int64)
            start = np.array([self.balance.get()[0]], np.int64)
            accepted, left = settle(np.zeros(len(due), np.int64), cost, start)
            self.balance.update((int(left[-1]),))
            yield pd.DataFrame({"user_id": [key[0]] * len(due), "event_id": [r[1] for r in due],
                                "cost": pd.array([r[2] for r in due], "Int32"), "accepted": accepted,
                                "balance": left.astype("int32")})

    def close(self) -> None:
        pass


def wallet_stream(spark: SparkSession, source_dir: str, schema, wallet: DataFrame, sink_path: str,
                  checkpoint: str, delay: str = "8 days", files_per_trigger: int = 1) -> DataFrame:
    """Spends (event_id, user_id, cost, ts) landed under ``source_dir`` → joined with the
    wallet → held in state until the watermark, ``delay`` behind the newest spend, has
    passed them → settled in event order → idempotent per-batch append. Returns the
    ledger sink. The last spends are released by a marker (``land_marker``)."""
    spends = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
              .withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")))
    coins = wallet.select("user_id", F.coalesce("coins", F.lit(0)).cast("long").alias("coins"))
    # a left join: the marker must reach the operator, only known users have coins
    rows = spends.join(coins, "user_id", "left")
    led = rows.groupBy("user_id").transformWithStateInPandas(Ledger(), LEDGER, "Append", "EventTime")
    with session_setting(spark, PROVIDER, ROCKSDB):
        run_available_now(led, sink_path, checkpoint)
    return spark.read.schema(f"{LEDGER}, batch int").parquet(sink_path).drop("batch")


def late_spends(source: DataFrame, wallet: DataFrame, ledger: DataFrame) -> DataFrame:
    """The landed spends of known users that the ledger doesn't hold, each as often
    as it is missing."""
    known = source.join(wallet.select("user_id"), "user_id", "left_semi").select("user_id", "event_id", "cost")
    return known.exceptAll(ledger.select("user_id", "event_id", "cost"))
