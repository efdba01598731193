"""The ledger by halving the balance against a plain fold, batch and stream."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentier.plans import ledger as LE
from sentier.plans import loyalty as LO


def fold(balance, costs):
    out = []
    for c in costs:
        ok = c is not None and 0 < c <= balance
        balance -= c if ok else 0
        out.append((ok, balance))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5000), st.lists(st.integers(-3, 1500), max_size=40)), max_size=6))
def test_vector_passes_equal_the_fold(users):
    user = np.repeat(np.arange(len(users)), [len(c) for _, c in users])
    cost = np.array([c for _, cs in users for c in cs], np.int64)
    accepted, balance = LE.settle(user, cost, np.array([b for b, _ in users], np.int64))
    want = [x for b, cs in users for x in fold(b, cs)]
    assert list(zip(accepted.tolist(), balance.tolist())) == want


def test_largest_balances():
    cost = np.array([2**30, 2**30, 1, 2**31 - 1, 0, 1])
    accepted, balance = LE.settle(np.zeros(6, int), cost, np.array([2**31 - 1]))
    assert list(zip(accepted.tolist(), balance.tolist())) == fold(2**31 - 1, cost.tolist())


def _tables(spark):
    rng = np.random.default_rng(3)
    wallet = [(u, int(rng.integers(0, 6000))) for u in range(40)] + [(40, 2**31 - 1), (41, 0), (42, -50), (43, None)]
    spends = [(int(i), 7 if rng.random() < 0.6 else int(rng.integers(0, 46)),
               int(rng.integers(-5, 60) if rng.random() < 0.9 else rng.integers(0, 4000))) for i in range(4000)]
    spends += [(9000 + i, 40, 2**29) for i in range(6)] + [(9100, 7, None), (9101, None, 5), (9102, 3, 1), (9102, 3, 1), (9102, 3, 2)]
    w = spark.createDataFrame(wallet, "user_id long, coins int")
    s = spark.createDataFrame(spends, "event_id long, user_id long, cost int")
    want = []
    for u, b in wallet:
        mine = sorted(((e, c) for e, v, c in spends if v == u), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        want += [(u, e, c, ok, left) for (e, c), (ok, left) in zip(mine, fold(b or 0, [c for _, c in mine]))]
    return w, s, sorted(want, key=repr)


@pytest.mark.parametrize("hot,chunk", [(1 << 20, 1 << 18), (100, 64), (0, 500)])
def test_ledger_with_one_user_holding_most_spends(spark, hot, chunk):
    w, s, want = _tables(spark)
    got = sorted((tuple(r) for r in LE.ledger(w, s.repartition(6), hot, chunk).collect()), key=repr)
    assert got == want
    hottest = [r for r in got if r[0] == 7]
    assert len(hottest) > 2000 and any(r[3] for r in hottest) and not all(r[3] for r in hottest)


def test_hot_rows_are_never_grouped_by_user_alone(spark):
    """Past the chunk totals, no window or Python task takes all rows of a hot user."""
    w, s, _ = _tables(spark)
    plan = LE._hot_ledger(s.where("user_id = 7"), w.where("user_id = 7"), 64)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if x.strip(" +-:").startswith("Window")]
    assert windows and all("_chunk" in x for x in windows) and "MapInArrow" not in plan


def test_balances_and_empty_tables(spark):
    w, s, want = _tables(spark)
    spent = {}
    for u, _, c, ok, _ in want:
        spent[u] = spent.get(u, 0) + (c if ok else 0)
    got = {r.user_id: r for r in LO.wallet_balances(w, s).collect()}
    assert {u: r.balance for u, r in got.items()} == {
        r.user_id: None if r.coins is None else r.coins - spent.get(r.user_id, 0) for r in w.collect()}
    assert sum(r.n_accepted for r in got.values()) == sum(x[3] for x in want)
    assert LE.ledger(w, s.limit(0)).collect() == [] == LE.ledger(w.limit(0), s).collect()
    assert LO.wallet_balances(w, s.limit(0)).where(F.col("n_accepted") + F.col("n_rejected") > 0).count() == 0


def _spends_with_time(spark):
    w, s, want = _tables(spark)
    s = s.where("user_id IS NOT NULL").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600 + 1_700_000_000))
    return w, s, want


def _stream(spark, w, s, src, **kw):
    from sentier.session import shared_path
    from sentier.streaming import common as SC
    from sentier.streaming import wallet_stream as SWA
    SC.land_marker(spark, src, s.schema, "ts", "2100-01-01")
    return SWA.wallet_stream(spark, src, s.schema, w, shared_path(spark, "sink"), shared_path(spark, "ckpt"), **kw)


@pytest.mark.parametrize("files", [1, 8, 40])
def test_stream_equals_batch_for_any_file_layout(spark, files):
    """Rows dealt over the files by a hash: every file spans the whole time."""
    from sentier.session import shared_path
    w, s, want = _spends_with_time(spark)
    src = shared_path(spark, "src")
    s.repartition(files, F.xxhash64("event_id", "cost")).write.parquet(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = _stream(spark, w, s, src, delay="100 days", files_per_trigger=max(1, files // 4))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_settled_and_late_spends_are_all_rows(spark):
    from sentier.session import shared_path
    from sentier.streaming.wallet_stream import late_spends
    w, s, want = _spends_with_time(spark)
    src = shared_path(spark, "src")
    old, new = s.where("event_id % 9 = 0 AND event_id < 3000"), s.where("NOT (event_id % 9 = 0 AND event_id < 3000)")
    new.coalesce(1).write.parquet(src)
    s.where("event_id = 9102").limit(0).write.mode("append").parquet(src)
    old.coalesce(1).write.mode("append").parquet(src)  # weeks after the newest one
    out = _stream(spark, w, s, src, delay="1 hour")
    late = late_spends(s, w, out)
    assert out.count() + late.count() == len(want) and late.count() > 300
    by_time = sorted((tuple(r) for r in LE.ledger(w, new).collect()), key=repr)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == by_time
