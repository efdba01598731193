"""Loyalty programme (C7) and the coin ledger.

Wallet columns: user_id, coins, experience, badges (';' list).
Spend columns: event_id, user_id, cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentier import constants as K
from sentier.functions.text import split_list
from sentier.plans.ledger import ledger


def tiers_dim(spark: SparkSession) -> DataFrame:
    """The tier bands as a small dimension (one row per tier)."""
    rows = [(t, lo, hi, [(n, c) for n, c in rewards]) for t, lo, hi, rewards in K.TIERS]
    return spark.createDataFrame(rows, "tier int, min_nc int, max_nc int, rewards array<struct<name:string,cost:int>>")


def badges_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.BADGES.items()), "badge string, description string")


def _tiers_literal():
    """The tier bands as a literal array column: joining a 4-row constant
    becomes a per-row explode, no join and no shuffle."""
    return F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(lo).alias("min_nc"),
                              F.lit(hi).cast("int").alias("max_nc"), F.lit(len(r)).alias("n_rewards"))
                     for t, lo, hi, r in K.TIERS])


def user_levels(wallet: DataFrame) -> DataFrame:
    """level = experience // 1000 (floor), coins to the next level."""
    lvl = F.floor(F.col("experience") / K.LEVEL_XP).cast("int")
    return wallet.select("user_id", "coins", lvl.alias("level"),
                         ((lvl + 1) * K.LEVEL_XP - F.col("experience")).cast("int").alias("coins_for_next_level"))


def user_badges(wallet: DataFrame, badges: DataFrame) -> DataFrame:
    """F5 + J8: one row per (user, badge position) with its description, or
    the default text for unknown badges. ``badges`` is a bounded dimension."""
    ex = wallet.select("user_id", F.posexplode(split_list("badges", ";")).alias("pos", "badge"))
    return (ex.join(F.broadcast(badges), "badge", "left")
            .select("user_id", "pos", "badge", F.coalesce("description", F.lit(K.BADGE_UNKNOWN)).alias("description")))


def _band_ok(t, coins):
    return (t["min_nc"] <= coins) & (t["max_nc"].isNull() | (coins < t["max_nc"]))


def tier_access(wallet: DataFrame) -> DataFrame:
    """J15 + F24: every tier for every user with its accessibility: a user's
    band (min <= coins < max, open max) and every lower tier are accessible."""
    tiers = _tiers_literal()
    coins = F.col("coins")
    w = wallet.select("user_id", "coins", tiers.alias("_t"))
    w = w.withColumn("_hi", F.coalesce(F.array_max(F.transform(F.filter("_t", lambda t: _band_ok(t, coins)),
                                                             lambda t: t["tier"])), F.lit(0)))
    ex = w.select("user_id", "coins", "_hi", F.explode("_t").alias("t"))
    return ex.select("user_id", "coins", F.col("t.tier").alias("tier"), F.col("t.min_nc").alias("min_nc"),
                     F.coalesce(F.col("t.max_nc").cast("string"), F.lit(K.INFINITY_LABEL)).alias("max_nc"),
                     (F.col("t.tier") <= F.col("_hi")).alias("accessible"))


def tier_progress(wallet: DataFrame) -> DataFrame:
    """Highest accessible tier (0 if none), indicator position in %, and
    the coins still needed for the next tier (NULL on the last or with none)."""
    tiers = _tiers_literal()
    n = len(K.TIERS)
    coins = F.col("coins")
    w = wallet.select("user_id", "coins", tiers.alias("_t"))
    w = w.withColumn("_hi", F.coalesce(F.array_max(F.transform(F.filter("_t", lambda t: _band_ok(t, coins)),
                                                             lambda t: t["tier"])), F.lit(0)))
    # accessible tiers are exactly those <= _hi; the current index is the last one
    idx = F.size(F.filter("_t", lambda t: t["tier"] <= F.col("_hi"))) - 1
    w = w.withColumn("_idx", idx)
    step = 100.0 / (n - 1) if n > 1 else 100.0
    nxt = F.when((F.col("_idx") >= 0) & (F.col("_idx") + 1 < n), F.element_at("_t", F.col("_idx") + 2))
    return w.select("user_id", "coins",
                    F.when(F.col("_idx") >= 0, F.element_at("_t", F.col("_idx") + 1)["tier"]).otherwise(0).alias("current_tier"),
                    F.when(F.col("_idx") >= 0, F.least(F.col("_idx") * step, F.lit(100.0))).otherwise(0.0).alias("position_pct"),
                    nxt["tier"].alias("next_tier"),
                    (nxt["min_nc"] - coins).alias("coins_needed"))


def wallet_ledger(wallet: DataFrame, spends: DataFrame) -> DataFrame:
    """Every spend with its outcome and the balance after it."""
    return ledger(wallet, spends)


def wallet_balances(wallet: DataFrame, spends: DataFrame) -> DataFrame:
    """R3 summary: final balance and accepted/rejected counts per user."""
    led = wallet_ledger(wallet, spends)
    s = led.groupBy("user_id").agg(F.sum(F.when(F.col("accepted"), F.col("cost")).otherwise(0)).alias("spent"),
                                   F.count_if("accepted").alias("n_accepted"),
                                   F.count_if(~F.col("accepted")).alias("n_rejected"))
    return (wallet.select("user_id", "coins").join(s, "user_id", "left")
            .select("user_id", (F.col("coins") - F.coalesce("spent", F.lit(0))).cast("int").alias("balance"),
                    F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"),
                    F.coalesce("n_rejected", F.lit(0)).alias("n_rejected")))


def users_insert_new(existing: DataFrame, registrations: DataFrame) -> DataFrame:
    """Add registrations whose lower-cased username is not present yet
    (duplicates inside the batch kept once)."""
    new = (registrations.select(F.lower("username").alias("username"), "name")
           .groupBy("username").agg(F.min("name").alias("name"))
           .join(existing.select("username"), "username", "left_anti"))
    return existing.select("username", "name").unionByName(new)


def user_collection(wallet: DataFrame, badges: DataFrame) -> DataFrame:
    """The collection page for every user: coins, level, coins to the
    next level, badges with descriptions (in order), current tier and the
    coins still needed for the next one."""
    lv = user_levels(wallet)
    bd = (user_badges(wallet, badges)
          .groupBy("user_id")
          .agg(F.array_sort(F.collect_list(F.struct("pos", "badge", "description"))).alias("_b"))
          .select("user_id", F.array_join(F.transform("_b", lambda x: F.concat(x["badge"], F.lit(": "), x["description"])),
                                          " | ").alias("badges")))
    tp = tier_progress(wallet).select("user_id", "current_tier", "next_tier", "coins_needed")
    return (lv.join(bd, "user_id", "left").join(tp, "user_id")
            .withColumn("badges", F.coalesce("badges", F.lit(""))))
