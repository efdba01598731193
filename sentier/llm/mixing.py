"""Mixing sources to target weights over a multivariate-hypergeometric tree.

*Targets.* Sources in code point order (null last) weigh ``weights`` in turn and
share ``share`` of all sizes by weight. A target stops at ``most`` times its
source's size and the excess is shared again by weight among the others, until
none is above.

*Blocks.* A source's documents stand in hash order, one long permuted run that is
cut into ``BLOCKS`` blocks of equal size. The source's quota is its target in
blocks: whole passes over all blocks and, for the rest, the first blocks of the
permutation. A document belongs to the block that its first word falls into, so
any run of blocks holds its words up to one document.

*Splitting tree.* All drawn blocks are the root. Each node deals its blocks out
to two children of exact sizes by a hash permutation, which is a draw from the
multivariate hypergeometric distribution over sources; the leaves are the
output shards. Draws are disjoint, and each shard is shuffled by hash on its own.

All of it is DataFrame functions. Orders use hash ranges (``hashorder``), so a
source that holds a third of all rows is spread over as many tasks as it needs;
block and quota tables have at most ``most`` * BLOCKS rows a source.

Defined results: a null or blank text has size 0 and is never counted as words
taken; sources of size 0 have target 0; null ids are ids of their own; repeated
rows are dealt with one by one; a total of 0 takes nothing; other columns pass
through unless named like an output, which then wins; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentier.llm.hashorder import hex_hash, sum_before
from sentier.llm.shared import stored

BLOCKS = 256
WEIGHTS = (5, 2, 1)
MOST = 3
SHARDS = 16
OUTPUTS = ("size", "source_size", "target", "placements", "_key", "_h", "_start", "_block", "_quota", "_copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Non-null, in code point order, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source.cast("string")))


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST, share: float = 1.0) -> DataFrame:
    """(_key, source_size, target) from rows of (_key, size)."""
    by_source = stored(sizes.groupBy("_key").agg(F.sum("size").alias("source_size")), "sources")
    # ranks in code point order: per first letters, then within them
    head = F.substring("_key", 1, 4)
    part = by_source.withColumn("_head", head)
    ahead = (part.groupBy("_head").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("_ahead", F.sum("n").over(Window.orderBy("_head")) - F.col("n")).drop("n"))
    ranked = (part.join(ahead, "_head")
              .withColumn("_rank", F.col("_ahead") + F.row_number().over(Window.partitionBy("_head").orderBy("_key")) - 1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("_key", "source_size", w.alias("w"), (F.col("source_size") * float(most)).alias("top")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = None, -1
    while True:  # each pass caps at least one more source, or is the last
        over = F.lit(False) if rate is None else F.col("top") < F.col("w") * F.lit(rate)
        kept = ranked.agg(F.sum(F.when(over, F.col("top")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w"))),
                          F.sum(F.when(over, 1).otherwise(0))).first()
        if not kept[1] or kept[2] == capped:
            break
        capped, rate = kept[2], (share * total - kept[0]) / kept[1]
    return ranked.select("_key", "source_size", F.least("top", F.col("w") * F.lit(float(rate or 0.0))).alias("target"))


def quotas(goals: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``goals`` with _quota: the target in blocks."""
    q = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0)
    return goals.withColumn("_quota", q.cast("long"))


def split(goals: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(_key, _block, _copy, shard): every drawn block in its output shard."""
    copies = F.floor(F.col("_quota") / blocks) + F.when(F.col("_block") < F.col("_quota") % blocks, 1).otherwise(0)
    drawn = (goals.select("_key", "_quota", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
             .withColumn("_copies", copies.cast("int")).where("_copies > 0")
             .select("_key", "_block", F.explode(F.expr("sequence(1, _copies)")).alias("_copy")))
    drawn = stored(drawn.withColumn("node", F.lit("")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards)), "drawn")
    while True:
        wide = drawn.where("hi - lo > 1")
        if wide.isEmpty():
            break
        sizes = drawn.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        h = hex_hash(F.lit("split"), F.col("node"), F.col("_key"), F.col("_block"), F.col("_copy"))
        ranked = sum_before(drawn.withColumn("_h", h), ["node"], [F.col("_key"), F.col("_block"), F.col("_copy")],
                            "_h", F.lit(1), "_pos").join(sizes, "node")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.floor(F.col("n") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        go_left, whole = F.col("_pos") < left, F.col("hi") - F.col("lo") <= 1
        drawn = stored(ranked.select(
            "_key", "_block", "_copy",
            F.when(whole, F.col("node")).otherwise(F.concat("node", F.when(go_left, F.lit("l")).otherwise(F.lit("r")))).alias("node"),
            F.when(whole | go_left, F.col("lo")).otherwise(mid).alias("lo"),
            F.when(whole | ~go_left, F.col("hi")).otherwise(mid).alias("hi")), "drawn")
    return drawn.select("_key", "_block", "_copy", F.col("lo").alias("shard"))


def plan(docs: DataFrame, weights=WEIGHTS, most: float = MOST, share: float = 1.0, shards: int = SHARDS,
         blocks: int = BLOCKS) -> DataFrame:
    """``docs`` (doc_id, source, text or size, ...) with size, source_size,
    target and placements array<struct<shard, copy>>, one per time it is taken."""
    size = F.coalesce(F.col("size").cast("long"), F.lit(0)) if "text" not in docs.columns else n_words(F.col("text"))
    clean = docs.drop(*[c for c in OUTPUTS if c != "size"])
    rows = (clean.withColumn("size", size).withColumn("_key", source_key(F.col("source")))
            .withColumn("_h", hex_hash(F.lit("mix"), F.col("doc_id"))))
    goals = stored(quotas(targets(rows.select("_key", "size"), weights, most, share), blocks), "goals")
    drawn = split(goals, shards, blocks)
    spots = drawn.groupBy("_key", "_block").agg(
        F.sort_array(F.collect_list(F.struct("shard", F.col("_copy").alias("copy")))).alias("placements"))
    order = [F.col("doc_id"), F.col("size")] + ([F.md5(F.col("text").cast("string"))] if "text" in docs.columns else [])
    placed = sum_before(rows, ["_key"], order, "_h", F.col("size"), "_start")
    block = F.least(F.floor(F.col("_start") * blocks / F.greatest(F.col("source_size"), F.lit(1))), F.lit(blocks - 1))
    none = F.expr("CAST(array() AS array<struct<shard: int, copy: int>>)")
    return (placed.join(goals.drop("_quota"), "_key").withColumn("_block", block.cast("int"))
            .join(spots, ["_key", "_block"], "left")
            .withColumn("placements", F.coalesce("placements", none))
            .drop("_key", "_h", "_start", "_block"))


def mix(planned: DataFrame) -> DataFrame:
    """One row per time a document is taken: the planned columns, shard and
    shuffle (the order within the shard, by hash)."""
    out = planned.drop("shard", "shuffle").withColumn("_p", F.explode("placements"))
    return (out.withColumn("shard", F.col("_p.shard"))
            .withColumn("shuffle", hex_hash(F.lit("shuffle"), F.col("shard"), F.col("_p.copy"), F.col("doc_id")))
            .drop("placements", "_p"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder per shard, each shuffled on its own in hash order."""
    (mixed.repartitionByRange(F.col("shard"), F.col("shuffle")).sortWithinPartitions("shard", "shuffle")
     .write.partitionBy("shard").parquet(path))
