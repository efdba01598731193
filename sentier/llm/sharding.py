"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards; a node weighs the sum of its shards. A row
descends level by level: at each node every child draws -ln(u) / weight, u a
hash of (row key, child), and the least draw wins. A draw depends on the child
and its weight alone, so a change of weights moves rows only into subtrees that
gained weight and out of subtrees that lost it. ``Tree.grown`` adds a shard as a
region of its own: no other subtree changes weight, so rows move only into the
new shard.

Hashing deals out rows one by one; a hot source or group of copies is spread
like any other rows. Slots come from hash ranges (see ``hashorder``), so no task
numbers a whole shard.

Defined results: the row key is ``doc_id``; rows with equal ids (or null ids,
which count as one key) go to one shard and get slots of their own; a null text
has size 1; other columns pass through unless named like an output, which then
wins; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentier.llm.hashorder import hex_hash, sum_before, unit
from sentier.llm.shared import free_names

SEED = "shard"


@dataclass(frozen=True)
class Tree:
    """(region, rack, shard number, weight) per shard."""

    shards: tuple[tuple[str, str, int, float], ...]

    @staticmethod
    def even(regions: int = 4, racks: int = 2, shards: int = 2) -> "Tree":
        out = []
        for i in range(regions * racks * shards):
            region, rack = i // (racks * shards), i // shards
            out.append((f"r{region}", f"k{rack}", i, 1.0))
        return Tree(tuple(out))

    def grown(self, weight: float = 1.0) -> "Tree":
        n = max((s[2] for s in self.shards), default=-1) + 1
        return Tree((*self.shards, (f"r+{n}", f"k+{n}", n, weight)))

    def reweighted(self, shard: int, weight: float) -> "Tree":
        return Tree(tuple((r, k, s, weight if s == shard else w) for r, k, s, w in self.shards))


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number that ``key`` descends to."""
    below: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in tree.shards:
        for parent, child in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", f"s{shard}")):
            kids = below.setdefault(parent, {})
            kids[child] = kids.get(child, 0.0) + weight
    entries = []
    for parent, kids in below.items():
        live = [F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in kids.items() if w > 0]
        if live:
            entries += [F.lit(parent), F.array(*live)]
    children, node = F.create_map(*entries), F.lit("")
    for _ in range(3):
        draws = F.transform(F.element_at(children, node), lambda c: F.struct(
            (-F.log(unit(hex_hash(F.lit(SEED), c["name"], key))) / c["weight"]).alias("draw"), c["name"].alias("name")))
        node = F.array_min(draws)["name"]
    return F.substring(node, 2, 20).cast("int")


def place(docs: DataFrame, tree: Tree, bigger: Tree | None = None) -> DataFrame:
    """``docs`` with size, shard, slot (gapless from 0 in each shard) and, if
    ``bigger`` is given, grown_shard."""
    key = F.col("doc_id")
    out = docs.drop("size", "shard", "slot", "grown_shard")
    h, = free_names(out, "_h")
    out = (out.withColumn("size", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1)
           .withColumn("shard", shard_of(key, tree).cast("int"))
           .withColumn("grown_shard", (shard_of(key, bigger) if bigger else F.lit(None)).cast("int"))
           .withColumn(h, hex_hash(F.lit("slot"), key, F.md5(F.col("text").cast("string")))))
    plain = [F.col(f"`{c}`") for c, t in out.dtypes if c not in ("shard", "grown_shard", h) and "map<" not in t]
    return sum_before(out, ["shard"], [F.xxhash64(*plain)], h, F.lit(1), "slot").drop(h)
