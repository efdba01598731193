"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentier.llm import (ann_index, chat_format, decontam, fill_middle, lexical, license_scan, mixing, near_dedup,
                         quality, sharding, substring_dedup, token_counts, toxicity)
from sentier.llm.shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), said.alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return chat_format.chat_digest(chat_format.format_chats(turns.unionByName(extra)))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_classes(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(_table(spark, sf_dir, "documents"))
    return token_counts.suffix_sums(stored(token_counts.histogram(lengths), "lengths"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.graded(_table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_top", (F.col("p_top") >= quality.KEEP).alias("keep"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: /source/lang/thousands/hundreds/id.txt."""
    docs = _table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    folder = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("~"))
    path = F.concat_ws("/", F.lit(""), part("source"), part("lang"), folder(1000), folder(100),
                       F.concat(part("doc_id"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return (license_scan.scan_licenses(files, license_scan.templates(spark))
            .withColumnRenamed("file_id", "doc_id"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digest(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Tree.even(4, 2, 2)
    placed = sharding.place(_table(spark, sf_dir, "documents").select("doc_id", "text"), tree, tree.grown())
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                         F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    slim = stored(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "sizes")
    planned = mixing.plan(slim)
    return planned.select("doc_id", "size", "source_size", "target",
                          (F.col("size") * F.size("placements")).alias("taken"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.PREDICTED).cast("int").alias("predicted"), "spans")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_license_scan": op5_license_scan,
    "op6_nearest": op6_nearest,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_fill_middle": op11_fill_middle,
    "op12_toxicity": op12_toxicity,
    "op13_lexical_search": op13_lexical_search,
}
