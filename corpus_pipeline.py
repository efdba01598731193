"""The corpus pipeline: documents in, a sharded training mix out.

Each stage calls one operator of ``sentier.llm`` on all that the stage before
kept, is written as Parquet in the shared folder and read again. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentier.llm import decontam, mixing, near_dedup, quality, sharding
from sentier.llm.shared import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are unlikely to be of the top grade."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select("doc_id", "text"), quality.graded(labels))
    return quality.select_top(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return near_dedup.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks."""
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source",
                       mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(mixing.plan(slim)).select("_row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row in a shard, with a slot."""
    return sharding.place(docs, sharding.Tree.even(4, 2, 2)).drop("grown_shard")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing_sources),
    ("sharding", shards),
]

# A trained classifier and hashed similarity search have no SQL twin; the tests
# hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
