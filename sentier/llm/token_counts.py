"""Exact token counts and what every context limit would keep.

Texts are encoded by a public byte-pair vocabulary (a file whose path is a
parameter; the driver reads it and sends it along, under a megabyte). Documents
are then aggregated by encoded length: the histogram has one row per distinct
length, however many documents there are, with partial sums before the shuffle.
Suffix sums over it (documents and tokens at or above a length) answer totals,
quantiles and totals after truncation for every context limit exactly.

Defined results: a null or empty text has 0 tokens and is counted; special
tokens inside texts are ordinary text; repeated rows count each; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentier.llm import shared  # noqa: F401  (ships the kernels)
from sentier.llm.textvec import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-splitting pattern that this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 1 << 16  # an encoder call gets about so much text


def _cuts(text: str) -> Iterator[str]:
    """``text`` in pieces that encode alone as they do together: cut before a
    single space or line feed that stands between two non-spaces."""
    at, n = 0, len(text)
    while n - at > PIECE_CHARS:
        i = at + PIECE_CHARS
        while i < n - 1 and not (text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()):
            i += 1
        if i >= n - 1:
            break
        yield text[at:i]
        at = i
    yield text[at:]


def _counter(vocabulary: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [sum(len(encode(piece)) for piece in _cuts(t)) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(n, pa.int64())],
                                             names=[*b.schema.names[:-1], "n_tokens"])
    return run


def token_lengths(docs: DataFrame, by: list[str] | None = None, vocabulary: str = VOCABULARY,
                  pattern: str = PATTERN) -> DataFrame:
    """The ``by`` columns of each document and its n_tokens."""
    small_batches(docs.sparkSession)
    by = by or []
    with open(vocabulary, "rb") as f:
        data = f.read()
    rows = docs.select(*by, F.col("text").cast("string").alias("_text"))
    schema = rows.drop("_text").withColumn("n_tokens", F.lit(0).cast("long")).schema
    return rows.mapInArrow(_counter(data, pattern), schema)


def histogram(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per length (and group): n_tokens, n_docs."""
    return lengths.groupBy(*(by or []), "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``hist`` with docs_at_least, tokens_at_least, docs_total, and
    truncated_total: all tokens left if texts are cut to n_tokens. Sums run in
    two levels, over ranges of 256 lengths and inside one range."""
    by = by or []
    h = hist.withColumn("_r", F.shiftright("n_tokens", 8)).withColumn("_t", F.col("n_docs") * F.col("n_tokens"))
    down = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by, F.lit(0))
    keys = [*by, "_r"]
    ranges = (h.groupBy(*keys).agg(F.sum("n_docs").alias("d"), F.sum("_t").alias("t"))
              .select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.coalesce(F.sum("d").over(down), F.lit(0)).alias("_d1"),
                      F.coalesce(F.sum("t").over(down), F.lit(0)).alias("_t1"),
                      F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("_all")))
    inside = Window.partitionBy(*keys).orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = h.join(ranges, on)
    at_least = F.col("_d1") + F.sum("n_docs").over(inside)
    tokens = F.col("_t1") + F.sum("_t").over(inside)
    return (out.withColumn("docs_at_least", at_least).withColumn("tokens_at_least", tokens)
            .withColumn("truncated_total", F.col("_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
            .select(*by, "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "truncated_total"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, kept_tokens) for any limits: the next longer
    length present gives the suffix beyond a limit."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.max("tokens_at_least").alias("all_tokens"))
    beyond = F.col("n_tokens") > F.col("context_limit")
    cells = asked.join(F.broadcast(total)).join(sums, beyond, "left")
    return (cells.groupBy("context_limit", "all_tokens")
            .agg(F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("docs_over"),
                 F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("_over"))
            .select("context_limit", "docs_over",
                    (F.col("all_tokens") - F.col("_over") + F.col("context_limit") * F.col("docs_over")).alias("kept_tokens")))


def quantile(sums: DataFrame, q: Column | float) -> DataFrame:
    """(n_tokens): the least length at or below which a share q of documents lies."""
    below = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")
    return sums.where(below >= F.ceil(F.col("docs_total") * q)).agg(F.min("n_tokens").alias("n_tokens"))
