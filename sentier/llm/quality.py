"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector w over hashed text features is shared by all grades; ordered
thresholds t_1 < ... < t_K cut the score s = w.x into grades 0..K:
P(grade >= k) = sigmoid(s - t_k). The expected grade is the sum of these tail
probabilities, and a tail probability selects documents.

Features of a text, each present or not: its lower-cased words (runs of ASCII
letters, digits and non-ASCII bytes), the first bytes of longer words, its runs
of ASCII signs, and how often (in powers of two) words are in capitals, words
repeat the word before, and signs stand in runs. A feature's weight is learned
as a multiple of its smoothed log ratio between the top grade and the others, so
the many rare words of a text add next to no noise; features in fewer than
``MIN_TEXTS`` labelled texts weigh nothing.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents (those whose
ids have the least hash, so any corpus gives a fixed sample): their features
come from Spark, and one task fits them. The model (2**HASH_BITS floats) is the
only thing sent to all tasks; every document is scored over its whole text.

Defined results: a null or blank text has no features and scores 0; labels with
a null id or rating are not used, several ratings of one document count as the
lowest; with no labelled document, or none below the top grade, everything has
the top grade (nothing is rejected); rows with equal or null ids are scored each
on its own; other columns pass through unless named like an output, which then
wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentier.llm import shared  # noqa: F401  (ships the kernels)
from sentier.llm.textvec import merged, mix, seed, small_batches, text_bytes, word_hashes, word_spans

HASH_BITS = 20
STEM_BYTES = 4
SAMPLE_ROWS = 20_000
MIN_TEXTS, SMOOTHING = 10, 20.0
KEEP = 0.6  # least chance of the top grade of a kept document
EPOCHS, STEP, RIDGE, BATCH = 15, 0.1, 1e-3, 256

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~_ALNUM
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index), each pair once, sorted by text index."""
    data, off = text_bytes(texts)
    low = _LOWER[data]
    start, end, first = word_spans(data, off, ~_ALNUM)
    words = word_hashes(low, start, end)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    stem = end - start > STEM_BYTES
    stems = mix(word_hashes(low, start[stem], start[stem] + STEM_BYTES) + seed(3))
    s2, e2, f2 = word_spans(data, off, ~_SIGN)
    d2 = np.repeat(np.arange(len(texts)), np.diff(f2))
    signs = mix(word_hashes(data, s2, e2) + seed(1))
    if len(start):
        capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        loud = (capitals[end] - capitals[start] == end - start) & (end - start >= 2)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    else:
        loud = again = np.zeros(0, bool)
    parts, owners = [words, stems, signs], [doc, doc[stem], d2]
    # how often: one feature for each power of two that a count reaches
    for i, (what, of) in enumerate(((loud, doc), (again, doc), (e2 - s2 >= 2, d2))):
        count = np.bincount(of[what], minlength=len(texts))
        for level in range(12):
            hit = np.flatnonzero(count >= 1 << level)
            parts.append(np.full(len(hit), seed(40 + 20 * i + level), np.uint64))
            owners.append(hit)
    h, owner = np.concatenate(parts), np.concatenate(owners)
    key = np.unique((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS)))
    return (key & np.uint64((1 << HASH_BITS) - 1)).astype(np.int32), (key >> np.uint64(HASH_BITS)).astype(np.int64)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in merged(batches, "text"):
        bucket, owner = features(b.column("text"))
        at = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("grade"), pa.ListArray.from_arrays(at, pa.array(bucket))],
            names=["doc_id", "grade", "bucket"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _log_ratios(bucket: np.ndarray, top: np.ndarray, n_top: int, n: int) -> np.ndarray:
    """Smoothed log ratio of each feature's rate in top texts to that in others."""
    size = 1 << HASH_BITS
    inside, outside = np.bincount(bucket[top], minlength=size), np.bincount(bucket[~top], minlength=size)
    share = n_top / n
    r = (np.log((inside + SMOOTHING * share) / (n_top + SMOOTHING * share))
         - np.log((outside + SMOOTHING * (1 - share)) / (n - n_top + SMOOTHING * (1 - share))))
    r[inside + outside < min(MIN_TEXTS, max(2, n // 50))] = 0.0
    return r


def fit_ordinal(bucket: np.ndarray, at: np.ndarray, grade: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by AdaGrad on the log likelihood; text i has the
    features bucket[at[i]:at[i + 1]]."""
    n, size = len(grade), 1 << HASH_BITS
    n_top = int((grade == top).sum())
    if n_top in (0, n):
        return np.zeros(size), np.full(top, -50.0 if n_top else 50.0)
    owner = np.repeat(np.arange(n), np.diff(at))
    ratio = _log_ratios(bucket, grade[owner] == top, n_top, n)
    keep = ratio[bucket] != 0
    bucket, at = bucket[keep], np.searchsorted(owner[keep], np.arange(n + 1))
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    v, gv, gc = np.full(size, 0.3), np.full(size, 1e-8), np.full(top, 1e-8)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(n), max(1, n // BATCH)):
            length = at[rows + 1] - at[rows]
            own = np.repeat(np.arange(len(rows)), length)
            cell = np.arange(length.sum()) + np.repeat(at[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
            b = bucket[cell]
            x = ratio[b]
            s = np.bincount(own, v[b] * x, len(rows))
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            low, high = _sigmoid(edge[grade[rows]] - s), _sigmoid(edge[grade[rows] + 1] - s)
            p = np.maximum(high - low, 1e-9)
            slope = high + low - 1.0  # of the log likelihood, by s
            live, place = np.unique(b, return_inverse=True)
            g = np.bincount(place, slope[own] * x) / len(rows) - RIDGE * v[live] if len(live) else np.zeros(0)
            gv[live] += g * g
            v[live] += STEP * g / np.sqrt(gv[live])
            dc = np.zeros(top + 2)
            np.add.at(dc, grade[rows] + 1, high * (1 - high) / p)
            np.add.at(dc, grade[rows], -low * (1 - low) / p)
            dc = dc[1:-1] / len(rows)
            gc += dc * dc
            cuts = np.maximum.accumulate(cuts + 0.1 * dc / np.sqrt(gc))
            cuts += 1e-6 * np.arange(top)
    return ratio * v, cuts


def _fit_task(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
            lists = t.column("bucket").combine_chunks()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            w, cuts = fit_ordinal(lists.flatten().to_numpy(), at, t.column("grade").to_numpy(), top)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([cuts.tolist()])],
                                             names=["weights", "cuts"])
    return run


class Model:
    """Weights over hashed features and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts


def fit(docs: DataFrame, ratings: DataFrame, top: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``ratings`` (doc_id, grade 0..top) of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    chosen = (ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
              .where(F.col("doc_id").isNotNull() & F.col("grade").between(0, top))
              .groupBy("doc_id").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # at most ``rows`` ids and grades: a bounded broadcast
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                           ).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    found = (labelled.mapInArrow(_feature_rows, "doc_id long, grade int, bucket array<int>")
             .dropDuplicates(["doc_id"]).repartition(1)
             .mapInArrow(_fit_task(top), "weights binary, cuts array<double>").collect())
    if not found:
        return Model(np.zeros(1 << HASH_BITS, np.float32), np.full(top, -50.0))
    return Model(np.frombuffer(bytes(found[0][0]), np.float32), np.array(found[0][1]))


def _score(weights: np.ndarray, cuts: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "_text"):
            bucket, owner = features(b.column("_text"))
            s = np.bincount(owner, weights[bucket], b.num_rows).astype(np.float64)
            tails = _sigmoid(s[:, None] - cuts[None, :])
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)]
                + [pa.array(s), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1].copy())],
                names=names)
    return run


def score(docs: DataFrame, model: Model,
          outputs: tuple[str, str, str] = ("score", "expected_grade", "p_top")) -> DataFrame:
    """``docs`` with its score, expected grade and the chance of the top grade,
    under the names in ``outputs``."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in (*outputs, "_text")]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField(c, T.DoubleType()) for c in outputs])
    return (docs.select(*[F.col(f"`{c}`") for c in own], F.col("text").cast("string").alias("_text"))
            .mapInArrow(_score(model.weights, model.cuts, schema.names), schema))


def select_top(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose chance of the top grade is at least ``least``."""
    names = ("_score", "_grade", "_p_top")
    return score(docs, model, names).where(F.col("_p_top") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 low quality, 1 sound but toxic, 2 clean."""
    q, t = F.col("quality"), F.col("toxic")
    return labels.select("doc_id", F.when(q.isNull() | t.isNull(), None).when(q == 0, 0).when(t == 1, 1)
                         .otherwise(2).alias("grade"))
