"""Substring dedup by relative parsing against indexed reference blocks.

Every document is factored greedily, left to right, against the corpus of
documents with smaller ids: a factor is the longest run of words all of whose
``window``-word windows stand in that reference, so factors shorter than a
window are literals. Windows that straddle two factors are looked up like all
others, so a factor boundary hides no match. Factors become duplicate spans.

The reference index is split into blocks by hash, one per shuffle partition,
and built in two steps that each move every key once:

1. *Seeds.* A window is represented by the seed of ``seed_words`` words with the
   smallest hash in it (equal windows have equal seeds, about one seed per five
   words). Blocks of seeds tell which seeds more than one document holds; a
   window whose seed is held once can't repeat and is dropped here.
2. *Windows.* For the rest, blocks keyed by seed and 64-bit window hash give the
   smallest document id that holds the window.

Keys repeated inside a task's chunk of documents are settled in that chunk and
send a single row on, so a passage that a third of all documents share costs a
block one row per chunk, not one per document.

Defined results: a null or blank text has no words; a null ``doc_id`` neither
removes nor loses anything; rows with equal ids are judged each on its own text
and never against one another; texts shorter than a window are kept whole;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentier.llm import shared  # noqa: F401  (ships the kernels)
from sentier.llm.textvec import (as_long, gram_hashes, merged, mix, small_batches, text_bytes, whole_windows,
                                 word_hashes, word_spans)

CHUNK = 2 << 20  # bytes of text whose repeats are settled at once
_SEEDS = "part long, key long, doc_id long"
_KEYS = "part long, known boolean, doc_id long, checks array<long>"
_SPANS = T.StructType([
    T.StructField("row", T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])),
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                     T.StructField("length", T.LongType())]))),
])


def _seed_of_window(words: np.ndarray, at: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each window start in ``at``: the smallest hash of its k-word seeds."""
    g = gram_hashes(words, k, salt=1)
    low, width, need = g, 1, window - k + 1
    while width * 2 <= need:  # sliding minimum by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = need - width
    return np.minimum(low[at], low[at + rest]) if len(at) else np.zeros(0, np.uint64)


def _windows(batch: pa.RecordBatch, window: int, k: int):
    """(doc of window, seed, key, check, first window of each doc, n_words)"""
    data, off = text_bytes(batch.column("text"))
    start, end, first = word_spans(data, off)
    w = word_hashes(data, start, end)
    at = whole_windows(first, window)
    seeds = _seed_of_window(w, at, window, k)
    doc = np.searchsorted(first, at, side="right") - 1
    return data, start, end, first, w, at, seeds, doc


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("doc_id")
    return col.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(col.is_valid())


def _pairs(key: np.ndarray, check: np.ndarray, ids: np.ndarray):
    """The distinct (key, check, id) of a chunk in that order, whether a row is
    its (key, check)'s first, and whether several ids hold its (key, check)."""
    order = np.lexsort((ids, check, key))
    key, check, ids = key[order], check[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    row = new.copy()
    row[1:] |= ids[1:] != ids[:-1]
    key, check, ids, new = key[row], check[row], ids[row], new[row]
    group = np.cumsum(new) - 1
    return key, check, ids, new, np.bincount(group)[group] > 1 if len(group) else new


def _own(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A key that spreads the rows of one block key over all blocks."""
    return mix(key ^ mix(ids.view(np.uint64) + np.uint64(7)))


def _seed_rows(window: int, k: int):
    """Seeds of a chunk. One that a single document of the chunk holds is asked
    of its block (key null). One that several hold is known to be shared: each
    holder's row goes its own way, and one row without a document tells the
    block about them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "text", CHUNK):
            ids, ok = _ids(b)
            _, _, _, _, _, _, seeds, doc = _windows(b, window, k)
            new = np.ones(len(seeds), bool)
            new[1:] = (seeds[1:] != seeds[:-1]) | (doc[1:] != doc[:-1])
            new &= ok[doc]
            key = seeds[new]
            key, _, ids, head, many = _pairs(key, np.zeros(len(key), np.int8), ids[doc[new]])
            head &= many
            none = np.ones(int(head.sum()), bool)
            for part, name, holder in (
                    (np.where(many, _own(key, ids), key), pa.array(as_long(key), mask=~many), pa.array(ids)),
                    (key[head], pa.nulls(len(none), pa.int64()), pa.array(ids[head], mask=none))):
                yield pa.RecordBatch.from_arrays([pa.array(as_long(part)), name, holder],
                                                 names=["part", "key", "doc_id"])
    return run


def _window_rows(window: int, k: int):
    """Windows of a chunk as one row per seed and document. A window's smallest
    holder in the chunk is an open question for the seed's block; the others
    are known to repeat it and go their own way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "text", CHUNK):
            b = b.filter(b.column("keys").is_valid())
            if not b.num_rows:
                continue
            ids, ok = _ids(b)
            _, _, _, _, w, at, seeds, doc = _windows(b, window, k)
            hit = _listed(b.column("keys"), seeds, doc)
            hit &= ok[doc]
            key, check, ids, first, _ = _pairs(seeds[hit], _window_keys(w, at[hit], window), ids[doc[hit]])
            order = np.lexsort((ids, key, first))
            key, check, ids, known = key[order], check[order], ids[order], ~first[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
            head = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(key)), pa.int32()), pa.array(as_long(check)))
            key, ids, known = key[head], ids[head], known[head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(np.where(known, _own(key, ids), key))), pa.array(known), pa.array(ids), lists],
                names=["part", "known", "doc_id", "checks"])
    return run


def _window_keys(w: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    return gram_hashes(w, window, salt=2)[at] if len(at) else np.zeros(0, np.uint64)


def _listed(lists: pa.Array, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each value stands in the list of its document's row."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    salt = lambda v, d: mix(v + mix(d.astype(np.uint64) + np.uint64(1)))
    return np.isin(salt(values, doc), salt(flat, owner))


def _spans(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "text", CHUNK):
            _, _, _, first, w, at, seeds, doc = _windows(b, window, k)
            lists = b.column("keys")
            some = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0
            live = some[doc]
            at, doc = at[live], doc[live]
            hit = _listed(lists, _window_keys(w, at, window), doc)
            at, doc = at[hit], doc[hit]
            # greedy factors: a run of matched windows at consecutive words is
            # one factor; a factor that begins inside the last one extends it
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] >= at[:-1] + window) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(at))[:len(head)] - 1
            begin = at[head] - first[doc[head]]
            length = at[last] + window - at[head]
            offsets = np.searchsorted(doc[head], np.arange(b.num_rows + 1), side="left")
            spans = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(length, pa.int64())],
                                           names=["start", "length"]))
            yield pa.RecordBatch.from_arrays(
                [pa.StructArray.from_arrays([b.column("doc_id"), b.column("text").cast(pa.string())],
                                            names=["doc_id", "text"]),
                 pa.array(np.diff(first), pa.int64()), spans], names=["row", "n_words", "spans"])
    return run


def duplicate_spans(docs: DataFrame, window: int = 13, seed_words: int = 3) -> DataFrame:
    """(row struct<doc_id, text>, n_words, spans array<struct<start, length>>):
    for each row the word spans covered by a ``window`` that also starts in a
    document with a smaller id, left to right, disjoint."""
    return _parse(docs, window, seed_words, _spans(window, seed_words), _SPANS)


def kept_digest(docs: DataFrame, window: int = 13, seed_words: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what ``duplicate_spans`` leave,
    taken in the same task that finds them."""
    spans = _spans(window, seed_words)
    return _parse(docs, window, seed_words, lambda batches: _digest(spans(batches)),
                  "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _parse(docs: DataFrame, window: int, seed_words: int, kernel, schema) -> DataFrame:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seeds = texts.mapInArrow(_seed_rows(window, seed_words), _SEEDS).repartition("part")
    block = Window.partitionBy("part")
    shared_seeds = _lists(seeds.withColumn("_n", F.count(F.lit(1)).over(block))
                          .where((F.col("key").isNotNull() | (F.col("_n") > 1)) & F.col("doc_id").isNotNull())
                          .select("doc_id", F.coalesce("key", "part").alias("key")))
    # Left joins on both sides: the same exchange of the texts serves twice.
    by_doc = texts.repartition("doc_id")
    windows = (by_doc.join(shared_seeds.hint("shuffle_hash"), "doc_id", "left")
               .mapInArrow(_window_rows(window, seed_words), _KEYS).repartition("part")
               .select("part", "known", "doc_id", F.explode("checks").alias("key")))
    block = Window.partitionBy("part", "key")
    repeats = _lists(windows.withColumn("_low", F.min("doc_id").over(block))
                     .where(F.col("known") | (F.col("doc_id") > F.col("_low"))).select("doc_id", "key"))
    return (by_doc.join(repeats.hint("shuffle_hash"), "doc_id", "left")
            .mapInArrow(kernel, schema))


def _lists(keys: DataFrame) -> DataFrame:
    """The keys of each document, at most one per word of it."""
    return keys.repartition("doc_id").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row = b.column("row")
        removed, digest = [], []
        spans = b.column("spans").to_pylist()
        for text, cut in zip(row.field("text").to_pylist(), spans, strict=True):
            words = (text or "").encode().split()
            kept, at, gone = [], 0, 0
            for s in cut:
                kept += words[at:s["start"]]
                at = s["start"] + s["length"]
                gone += s["length"]
            kept += words[at:]
            removed.append(gone)
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [row.field("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])
