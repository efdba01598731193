"""Ranked lexical search: every item's best documents, exactly.

*Statistics and index.* One scan of the texts keeps, for blocks of documents, the
posting lists (document, occurrences) of the terms that items ask for. Blocks are
rows of a staged table; document counts, lengths and document frequencies are
sums over it.

*Hybrid evaluation.* A task walks its blocks with the best ``k`` found so far for
each item. In a block, an item's short lists are summed into accumulators term at
a time. The accumulators are then one more iterator, bounded by their greatest
sum, beside the long lists. Iterators are ordered by bound; those whose bounds
together stay below the k-th best score can't lift a document by themselves, so
candidates come from the others only. Candidates are completed document at a time
from the remaining lists, greatest bound first: a list is entered by binary search
at the candidates alone, and a candidate leaves as soon as its score and the
bounds left stay below the k-th best.

*Floors.* One block in ``SEED_ONE_IN`` is evaluated first; an item's k-th best
score there is a lower bound of its final one, so the full run starts with it and
tasks return few rows beyond the final ones. Nothing is lost: documents at the
floor itself are kept.

Items are a stated query set and are taken in groups of about ``GROUP_CELLS``
(item, term) pairs; only a group's terms, weights and floors are sent to tasks.
Terms go by 64-bit hashes (the chance that any of 10**9 other words meets one of
10**5 terms is below 10**-5).

Defined results: null and empty texts hold no terms and are never found; items
without terms, or whose terms no document holds, give no rows; the texts of rows
with one item id (null ids too) are one item; repeated documents are ranked each,
equal scores by ascending id, null ids last; other columns are ignored; an empty
table gives no rows. Products stay within 64 bits up to 10**11 documents of 10**6
terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentier.llm.shared import stored
from sentier.llm.textvec import merged, small_batches, text_bytes, word_hashes, word_spans
from sentier.session import shared_path

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
GROUP_CELLS = 1 << 17
BLOCK_POSTINGS = 1 << 18
SHORT = 64  # a list is short if it holds at most one in SHORT of a block's documents
SEED_ONE_IN = 16

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_INDEX = ("docs long, terms long, doc_id array<long>, n array<long>, term array<int>, df array<int>, "
          "pos array<int>, tf array<int>")


# -- index -------------------------------------------------------------------

def _indexer(listed: np.ndarray):
    """Blocks of posting lists of the terms whose sorted hashes are ``listed``."""
    near = np.zeros(1 << 20, bool)
    near[(listed >> np.uint64(44)).astype(np.int64)] = True

    def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text; text, term and occurrences of each cell)"""
        data, off = text_bytes(texts)
        low = _LOWER[data]
        start, end, first = word_spans(low, off, ~_TERM)
        h = word_hashes(low, start, end)
        maybe = np.flatnonzero(near[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(listed, h[maybe]), len(listed) - 1)
        hit = listed[at] == h[maybe]
        doc = np.searchsorted(first, maybe[hit], side="right") - 1
        key, tf = np.unique(doc * len(listed) + at[hit], return_counts=True)
        return np.diff(first), key // len(listed), key % len(listed), tf

    def block(held: list) -> pa.RecordBatch:
        base = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
        n = np.concatenate([x[1] for x in held])
        doc = np.concatenate([x[2] + b for x, b in zip(held, base)])
        term, tf = (np.concatenate([x[i] for x in held]) for i in (3, 4))
        own, pos = np.unique(doc, return_inverse=True)  # only documents with a posting are listed
        order = np.argsort(term, kind="stable")
        names, df = np.unique(term, return_counts=True)
        ids = pa.concat_arrays([x[0] for x in held]).take(pa.array(own))
        row = [n[n > 0].size, n.sum()]
        lists = [ids, pa.array(n[own], pa.int64())] + [
            pa.array(x.astype(np.int32)) for x in (names, df, pos[order], tf[order])]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(x)], pa.int64()) for x in row]
            + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists],
            names=["docs", "terms", "doc_id", "n", "term", "df", "pos", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in merged(batches, "text"):
            n, doc, term, tf = cells(b.column("text"))
            held.append((b.column("doc_id"), n, doc, term, tf))
            size += len(tf)
            if size >= BLOCK_POSTINGS:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)
    return run


# -- evaluation --------------------------------------------------------------

def evaluate(lists: list[tuple[np.ndarray, np.ndarray, int]], docs: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of all documents of a block that score ``floor`` or more.
    ``lists`` holds (ascending positions, impacts, greatest impact) of each term."""
    short = [x for x in lists if len(x[0]) * SHORT <= docs]
    rest = [x for x in lists if len(x[0]) * SHORT > docs]
    if short:
        total = np.zeros(docs, np.int64)
        for pos, impact, _ in short:
            total[pos] += impact
        pos = np.flatnonzero(total)
        if len(pos):
            rest.append((pos, total[pos], int(total[pos].max())))
    rest.sort(key=lambda x: x[2])
    bound = np.cumsum([x[2] for x in rest])
    if not len(rest) or bound[-1] < floor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = int(np.searchsorted(bound, floor))  # lists before it can't reach the floor together
    score = np.zeros(docs, np.int64)
    for pos, impact, _ in rest[first:]:
        score[pos] += impact
    at = np.flatnonzero(score)
    score = score[at]
    for i in range(first - 1, -1, -1):
        live = score + bound[i] >= floor
        at, score = at[live], score[live]
        if not len(at):
            break
        pos, impact, _ = rest[i]
        j = np.minimum(np.searchsorted(pos, at), len(pos) - 1)
        score = score + np.where(pos[j] == at, impact[j], 0)
    live = score >= floor
    return at[live], score[live]


def _searcher(items: list[np.ndarray], weight: np.ndarray, floors: np.ndarray, docs: int, terms: int, k: int):
    """Each task's k best (item number, document, score) of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = floors.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row].values  # noqa: B023, E731
                ids = get("doc_id")
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                m = 50 + (50 * docs * get("n").to_numpy()) // terms
                term, df, pos, tf = (get(c).to_numpy() for c in ("term", "df", "pos", "tf"))
                if not len(term):
                    continue
                tf = tf.astype(np.int64)
                impact = np.repeat(weight[term], df) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[pos]))
                end = np.cumsum(df)
                top = np.maximum.reduceat(impact, end - df)
                place = np.full(len(weight), -1)
                place[term] = np.arange(len(term))
                for i, wanted in enumerate(items):
                    mine = place[wanted]
                    lists = [(pos[end[t] - df[t]:end[t]], impact[end[t] - df[t]:end[t]], int(top[t]))
                             for t in mine[mine >= 0] if top[t] > 0]
                    at, score = evaluate(lists, len(ids), max(1, int(floor[i])))
                    if not len(at):
                        continue
                    s, d, z = (np.concatenate(x) for x in zip(best[i], (score, ids[at], none[at])))
                    order = np.lexsort((d, z, -s))[:k]
                    best[i] = s[order], d[order], z[order]
                    if len(order) == k:
                        floor[i] = max(floor[i], best[i][0][-1])
        size = [len(x[0]) for x in best]
        if sum(size):
            s, d, z = (np.concatenate(x) for x in zip(*best))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(items)), size), pa.int64()), pa.array(d, pa.int64(), mask=z),
                 pa.array(s, pa.int64())], names=["item", "doc_id", "score"])
    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))))
    return items.select("item_id", found.alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for
    each of ``items`` (item_id, text), equal scores by ascending doc_id."""
    small_batches(docs.sparkSession)
    cells = stored(item_terms(items), "item_terms")
    groups = max(1, -(-cells.count() // GROUP_CELLS))
    out = None
    for g in range(groups):
        mine = cells.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        found = _search_group(docs, mine, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_group(docs: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = cells.collect()  # about GROUP_CELLS
    words = sorted({r.term for r in rows})
    data = pa.array(words or ["-"], pa.string())
    raw, off = text_bytes(data)
    h = word_hashes(raw, off[:-1], off[1:])
    order = np.argsort(h)
    listed, number = h[order], {words[j]: i for i, j in enumerate(order)} if words else {}
    wanted: dict = {}
    for r in rows:
        wanted.setdefault(r.item_id, []).append(number[r.term])
    ids = sorted(wanted, key=lambda x: (x is None, x))
    lists = [np.array(sorted(wanted[x]), np.int64) for x in ids]

    path = shared_path(spark, "index")
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .mapInArrow(_indexer(listed), _INDEX).write.option("parquet.block.size", 16 << 20).parquet(path))
    index = spark.read.schema(_INDEX).parquet(path)
    total = index.agg(F.sum("docs"), F.sum("terms")).first()
    docs_n, terms_n = int(total[0] or 0), int(total[1] or 0)
    weight = np.zeros(len(listed), np.int64)
    for r in (index.select(F.explode(F.arrays_zip("term", "df")).alias("c")).groupBy("c.term")
              .agg(F.sum("c.df").alias("df")).collect()):
        weight[r.term] = math.floor(1000 * math.log((2 * docs_n + 2) / (2 * r.df + 1)))

    def best(blocks: DataFrame, floors: np.ndarray) -> DataFrame:
        kernel = _searcher(lists, weight, floors, docs_n, max(1, terms_n), k)
        return blocks.mapInArrow(kernel, "item long, doc_id long, score long")

    floors = np.zeros(len(ids), np.int64)
    seeds = index.where(F.pmod(F.xxhash64("doc_id", "docs", "terms"), F.lit(SEED_ONE_IN)) == 0)
    window = Window.partitionBy("item").orderBy(F.desc("score"))
    for r in (best(seeds, floors).withColumn("r", F.row_number().over(window)).where(F.col("r") == k).collect()):
        floors[r["item"]] = r["score"]
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item long, item_id {_type(cells)}")
    window = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = (best(index, floors).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k))
    # ids of one group of items: at most GROUP_CELLS
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _type(cells: DataFrame) -> str:
    return cells.schema["item_id"].dataType.simpleString()
