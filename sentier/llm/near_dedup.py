"""Near-duplicate documents by weighted MinHash over TF-IDF shingles.

*Weights.* A shingle is five consecutive words (a shorter text is one shingle).
Its weight in a text is its count times ``ln(1 + N / max(df, f))``: N documents,
``df`` of them holding the shingle, ``f`` = all document-shingle pairs /
``HEAVY_SHINGLES``. So only shingles in at least ``f`` documents need a count of
their own, and there can be at most ``HEAVY_SHINGLES`` of those at any corpus
size: their table is the one thing that is sent to every task. It is found
exactly, in two scans: first each task reports its frequent shingles (by counters
that lose at most f / 8 of any count in all tasks together), then those few are
counted everywhere.

*Signatures.* Improved consistent weighted sampling: a shingle of weight w draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; t = floor(ln w / r + b),
ln y = r (t - b), ln a = ln c - ln y - r; the shingle with the least a is the
sample (shingle, t), and two texts agree on a sample with the probability of
their weighted Jaccard similarity. Each of ``PERMUTATIONS`` hashes deals the
shingles into ``BINS`` bins and takes one sample a bin; a bin that gets none
(short texts) samples the whole text by a hash of its own.

*Candidates.* Samples are banded. A bucket (texts with an equal band) compares
its members with one leader, not with each other; every bucket has a leader of
its own. Links missed that way are found in further rounds, for the buckets whose
members are not of one class yet: members of a bucket's smallest classes become
leaders and meet the members of other classes, then leave the bucket, until it
holds one class. A round takes as many leaders a bucket as keep its pairs below
``PAIRS_PER_MEMBER`` times the members at the start, so no step grows faster than the
corpus; the first such round merges most classes, the later ones take more leaders of
the few members left. Large families of edited copies are thinned out exactly: a text y of
weight W(y) whose shingles worth s stand in members of other classes overlaps any
of these by s at most, so it can only be similar to a text of weight
s (1 + t) / t - W(y) or less; if its bucket holds none, it leaves the bucket. That is
done before every round of leaders, the first one included, as classes and with them s
have changed by then. The pairs of a round are thinned out likewise: shingles are dealt into
``PARTS`` parts by hash, two texts overlap in a part by no more than the lesser of what s
is in it for either, and a pair whose parts sum to less than t / (1 + t) of both weights is
not asked for. No bucket is cut, and no link between classes is lost.

*Verification* computes the weighted Jaccard similarity of the two whole texts.
Classes are the connected components of the verified links.

Defined results: equal texts are one class and counted once; a text without
words is similar only to equal texts; a null text is a class of its own row, so
null texts with equal ids share it; a class's id is its least non-null
``doc_id``; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentier.llm.shared import free_names, stored
from sentier.session import shared_path
from sentier.llm.textvec import (as_long, gram_hashes, merged, mix, seed, small_batches, text_bytes, whole_windows,
                                 word_hashes, word_spans)

SHINGLE_WORDS = 5
THRESHOLD = 0.8
HEAVY_SHINGLES = 1 << 16
PERMUTATIONS, BINS, BAND = 4, 16, 4
EMPTY_DRAWS = 100_000
PAIRS_PER_MEMBER = (6, 12)  # in the first round of leaders, and in later ones
PARTS = 64             # of a text's shared weight, in the bound of a pair
PAIR_CHUNK_BYTES = 2 << 20
TASK_BYTES = 8 << 20   # least text of a task in the first scan for heavy shingles


def shingles(texts: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): all shingles of each text, with repeats."""
    data, off = text_bytes(texts)
    start, end, first = word_spans(data, off)
    w = word_hashes(data, start, end)
    at = whole_windows(first, k)
    doc = np.searchsorted(first, at, side="right") - 1
    h = gram_hashes(w, k)[at] if len(at) else np.zeros(0, np.uint64)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([mix(np.array([_fold(w[first[i]:first[i + 1]])], np.uint64))[0] for i in short], np.uint64)
        h = np.concatenate([h, own])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1), side="left")


def _fold(words: np.ndarray) -> int:
    acc = len(words)
    for x in words.tolist():
        acc = (acc * 0x100000001B3 ^ x) & 0xFFFFFFFFFFFFFFFF
    return acc


def distinct_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, text index), sorted by text, then hash."""
    h, off = shingles(texts)
    h = h.copy()
    for i in range(len(off) - 1):
        if off[i + 1] - off[i] > 1:
            h[off[i]:off[i + 1]].sort()
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    if not len(h):
        return h, np.zeros(0, np.int64), doc
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), doc[at]


# -- corpus statistics -------------------------------------------------------

def _local_heavy(slots: int):
    """Each task's frequent shingles and (shingle null) its number of pairs and
    documents. At most 16 slots counters are kept; where there would be more, the
    greatest count beyond is taken off all of them. Each pair taken off a counter
    goes with 16 slots others, so a count loses at most 1 / (16 slots) of the task's
    pairs. At the end counts go that are no greater than what is left of a loss of
    1 / (8 slots) in all: so a count loses at most that share of the pairs, however the
    table is split, and the many shingles seen once are not reported."""
    most = 16 * slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, pairs, docs, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0, 0
        for b in merged(batches, "text", 2 << 20):
            h, _, _ = distinct_shingles(b.column("text"))
            pairs, docs = pairs + len(h), docs + b.num_rows
            v, c = np.unique(h, return_counts=True)
            at = np.minimum(np.searchsorted(ids, v), max(0, len(ids) - 1))
            old = ids[at] == v if len(ids) else np.zeros(len(v), bool)
            n[at[old]] += c[old]
            ids, n = np.concatenate([ids, v[~old]]), np.concatenate([n, c[~old]])
            if len(ids) > most:
                off = np.partition(n, len(n) - most - 1)[len(n) - most - 1]
                n, lost = n - off, lost + off
                ids, n = ids[n > 0], n[n > 0]
            order = np.argsort(ids)
            ids, n = ids[order], n[order]
        some = n > pairs / (8 * slots) - lost
        ids, n = ids[some], n[some]
        none = np.zeros(len(ids), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(as_long(ids)), pa.nulls(1, pa.int64())]),
             pa.array(np.append(n, pairs), pa.int64()), pa.array(np.append(none, docs), pa.int64())],
            names=["shingle", "n", "docs"])
    return run


def _count_listed(listed: np.ndarray):
    table = np.zeros(1 << 16, bool)
    table[(listed >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(listed), np.int64)
        for b in merged(batches, "text"):
            h, _, _ = distinct_shingles(b.column("text"))
            h = h[table[(h >> np.uint64(48)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
            total += np.bincount(at[listed[at] == h], minlength=len(listed))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(listed[hit])), pa.array(total[hit])],
                                         names=["shingle", "n"])
    return run


class Idf:
    """N, the floor f, and the counts of the shingles above it (bounded)."""

    def __init__(self, docs: float, floor: float, heavy: np.ndarray, df: np.ndarray):
        self.docs, self.floor, self.heavy, self.df = docs, floor, heavy, df

    def parts(self) -> tuple:
        return self.docs, self.floor, self.heavy, self.df


def _idf(parts: tuple, h: np.ndarray) -> np.ndarray:
    docs, floor, heavy, df = parts
    f = np.full(len(h), floor)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        hit = heavy[at] == h
        f[hit] = np.maximum(df[at[hit]], floor)
    return np.log1p(docs / f)


def corpus_idf(texts: DataFrame, slots: int = HEAVY_SHINGLES) -> Idf:
    """Document frequencies of the heavy shingles of all texts, exactly."""
    # a task of few pairs can spare none of its counts: small splits are read together
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    first = stored(texts.coalesce(max(1, size // TASK_BYTES)).mapInArrow(_local_heavy(slots), "shingle long, n long, docs long")
                   .groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
                   .where("shingle IS NULL OR n > 1"), "heavy")
    total = first.where("shingle IS NULL").agg(F.sum("n"), F.sum("docs")).first()
    pairs, docs = float(total[0] or 0), float(total[1] or 0)
    floor = max(1.0, pairs / slots)
    # a shingle in `floor` documents loses at most floor / 8 in all tasks together
    found = first.where(F.col("shingle").isNotNull() & (F.col("n") >= 0.875 * floor)).select("shingle").collect()
    listed = np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))
    if not len(listed):
        return Idf(docs, floor, listed, np.zeros(0))
    rows = (texts.mapInArrow(_count_listed(listed), "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).collect())
    heavy = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(heavy)
    return Idf(docs, floor, heavy[order], np.array([r[1] for r in rows], float)[order])


# -- signatures --------------------------------------------------------------

def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _halves(x: np.ndarray) -> np.ndarray:
    """Product of two uniforms made of the two halves of x."""
    lo = (x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5
    hi = (x >> np.uint64(32)).astype(np.float64) + 0.5
    return lo * hi * 2.0 ** -64


def _draws(x: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) of improved consistent weighted sampling for hashes x."""
    with np.errstate(over="ignore"):
        r = -np.log(_halves(mix(x + seed(20))))
        log_c = np.log(-np.log(_halves(mix(x + seed(21)))))
        b = _unit(mix(x + seed(22)))
    t = np.floor(log_w / r + b)
    return log_c - r * (t - b) - r, t


def _least(key: np.ndarray, x: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sample hash of each): the least draw among the rows of a key;
    rows of a key stand together."""
    log_a, t = _draws(x, log_w)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    low = np.minimum.reduceat(log_a, at)
    hit = np.flatnonzero(log_a == np.repeat(low, np.diff(np.append(at, len(key)))))
    pick = hit[np.searchsorted(hit, at)]
    with np.errstate(over="ignore"):
        return key[at], mix(x[pick] + mix(t[pick].astype(np.int64).view(np.uint64) + seed(30)))


def samples(h: np.ndarray, log_w: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, PERMUTATIONS * BINS) sample hashes; rows without shingles are 0."""
    out = np.zeros((n, PERMUTATIONS, BINS), np.uint64)
    first = np.searchsorted(doc, np.arange(n + 1))
    for p in range(PERMUTATIONS if len(h) else 0):
        x = mix(h + seed(10 + p))
        key = doc * BINS + (x >> np.uint64(60)).astype(np.int64)
        order = np.argsort(key.astype(np.uint16) if n * BINS <= 65536 else key, kind="stable")
        cell, value = _least(key[order], x[order], log_w[order])
        flat = out[:, p].reshape(-1).copy()
        flat[cell] = value
        full = np.zeros(n * BINS, bool)
        full[cell] = True
        # a bin without shingles samples the whole text by a hash of its own
        empty = np.flatnonzero(~full & np.repeat(np.diff(first) > 0, BINS))
        size = np.diff(first)[empty // BINS]
        upto = np.cumsum(size)
        i = 0
        while i < len(empty):  # about EMPTY_DRAWS draws at a time
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + EMPTY_DRAWS)))
            e, m = empty[i:j], size[i:j]
            at = np.arange(m.sum()) + np.repeat(first[e // BINS] - np.concatenate([[0], np.cumsum(m)[:-1]]), m)
            own = np.array([seed(1000 + 100 * p + k) for k in range(BINS)], np.uint64)[e % BINS]
            with np.errstate(over="ignore"):
                cell, value = _least(np.repeat(e, m), mix(h[at] + np.repeat(own, m)), log_w[at])
            flat[cell] = value
            i = j
        out[:, p] = flat.reshape(n, BINS)
    return out.reshape(n, PERMUTATIONS * BINS)


def _signatures(idf: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "text"):
            h, tf, doc = distinct_shingles(b.column("text"))
            w = tf * _idf(idf, h)
            s = samples(h, np.log(w), doc, b.num_rows)
            bands = np.zeros((b.num_rows, s.shape[1] // BAND), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(bands.shape[1]):
                    acc = np.full(b.num_rows, seed(500 + j), np.uint64)
                    for i in range(BAND):
                        acc = mix(acc * np.uint64(0x100000001B3) + s[:, j * BAND + i])
                    bands[:, j] = acc
            some = np.bincount(doc, minlength=b.num_rows) > 0
            sizes = np.where(some, bands.shape[1], 0)
            flat = as_long(np.ascontiguousarray(bands[some]).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), lists],
                                             names=["doc_id", "node", "bands"])
    return run


# -- verification ------------------------------------------------------------

def _similarities(idf: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("text_a").nbytes + b.column("text_b").nbytes
            step = max(1, b.num_rows * PAIR_CHUNK_BYTES // max(1, size))
            for i in range(0, b.num_rows, step):
                yield _compare(b.slice(i, step), idf)
    return run


def _compare(b: pa.RecordBatch, idf: tuple) -> pa.RecordBatch:
    n = b.num_rows
    leaders = b.column("leader").dictionary_encode()
    code = leaders.indices.to_numpy(zero_copy_only=False)
    first = np.unique(code, return_index=True)[1]
    ha, ta, da = distinct_shingles(b.column("text_a"))
    hb, tb, db = distinct_shingles(b.column("text_b").take(pa.array(first)))
    wa, wb = ta * _idf(idf, ha), tb * _idf(idf, hb)
    sum_a = np.bincount(da, wa, n).astype(np.float64)
    sum_b = np.bincount(db, wb, len(first)).astype(np.float64)[code]
    begin = np.searchsorted(db, np.arange(len(first) + 1))
    begin_a = np.searchsorted(da, np.arange(n + 1))
    both = np.zeros(n, np.float64)
    for i in range(n):
        x, y = slice(begin_a[i], begin_a[i + 1]), slice(begin[code[i]], begin[code[i] + 1])
        if x.stop == x.start or y.stop == y.start:
            continue
        at = np.minimum(np.searchsorted(hb[y], ha[x]), y.stop - y.start - 1)
        hit = hb[y][at] == ha[x]
        both[i] = np.minimum(wa[x][hit], wb[y][at[hit]]).sum()
    whole = sum_a + sum_b - both
    sim = np.divide(both, whole, out=np.zeros(n), where=whole > 0)
    return pa.RecordBatch.from_arrays([b.column("node"), b.column("leader"), pa.array(sim)],
                                      names=["node", "leader", "similarity"])


# -- classes -----------------------------------------------------------------

def connected_components(links: DataFrame, a: str = "node", b: str = "leader") -> DataFrame:
    """(node, root): every node that has a link, with the least node of its
    component. Alternates linking each node's larger neighbours, then its
    smaller ones, to its least neighbour; the tables never outgrow the links and
    the number of rounds grows with the logarithm of a component's size."""
    edges = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(),
                   "edges", few=True)
    mark = _fingerprint(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy(F.col("hi").alias("n")).agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = (both.where("lo > hi").select(F.col("hi").alias("n"), F.col("lo").alias("v")).join(low, "n")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        large = stored(large, "edges", few=True)
        low = large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"))
        small = (large.withColumnRenamed("hi", "n").join(low, "n")
                 .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                                           F.struct(F.col("n").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                 .select("e.*").where("hi <> lo").distinct())
        edges, before = stored(small, "edges", few=True), mark
        mark = _fingerprint(edges)
        if mark == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _node() -> Column:
    """A text is known by its digest; a null text by its row's id."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.coalesce(F.md5(F.col("text").cast("string")), F.concat(F.lit("null:"), ident))


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, n_links): one row per input row.
    ``n_links`` counts the verified links of its text to leaders' texts."""
    return _classes(docs, threshold).select("doc_id", "class_id", "class_size", "n_links")


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the least id (then digest; nulls
    last) and, of equal rows, one."""
    node, tag, copies = free_names(docs, "node", "tag", "copies")
    key = lambda n: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col(n))
    rows = _classes(docs, threshold)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    best = rows.groupBy("root").agg(F.min(order).alias("b")).select("b.doc_id", "b.node").select(key("node").alias(tag))
    count = rows.select(key("node").alias(tag)).groupBy(tag).agg(F.count(F.lit(1)).alias(copies))
    keep = stored(best.join(count, tag), "kept")
    found = docs.withColumn(node, _node()).withColumn(tag, key(node)).join(keep, tag)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return (found.where(F.col(copies) == 1).select(*own)
            .unionByName(found.where(F.col(copies) > 1).dropDuplicates([tag]).select(*own)))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, node, root, class_id, class_size, n_links) per input row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", _node())
    idf = corpus_idf(rows.select("text")).parts()
    signed = stored(rows.mapInArrow(_signatures(idf), "doc_id long, node string, bands array<long>"), "signed")
    signs = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    member = signs.select("node", F.explode("bands").alias("bucket"))
    crowded = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    active = stored(member.join(crowded, "bucket").select("bucket", "node"), "members")

    # the members grow with the corpus: shuffled at every size, never broadcast
    need = active.select("node").distinct().hint("merge")
    texts = stored(rows.select("node", "text").join(need, "node", "left_semi")
                   .groupBy("node").agg(F.first("text").alias("text")), "texts")
    budget = active.count()
    leader = F.min(F.struct(F.xxhash64("node", "bucket"), F.col("node")))["node"].alias("leader")
    ask = active.join(active.groupBy("bucket").agg(leader), "bucket").where("node <> leader")
    paths: list[str] = []
    roots = None
    rounds = 0
    while True:
        ask = stored(ask.select("node", "leader").distinct(), "asked", few=rounds > 0)
        paths.append(shared_path(spark, "similar"))
        _verify(ask, texts, idf).write.parquet(paths[-1])
        read = spark.read.schema("node string, leader string, similarity double")
        fresh = read.parquet(paths[-1]).where(F.col("similarity") >= threshold)
        if roots is None:
            roots = stored(connected_components(fresh), "roots", few=True)
        elif not fresh.isEmpty():
            roots = _merged_roots(roots, fresh)
        active = stored(_unsettled(_rooted(active.select("bucket", "node"), roots)), "members", few=True)
        # as classes merge, support shrinks: the bounds of a round are tighter than the last one's
        bounds = stored(_bounds(active, texts, idf, threshold), "bounds", few=True)
        active = _unsettled(_able(active.join(bounds.drop("parts"), "node")))
        active = stored(_merged_buckets(active) if rounds == 1 else active, "members", few=True)
        left = active.count()
        if not left:
            break
        # leaders: members of the smallest classes of each bucket
        sizes = active.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("bucket").orderBy("n", F.xxhash64("node"), "node")
        leaders = stored(active.join(sizes, ["bucket", "root"]).withColumn("r", F.row_number().over(order))
                         .where(F.col("r") <= max(1, PAIRS_PER_MEMBER[min(rounds, 1)] * budget // left))
                         .join(bounds.select("node", "parts"), "node")
                         .select("bucket", F.col("node").alias("leader"), F.col("root").alias("lead_root"),
                                 F.col("weight").alias("lead_weight"), F.col("limit").alias("lead_limit"),
                                 F.col("parts").alias("lead_parts")), "leaders", few=True)
        fits = (F.col("weight") <= F.col("lead_limit")) & (F.col("lead_weight") <= F.col("limit"))
        least = threshold / (1.0 + threshold) * (1.0 - 1e-9) * (F.col("weight") + F.col("lead_weight"))
        pair = (active.join(bounds.select("node", "parts"), "node").join(leaders, "bucket")
                .where((F.col("root") != F.col("lead_root")) & fits & (_overlap("parts", "lead_parts") >= least)))
        ask = pair.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()
        done = read.parquet(*paths)  # one plan however many rounds there were
        done = done.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader"))
        ask = ask.join(done, ["node", "leader"], "left_anti")
        active = active.join(leaders.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
        rounds += 1
    links = read.parquet(*paths).where(F.col("similarity") >= threshold)
    degree = (links.select("node").union(links.select(F.col("leader").alias("node")))
              .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    ids = signed.select("doc_id", "node")
    by_text = ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    by_text = (by_text.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
               .join(degree, "node", "left"))
    classes = by_text.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_text = by_text.join(classes, "root").select("node", "root", "class_id", "class_size",
                                                   F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return ids.join(by_text, "node")


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unsettled(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one class."""
    several = members.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2")
    return members.join(several.select("bucket"), "bucket", "left_semi")


def _merged_buckets(members: DataFrame) -> DataFrame:
    """Buckets with the same least member (by hash) as one: those of one family
    of texts overlap, and a pair need not be asked for in each of them. All pairs
    of the single buckets are kept."""
    first = members.groupBy("bucket").agg(F.min(F.xxhash64("node")).alias("first"))
    return (members.join(first, "bucket").select(F.col("first").alias("bucket"), "node", "root", "weight", "limit")
            .distinct())


def _merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links: components of the classes they join."""
    a = _rooted(links.select("node", "leader"), roots).select(F.col("leader").alias("node"), F.col("root").alias("one"))
    pairs = _rooted(a, roots).select(F.col("one").alias("node"), F.col("root").alias("leader")).where("node <> leader")
    joined = stored(connected_components(pairs), "joined", few=True).select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # classes of one text so far stand only in ``joined``
    new = joined.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
    return stored(old.unionByName(new), "roots", few=True)


def _cells(idf: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "text", 1 << 20):
            h, tf, doc = distinct_shingles(b.column("text"))
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("member").take(pick), b.column("class").take(pick),
                                              pa.array(as_long(h)), pa.array(tf * _idf(idf, h))],
                                             names=["member", "class", "shingle", "w"])
    return run


def _bounds(active: DataFrame, texts: DataFrame, idf: tuple, threshold: float) -> DataFrame:
    """(node, weight, limit, parts): each member's weight, the limit of the weight of
    a member of another class that shared shingles allow it to be similar to, and
    what the shared shingles of each part weigh. Members and classes go by 64-bit hashes."""
    nodes = active.select("node", "root").distinct()
    cells = (texts.join(nodes, "node").select(F.xxhash64("node").alias("member"), F.xxhash64("root").alias("class"), "text")
             .mapInArrow(_cells(idf), "member long, class long, shingle long, w double"))
    held = Window.partitionBy("shingle")
    other = (F.min("class").over(held) != F.col("class")) | (F.max("class").over(held) != F.col("class"))
    part = F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")
    support = (cells.withColumn("s", F.when(other, F.col("w")).otherwise(0.0)).groupBy("member", part)
               .agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
               .groupBy("member").agg(F.sum("w").alias("weight"), F.sum("s").alias("s"),
                                      F.map_from_entries(F.collect_list(F.struct("part", "s"))).alias("by_part")))
    limit = F.col("s") * ((1.0 + threshold) / threshold + 1e-9) - F.col("weight")
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)),
                        lambda i: F.coalesce(F.try_element_at("by_part", i), F.lit(0.0)))
    return (nodes.select("node", F.xxhash64("node").alias("member")).join(support, "member")
            .select("node", "weight", limit.alias("limit"), parts.alias("parts")))


def _overlap(a: str, b: str) -> Column:
    """The most that two texts of different classes overlap by, from their parts."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)


def _able(members: DataFrame) -> DataFrame:
    """The members whose bucket holds a text light enough to be similar to them."""
    least = members.groupBy("bucket").agg(F.min("weight").alias("least"))
    return members.join(least, "bucket").where("limit >= least").drop("least")


def _verify(pairs: DataFrame, texts: DataFrame, idf: tuple) -> DataFrame:
    led = pairs.join(texts.withColumnRenamed("text", "text_a"), "node")
    whole = led.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("text_b")), "leader")
    return (whole.select("node", "leader", "text_a", "text_b")
            .mapInArrow(_similarities(idf), "node string, leader string, similarity double"))
