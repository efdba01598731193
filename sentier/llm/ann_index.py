"""Approximate nearest neighbours over balanced posting lists.

*Centroids* are fitted on a sample of the vectors (those whose ids have the least
hash; ``SAMPLE_ROWS``, or ``SAMPLE_PER_LIST`` a list if that is more) by balanced
bisection: a cluster is cut at the median of its main direction until there are
as many leaves as lists are wanted, so each holds an equal share of the sample; a
few rounds of k-means follow. There are at most ``MAX_LISTS``, so centroids and
their graph are bounded; beyond, lists grow, which costs time but no recall.

*Centroid search* walks a neighbour graph kept in memory by every task: a beam of
``BEAM`` centroids, started from spread-out entry points, is expanded to the
graph neighbours of its best members until nothing better turns up. Where more
centroids are wanted than the beam holds, all of them are compared.

*Posting lists.* Every vector goes to its nearest list and, as a boundary vector,
to others whose centroids are at most ``CLOSURE`` times as far, ``REPLICAS`` in
all. Lists are cut into blocks of about ``BLOCK_ROWS`` vectors by hash, so a list
that holds a third of all vectors (equal ones can't be parted by distance) is
searched by many tasks.

*Queries* select the lists whose centroids are at most ``ratio`` times as far as
the nearest one, ``probes`` at most and ``LEAST_PROBES`` at least (a query may sit
on a centroid of few vectors), and meet the blocks of those lists; each
block returns its nearest vectors by the exact distance in double precision, and
a ranked limit per query merges them. Queries of one list are cut into blocks
alike.

*Probes and ratio* are tuned for each index: ``HELD`` of its queries are compared
with every vector, and the cheapest pair is taken that finds ``TARGET`` of their
true nearest, every list if need be. ``PROBES`` and ``RATIO`` are where it starts:
no index searches by less.

Defined results: vectors that are null, empty, zero, hold a null or non-finite
component, or differ in length from most, take no part, nor do null ids; rows
with equal id and vector count once; ties go to the smaller id; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentier.llm.shared import stored

SAMPLE_ROWS, SAMPLE_PER_LIST = 20_000, 4
LIST_ROWS = 400
MAX_LISTS = 65_536
BLOCK_ROWS = 4096
DEGREE, BEAM = 16, 96
REPLICAS, CLOSURE = 3, 1.05
LEAST_PROBES, PROBES, RATIO = 8, 48, 1.6
HELD, TARGET = 256, 0.95
ASSIGNED = 1 << 16
CELLS = 1 << 21


def _least_columns(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k least values of each row, least first."""
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
    at.sort(axis=1)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)


class Centroids:
    """Centroids, their neighbour graph, and entry points into it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        self.squares = (points * points).sum(axis=1)
        near = np.empty((n, min(DEGREE, max(1, n - 1))), np.int32)
        step = max(1, CELLS // n)
        for i in range(0, n, step):
            d = self.squares[None, :] - 2.0 * points[i:i + step] @ points.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i:i + step] = _least_columns(d, near.shape[1]) if n > 1 else 0
        self.near = near
        # entry points: farthest-first, about the square root of the centroids
        picks, far = [0], np.full(n, np.inf)
        while len(picks) < int(np.ceil(np.sqrt(n))):
            far = np.minimum(far, ((points - points[picks[-1]]) ** 2).sum(axis=1))
            picks.append(int(far.argmax()))
        self.entries = np.unique(picks)

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances), nearest first, of up to k centroids per row of x."""
        if k > BEAM:
            return self._scan(x, k)
        rows = [self._walk(v, k) for v in x]
        ids = np.full((len(x), k), -1, np.int32)
        dist = np.full((len(x), k), np.inf)
        for r, (i, d) in enumerate(rows):
            ids[r, :len(i)], dist[r, :len(d)] = i, d
        return ids, dist

    def _scan(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(x), k), -1, np.int32)
        dist = np.full((len(x), k), np.inf)
        n = min(k, len(self.points))
        step = max(1, CELLS // len(self.points))
        for i in range(0, len(x), step):
            y = x[i:i + step]
            d = self.squares[None, :] - 2.0 * y @ self.points.T
            at = _least_columns(d, n)
            ids[i:i + step, :n] = at
            dist[i:i + step, :n] = np.sqrt(np.maximum(
                np.take_along_axis(d, at, axis=1) + (y * y).sum(axis=1)[:, None], 0.0))
        return ids, dist

    def _walk(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        width = max(BEAM, 2 * k)
        seen = np.zeros(len(self.points), bool)
        done = np.zeros(len(self.points), bool)
        new = self.entries
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        while True:
            seen[new] = True
            d = self.squares[new] - 2.0 * (self.points[new] @ v)
            ids, dist = np.concatenate([ids, new]), np.concatenate([dist, d])
            if len(ids) > width:
                keep = np.argpartition(dist, width)[:width]
                ids, dist = ids[keep], dist[keep]
            order = np.lexsort((ids, dist))
            ids, dist = ids[order], dist[order]
            todo = ids[~done[ids]][:8]
            if not len(todo):
                break
            done[todo] = True
            new = np.unique(self.near[todo])
            new = new[~seen[new]]
        d = np.sqrt(np.maximum(dist[:k] + (v * v).sum(), 0.0))
        return ids[:k], d


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Balanced bisection of the sample, then three rounds of k-means."""
    heap = [(-len(sample), 0, np.arange(len(sample)))]  # the largest first, then the oldest
    made = 0
    while len(heap) < lists and -heap[0][0] >= 2:
        big = heapq.heappop(heap)[2]
        x = sample[big] - sample[big].mean(axis=0)
        way = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(4):
            way = x.T @ (x @ way)
            size = np.linalg.norm(way)
            if size == 0:
                break
            way = way / size
        order = np.argsort(x @ way, kind="stable")
        for part in (big[order[:len(big) // 2]], big[order[len(big) // 2:]]):
            made += 1
            heapq.heappush(heap, (-len(part), made, part))
    points = np.unique(np.array([sample[p].mean(axis=0) for _, _, p in heap]), axis=0)
    for _ in range(3):
        step = max(1, CELLS // len(points))
        label = np.concatenate([
            ((points * points).sum(axis=1)[None, :] - 2.0 * sample[i:i + step] @ points.T).argmin(axis=1)
            for i in range(0, len(sample), step)])
        n = np.bincount(label, minlength=len(points))
        total = np.zeros_like(points)
        np.add.at(total, label, sample)
        points = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], points)
    return np.unique(points, axis=0)


def _matrix(col: pa.Array) -> np.ndarray:
    if not len(col):
        return np.zeros((0, 0))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding array<double>) that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad
                & F.exists("embedding", lambda x: x != 0))
    common = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if common:
        v = v.where(F.size("embedding") == common[0][0])
    return v.distinct()


def build(vectors: DataFrame, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS) -> Centroids | None:
    """Centroids for usable vectors; None if there are none."""
    n = vectors.count()
    if not n:
        return None
    lists = int(min(MAX_LISTS, max(1, round(n / list_rows))))
    sample_rows = max(sample_rows, SAMPLE_PER_LIST * lists)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow()
    return Centroids(fit_centroids(_matrix(sample.column(0).combine_chunks()), lists))


def _assign(index: Centroids, k: int, ratio: float, names: list[str], least: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ASSIGNED // k)
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                ids, dist = index.search(_matrix(b.column("embedding")), k)
                row, at = np.nonzero((ids >= 0) & _chosen(dist, np.arange(k), k, ratio, least))
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pick), b.column("embedding").take(pick), pa.array(ids[row, at])], names=names)
    return run


def _chosen(dist: np.ndarray, rank: np.ndarray, probes: int, ratio: float, least: int) -> np.ndarray:
    """Which lists are searched, by centroid distance (nearest first) and rank."""
    if np.isinf(ratio):
        return (rank < probes) & (dist < np.inf)
    return (rank < probes) & ((dist <= ratio * dist[:, :1] + 1e-12) | (rank < least))


def postings(vectors: DataFrame, index: Centroids, replicas: int = REPLICAS, closure: float = CLOSURE) -> DataFrame:
    """(vec_id, embedding, list): every vector in all its lists."""
    names = ["vec_id", "embedding", "list"]
    return vectors.mapInArrow(_assign(index, replicas, closure, names), "vec_id long, embedding array<double>, list int")


def _nearest_postings(qid: np.ndarray, q: np.ndarray, k: int):
    """Each task's k nearest rows of the postings of every held query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int32)]
        step = max(1, CELLS // len(q))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                x, xid = _matrix(b.column("embedding")), b.column("vec_id").to_numpy()
                d = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2.0 * q @ x.T
                d[qid[:, None] == xid[None, :]] = np.inf
                rows = [np.concatenate([best[0], d], axis=1)] + [
                    np.concatenate([old, np.broadcast_to(new, (len(q), len(new)))], axis=1)
                    for old, new in ((best[1], xid), (best[2], b.column("list").to_numpy()))]
                at = _least_columns(rows[0], min(k, rows[0].shape[1]))
                best = [np.take_along_axis(r, at, axis=1) for r in rows]
        held, at = np.nonzero(np.isfinite(best[0]))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32))] + [pa.array(c[held, at]) for c in best],
                                         names=["held", "score", "vec_id", "list"])
    return run


def tuned(posted: DataFrame, queries: DataFrame, index: Centroids, top: int = 10, replicas: int = REPLICAS,
          target: float = TARGET, held: int = HELD) -> tuple[int, float]:
    """(probes, ratio) that find ``target`` of the true nearest of ``held``
    queries (those whose ids have the least hash), compared with all vectors."""
    n = len(index.points)
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(held).select("vec_id", "embedding").toArrow()
    if n <= LEAST_PROBES or not asked.num_rows:
        return PROBES, RATIO
    q = _matrix(asked.column("embedding").combine_chunks())
    # a vector is in ``replicas`` lists at most, so these rows hold the nearest ``top`` with all their lists
    k = top * replicas
    order = Window.partitionBy("held").orderBy("score", "vec_id", "list")
    found = (posted.mapInArrow(_nearest_postings(asked.column("vec_id").to_numpy(), q, k),
                               "held int, score double, vec_id long, list int")
             .withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
             .groupBy("held", "vec_id").agg(F.min("score").alias("score"), F.collect_set("list").alias("lists")))
    order = Window.partitionBy("held").orderBy("score", "vec_id")
    found = (found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
             .select("held", "vec_id", F.explode("lists").alias("list")).toArrow())
    if not found.num_rows:
        return PROBES, RATIO
    row, vec, own = (found.column(c).to_numpy() for c in ("held", "vec_id", "list"))
    _, pair = np.unique(np.stack([row, vec]), axis=1, return_inverse=True)
    pair = pair.reshape(-1)
    ids, dist = index._scan(q, n)
    rank = np.empty_like(ids)
    np.put_along_axis(rank, ids, np.broadcast_to(np.arange(n, dtype=ids.dtype), ids.shape), axis=1)
    at = rank[row, own]
    best = None
    for ratio in (RATIO, 1.5 * RATIO, np.inf):
        ok = _chosen(dist, np.arange(n), n, ratio, LEAST_PROBES)
        first = np.full(pair.max() + 1, n)
        np.minimum.at(first, pair, np.where(ok[row, at], at, n))
        need = int(np.sort(first)[int(np.ceil(target * len(first))) - 1])
        if need >= n:
            continue  # lists that this ratio leaves out are wanted
        probes = max(PROBES, need + 1)
        cost = ok[:, :probes].sum()
        if best is None or cost < best[0]:
            best = cost, probes, ratio
    return best[1], float(best[2])


def _search_block(top: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and block.num_rows:
            q, x = _matrix(queries.column("embedding").combine_chunks()), _matrix(block.column("embedding").combine_chunks())
            qid, xid = queries.column("query_id").to_numpy(), block.column("vec_id").to_numpy()
            for i in range(len(q)):
                gap = x - q[i]
                d = np.sqrt((gap * gap).sum(axis=1))
                d[xid == qid[i]] = np.inf
                if len(d) > top:
                    last = np.partition(d, top - 1)[top - 1]
                    at = np.flatnonzero(d <= last)
                else:
                    at = np.arange(len(d))
                at = at[np.isfinite(d[at])]
                at = at[np.lexsort((xid[at], d[at]))][:top]
                out[0].append(np.full(len(at), qid[i])), out[1].append(xid[at]), out[2].append(d[at])
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])],
                        names=["query_id", "vec_id", "score"])
    return run


def search(posted: DataFrame, queries: DataFrame, index: Centroids, top: int = 10, probes: int = PROBES,
           ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries`` (vec_id, embedding): the
    nearest found among the posted vectors but the query's own id."""
    names = ["query_id", "embedding", "list"]
    asked = stored(queries.select("vec_id", "embedding").mapInArrow(
        _assign(index, probes, ratio, names, LEAST_PROBES), "query_id long, embedding array<double>, list int"), "asked")
    # per list: how many blocks its vectors and its queries take (MAX_LISTS rows at most)
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("vb"))
    asks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("qb"))
    blocks = F.broadcast(stored(sizes.join(asks, "list"), "blocks"))
    left = (asked.join(blocks, "list")
            .withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int"))
            .withColumn("v", F.explode(F.expr("sequence(0, vb - 1)"))).select("list", "q", "v", "query_id", "embedding"))
    right = (posted.join(blocks, "list")
             .withColumn("v", F.pmod(F.xxhash64("vec_id"), F.col("vb")).cast("int"))
             .withColumn("q", F.explode(F.expr("sequence(0, qb - 1)"))).select("list", "q", "v", "vec_id", "embedding"))
    found = (left.groupBy("list", "q", "v").cogroup(right.groupBy("list", "q", "v"))
             .applyInArrow(_search_block(top), "query_id long, vec_id long, score double"))
    near = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, top: int = 10) -> DataFrame:
    """Index all usable vectors and search for those where ``is_query`` holds."""
    good = stored(usable(vectors), "vectors")
    index = build(good)
    if index is None:
        return good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted = stored(postings(good, index), "postings")
    queries = good.where(is_query)
    probes, ratio = tuned(posted, queries, index, top)
    return search(posted, queries, index, top, probes, ratio)
