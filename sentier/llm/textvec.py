"""Vectorised text helpers that run inside Spark tasks on Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D. All hashes are
64-bit, seeded by constants only, so every executor and every rerun agrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import SparkSession

_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
LONG_WORD = 512  # bytes; longer words are hashed one by one
BATCH_ROWS = 32
CHUNK_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Few rows per Arrow batch, so that a batch of very long texts still fits
    in a Python worker; kernels merge batches up to CHUNK_BYTES themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


def seed(i: int) -> np.uint64:
    """The i-th seed constant."""
    return mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Join consecutive batches until ``column`` holds about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text has no bytes."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    data = data[off[0]:off[-1]]
    return data, off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray,
               sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words (runs of bytes not in
    ``sep``), and for each text the index of its first word (one more entry
    than texts)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~sep[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cut = off[(off > 0) & (off < n)]
    begin[cut] = word[cut]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    stop[cut - 1] = word[cut - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, off, side="left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, from its bytes and length."""
    m = len(start)
    length = end - start
    h = mix(length.astype(np.uint64) * _ODD)
    if m == 0:
        return h
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=pad, strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    live = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(live):
        left = length[live] - at
        v = eight[start[live] + at] & mask[np.minimum(left, 8)]
        with np.errstate(over="ignore"):
            h[live] = mix((h[live] ^ v) * _ODD + _M2)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(length > LONG_WORD):
        d = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(d, dtype="<u8")[0]
    return h


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, seed(1000 + salt), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc += words[i:i + n] * (seed(2000 + 64 * salt + i) | np.uint64(1))
    return mix(acc)


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Start indices of the k-word windows that lie within one text."""
    counts = np.diff(first)
    n = int(first[-1])
    ok = np.ones(n, dtype=bool)
    # the last k-1 words of a text start no window
    ends = first[1:]
    for back in range(1, k):
        hit = counts >= back
        ok[ends[hit] - back] = False
    return np.flatnonzero(ok)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
