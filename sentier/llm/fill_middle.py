"""Fill-in-the-middle transformation of whole texts.

A text is cut into a prefix, a middle and a suffix, at unit boundaries drawn from
a hash of its id, and written in an order that asks for the middle last: ``psm``
(`<P>`prefix`<S>`suffix`<M>`middle) or ``spm`` (`<S>`suffix`<P>`prefix`<M>`middle).
Other texts stay ``plain``.

*Sparse exception index.* Cuts are found in bytes and reported in code points, or
the other way round. Only the multibyte characters of a batch are recorded: where
they stand and how many bytes they have beyond one. ``searchsorted`` over that
list turns a byte offset into a code point and back; a text without multibyte
characters costs a subtraction, and no text is decoded.

Units are tokens (``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+``, and the blanks that
end a text) or code points.

Defined results: a null or empty text has no units and is plain; a text that
holds one of the marks is plain, so the output can always be taken apart; a null
id draws like an empty one; rows are transformed each by itself, so repeated rows
agree; other columns pass through unless named like an output, which then wins;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentier.llm import shared  # noqa: F401  (ships the kernels)
from sentier.llm.textvec import merged, small_batches, text_bytes, word_spans

# The marks of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class Exceptions:
    """Where multibyte characters stand in UTF-8 bytes, and their excess bytes."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        size = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(size)])
        self.char_at = self.at - self.excess[:-1]

    def chars(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte offset (at a character's first byte)."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Byte offset of each code point."""
        return char + self.excess[np.searchsorted(self.char_at, char)]


def token_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, first): byte offsets at which the tokens of all texts end, and the
    index of each text's first token (one more entry than texts)."""
    _, end, first = word_spans(data, off)
    words = np.diff(first)
    last = np.where(words > 0, end[np.maximum(first[1:] - 1, 0)] if len(end) else 0, off[:-1])
    tail = last < off[1:]  # blanks after the last word, or nothing but blanks
    out = np.concatenate([[0], np.cumsum(words + tail)])
    ends = np.empty(out[-1], np.int64)
    ends[np.arange(len(end)) + np.repeat(out[:-1] - first[:-1], words)] = end
    ends[out[1:][tail] - 1] = off[1:][tail]
    return ends, out


def _marked(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks."""
    if len(data) < 3:
        return np.zeros(len(off) - 1, bool)
    inner = [ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]
    hit = np.flatnonzero((data[:-2] == ord("<")) & np.isin(data[1:-1], inner) & (data[2:] == ord(">")))
    doc = np.searchsorted(off, hit, side="right") - 1
    out = np.zeros(len(off) - 1, bool)
    out[doc[hit + 3 <= off[doc + 1]]] = True
    return out


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """(n, byte offsets of the two cuts, code points of prefix and middle) of each
    text, the cuts after h1 % (n + 1) and h2 % (n + 1) units, smaller first."""
    data, off = text_bytes(texts)
    index = Exceptions(data)
    begin = index.chars(off)
    if unit == "token":
        ends, first = token_ends(data, off)
        n = np.diff(first)
    else:
        n = np.diff(begin)
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    at = []
    for u in (low, high):
        if unit == "token":
            x = off[:-1].copy()
            some = u > 0
            x[some] = ends[first[:-1][some] + u[some] - 1]
        else:
            x = index.bytes(begin[:-1] + u)
        at.append(x)
    c1, c2 = index.chars(at[0]), index.chars(at[1])
    return n, at[0], at[1], c1 - begin[:-1], c2 - c1


def _kernel(unit: str, fim_percent: int, spm_percent: int, names: list[str]):
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "_text"):
            texts = b.column("_text")
            h = [b.column(f"_h{i}").to_numpy() for i in (1, 2, 3, 4)]
            n, at1, at2, c1, c2 = cuts(texts, h[0], h[1], unit)
            data, off = text_bytes(texts)
            plain = (np.diff(off) == 0) | _marked(data, off) | (h[2] % 100 >= fim_percent)
            spm = ~plain & (h[3] % 100 < spm_percent)
            raw, out, size = memoryview(data), [], np.diff(off) + 9 * ~plain
            for i in range(b.num_rows):
                lo, hi = off[i], off[i + 1]
                if plain[i]:
                    out.append(raw[lo:hi])
                elif spm[i]:
                    out += (s, raw[at2[i]:hi], p, raw[lo:at1[i]], m, raw[at1[i]:at2[i]])
                else:
                    out += (p, raw[lo:at1[i]], s, raw[at2[i]:hi], m, raw[at1[i]:at2[i]])
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), b.num_rows,
                                         [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(out))])
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 5)]
                + [pa.array(n, pa.int64()), pa.array(form), pa.array(c1, pa.int64(), mask=plain),
                   pa.array(c2, pa.int64(), mask=plain), text.cast(pa.string())], names=names)
    return run


def transform(docs: DataFrame, unit: str = "token", seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, others) without its text, and n (units of the text), form,
    prefix_chars, middle_chars (code points) and output (the transformed text)."""
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    names = [f"_h{i}" for i in range(1, 5)]
    own = [c for c in docs.columns if c not in (*OUTPUTS, *names, "text", "_text")]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *draw, F.col("text").cast("string").alias("_text"))
    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField(c, k) for c, k in zip(OUTPUTS, kinds)])
    return rows.mapInArrow(_kernel(unit, fim_percent, spm_percent, schema.names), schema)


def _parts(body: Column, first: str, second: str) -> tuple[Column, Column, Column]:
    """What stands before the first mark, between the marks, and after the second."""
    one = F.substring_index(body, first, 1)
    rest = F.substr(body, F.length(one) + 1 + len(first))
    two = F.substring_index(rest, second, 1)
    return one, two, F.substr(rest, F.length(two) + 1 + len(second))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form alone. No part holds a mark,
    and no mark ends in what another begins with, so the first one found is it."""
    body = F.substr(output, F.lit(4))
    prefix, suffix, middle = _parts(body, SUFFIX, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = _parts(body, PREFIX, MIDDLE)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def digest(transformed: DataFrame) -> DataFrame:
    """One row per document with digests of the output and of the text restored."""
    sha = lambda c: F.sha2(c, 256)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                              sha(F.col("output")).alias("output_sha256"),
                              sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
