"""Toxicity: a linear-chain conditional random field over the words of a text.

*Tokens* are runs of ASCII letters, digits and non-ASCII bytes, lower-cased. A
token's features are its whole form, its first 3 to 8 bytes and its last 4. Two
states, clean and toxic, are chained by learned transitions; forward-backward
gives every token its marginal chance of being toxic. Runs of tokens with a
marginal of ``TAGGED`` or more are the offending spans (code points); a document's
score is the chance that any token is toxic, 1 - prod(1 - p), calibrated by a
logistic curve.

*Labelled tokens.* Only documents are labelled. Document counts of each feature
among labelled toxic and clean texts (equal texts once) give its log ratio, less
1.64 standard errors. A feature above ``LEAST_RATIO`` that ``MIN_TOXIC`` toxic
texts hold is listed if its likelihood ratio statistic is ``LEAST_G`` or more (among
millions of rare words some stand in toxic texts only by chance); in a toxic text the tokens with at least half of the text's
greatest ratio are labelled toxic, all others, and all tokens of clean texts,
clean. The field then weighs the listed features together, so that one which also
stands in clean texts, or beside the offending words, gets little.

*Bounds.* The model is learned from at most ``SAMPLE_ROWS`` labelled documents
(least hash of the id; whole texts), its chain weights from the first
``FIT_TOKENS`` tokens of these, by one task, which gets the listed features of the
tokens only. At most ``MAX_FEATURES`` features are listed. Every document is
scored over its whole text.

*Long chains.* A message over two states is a product of 2 x 2 matrices. All texts
of a batch form one chain that is restarted where a text begins; it is cut into
blocks of equal length whose products are taken side by side, so a text of a
million words costs as many vector steps as a thousand short ones.

Defined results: null and empty texts, and texts without tokens, have no spans and
the least score; rows are scored each by itself, so repeated rows agree; labels
with a null id or null mark are not used, several marks of one document count as
toxic if any does; without a toxic or a clean labelled text the score is the share
of toxic ones (0 without any); other columns pass through unless named like an
output, which then wins; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentier.llm.fill_middle import Exceptions
from sentier.llm.shared import stored
from sentier.llm.textvec import as_long, merged, mix, seed, small_batches, text_bytes, word_hashes, word_spans

SAMPLE_ROWS = 20_000
FIT_TOKENS = 1 << 21
MAX_FEATURES = 1 << 16
MIN_TOXIC, LEAST_RATIO, LEAST_G = 3, float(np.log(4.0)), 18.0
FIRST, LAST = (3, 4, 5, 6, 7, 8), 4
STEPS, STEP, RIDGE, BATCH_TOKENS = 120, 0.5, 1e-4, 1 << 16
TAGGED, PREDICTED = 0.5, 0.7
OUTPUTS = ("score", "spans")

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, start, end, first): the tokens of all texts."""
    data, off = text_bytes(texts)
    start, end, first = word_spans(data, off, ~_TOKEN)
    low = _LOWER[data]
    if len(low) > 1:  # the two-byte capitals U+00C0 to U+00DE
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[wide] += 32
    return low, start, end, first


def features(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(token, kind) hashes of each token's features; 0 where there is none."""
    size = end - start
    out = np.zeros((len(start), 2 + len(FIRST)), np.uint64)
    out[:, 0] = word_hashes(low, start, end)
    for j, k in enumerate(FIRST):
        some = size > k
        out[some, 1 + j] = mix(word_hashes(low, start[some], start[some] + k) + seed(60 + k))
    some = size > LAST
    out[some, -1] = mix(word_hashes(low, end[some] - LAST, end[some]) + seed(70))
    return out


class Lexicon:
    """The listed features, by hash, and each one's log ratio."""

    def __init__(self, listed: np.ndarray, ratio: np.ndarray):
        self.listed, self.ratio = listed, ratio
        self.near = np.zeros(1 << 20, bool)
        self.near[(listed >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature number) of all listed features, by token."""
        if not len(self.listed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = h.reshape(-1)
        maybe = np.flatnonzero(self.near[(flat >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.listed, flat[maybe]), len(self.listed) - 1)
        hit = (self.listed[at] == flat[maybe]) & (flat[maybe] != 0)
        return maybe[hit] // h.shape[1], at[hit]


# -- the chain ---------------------------------------------------------------

class Field:
    """Weights: of features, and of bias, start, clean-toxic, toxic-clean, toxic-toxic."""

    def __init__(self, weight: np.ndarray, chain: np.ndarray):
        self.weight, self.chain = weight, chain

    def emission(self, n: int, token: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return self.chain[0] + np.bincount(token, self.weight[feature], n)[:n]

    def steps(self, emission: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(4, tokens): exp of the step scores clean-clean, clean-toxic, toxic-clean,
        toxic-toxic into each token; a text's first token has its start instead."""
        e = np.exp(np.clip(emission, -40, 40))
        _, start, ct, tc, tt = np.exp(np.clip(self.chain, -40, 40))
        m = np.stack([np.ones(len(e)), ct * e, np.full(len(e), tc), tt * e])
        m[0, begins] = m[2, begins] = 1.0
        m[1, begins] = m[3, begins] = start * e[begins]
        return m


def _scan(m: np.ndarray) -> np.ndarray:
    """(2, n): the normalised row vectors (1/2, 1/2) m_0 m_1 ... m_i for each i."""
    n = m.shape[1]
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    pad = rows * width - n
    if pad:
        fill = np.array([[1.0], [0.0], [0.0], [1.0]])
        m = np.concatenate([m, np.repeat(fill, pad, axis=1)], axis=1)
    m = np.ascontiguousarray(m.reshape(4, rows, width).transpose(2, 0, 1))  # (step, entry, block)
    p = np.array([[1.0], [0.0], [0.0], [1.0]]) * np.ones((1, rows))
    for a, b, c, d in m:
        p = np.stack([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
        p /= p.max(axis=0)
    x, y, entry = 0.5, 0.5, np.empty((2, rows))
    for i, (a, b, c, d) in enumerate(p.T.tolist()):
        entry[0, i], entry[1, i] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    out = np.empty((width, 2, rows))
    v = entry
    for i, (a, b, c, d) in enumerate(m):
        v = np.stack([v[0] * a + v[1] * c, v[0] * b + v[1] * d])
        v /= v.sum(axis=0)
        out[i] = v
    return out.transpose(1, 2, 0).reshape(2, rows * width)[:, :n]


def messages(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward and backward messages of all tokens."""
    forward = _scan(m)
    later = np.concatenate([m[:, 1:], np.ones((4, 1))], axis=1)[:, ::-1]
    backward = _scan(later[[0, 2, 1, 3]])[:, ::-1]
    return forward, backward


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    both = forward * backward
    return both[1] / both.sum(axis=0)


def fit_field(first: np.ndarray, token: np.ndarray, feature: np.ndarray, mark: np.ndarray, n_features: int) -> Field:
    """AdaGrad on the likelihood of the token labels ``mark``; text i has the tokens
    first[i]:first[i + 1]; (token, feature) pairs are sorted by token."""
    rate = min(0.5, max(1e-6, mark.mean() if len(mark) else 0.5))
    field = Field(np.full(n_features, 1.0), np.array([np.log(rate), 0.0, 0.0, 0.0, 0.0]))
    gw, gc = np.full(n_features, 1e-6), np.full(5, 1e-6)
    cuts, at = [0], 0
    while at < len(first) - 1:  # whole texts, about BATCH_TOKENS tokens
        at = max(at + 1, int(np.searchsorted(first, first[at] + BATCH_TOKENS, side="right")) - 1)
        cuts.append(min(at, len(first) - 1))
    order = np.random.default_rng(11)
    for _ in range(-(-STEPS // max(1, len(cuts) - 1))):
        for i in order.permutation(len(cuts) - 1):
            lo, hi = first[cuts[i]], first[cuts[i + 1]]
            if lo == hi:
                continue
            texts = first[cuts[i]:cuts[i + 1]]
            begins = np.unique(texts[texts < hi]) - lo
            x, z = np.searchsorted(token, [lo, hi])
            tok, feat, y = token[x:z] - lo, feature[x:z], mark[lo:hi].astype(np.float64)
            m = field.steps(field.emission(hi - lo, tok, feat), begins)
            f, b = messages(m)
            p = marginals(f, b)
            joint = np.stack([f[0, :-1] * m[0, 1:] * b[0, 1:], f[0, :-1] * m[1, 1:] * b[1, 1:],
                              f[1, :-1] * m[2, 1:] * b[0, 1:], f[1, :-1] * m[3, 1:] * b[1, 1:]])
            joint /= joint.sum(axis=0)
            inner = np.ones(hi - lo, bool)
            inner[begins] = False
            inner = inner[1:]
            was, now = y[:-1][inner], y[1:][inner]
            seen = np.array([((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum()])
            g = np.concatenate([[(y - p).sum(), (y - p)[begins].sum()], seen - joint[1:, inner].sum(axis=1)])
            n = hi - lo
            g = g / n - RIDGE * 0.01 * field.chain * np.array([0, 1, 1, 1, 1])
            gc += g * g
            field.chain += STEP * g / np.sqrt(gc)
            live, place = np.unique(feat, return_inverse=True)
            if len(live):
                g = np.bincount(place, (y - p)[tok]) / n - RIDGE * field.weight[live] / len(cuts)
                gw[live] += g * g
                field.weight[live] += STEP * g / np.sqrt(gw[live])
    return field


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds that any token of each text is toxic, drawn towards -6 and 6: how far
    beyond a text lies tells nothing about those between."""
    hazard = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-12)))])
    s = np.maximum(hazard[first[1:]] - hazard[first[:-1]], 1e-12)
    return 6 * np.tanh(np.where(s > 30, s, np.log(np.expm1(np.minimum(s, 30)))) / 6)


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, offset) of the logistic curve of y over x, by damped Newton steps."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    c = np.array([1.0, 0.0])
    a = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        q = 0.5 * (1 + np.tanh(0.5 * (a @ c)))
        h = (a * (q * (1 - q))[:, None]).T @ a + np.diag([1e-3, 1e-3])
        step = np.linalg.solve(h, a.T @ (target - q) - 1e-3 * (c - [1.0, 0.0]))
        c = c + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return np.array([max(c[0], 0.05), c[1]])


# -- learning ----------------------------------------------------------------

def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in merged(batches, "text", 2 << 20):
        low, start, end, first = tokens(b.column("text"))
        h = features(low, start, end)
        doc = np.repeat(np.arange(b.num_rows), np.diff(first))
        toxic = b.column("toxic").to_numpy()
        parts = []
        for j in range(h.shape[1]):  # each feature once a text
            some = h[:, j] != 0
            v, d = h[some, j], doc[some]
            order = np.lexsort((d, v))
            v, d = v[order], d[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
            parts.append((v[new], toxic[d[new]]))
        v, t = (np.concatenate(x) for x in zip(*parts))
        names, place = np.unique(v, return_inverse=True)
        n1 = np.bincount(place, t, len(names)).astype(np.int64)
        n0 = np.bincount(place, minlength=len(names)) - n1
        yield pa.RecordBatch.from_arrays([pa.array(as_long(names)), pa.array(n1), pa.array(n0)],
                                         names=["feature", "toxic", "clean"])


def _listed_tokens(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "text"):
            low, start, end, first = tokens(b.column("text"))
            token, feature = lexicon.find(features(low, start, end))
            cut = pa.array(np.searchsorted(token, first), pa.int32())
            doc = np.searchsorted(first, token, side="right") - 1
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32)))
                     for x in (token - first[doc], feature)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("toxic"), pa.array(np.diff(first)), *lists],
                                             names=["digest", "toxic", "n", "token", "feature"])
    return run


def _learn(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("digest").combine_chunks()
        n, toxic = t.column("n").to_numpy(), t.column("toxic").to_numpy()
        first = np.concatenate([[0], np.cumsum(n)])
        size = t.column("token").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(n)), size)
        token = t.column("token").combine_chunks().flatten().to_numpy() + first[doc]
        feature = t.column("feature").combine_chunks().flatten().to_numpy()
        # a token's ratio is its best feature's; half of its text's best is toxic
        own = lexicon.ratio[feature]
        best = np.zeros(len(n))
        np.maximum.at(best, doc, own)
        mark = np.zeros(first[-1], bool)
        mark[token[(toxic[doc] > 0) & (own >= 0.5 * best[doc])]] = True
        upto = max(1, int(np.searchsorted(first, FIT_TOKENS, side="right")) - 1)
        cut = int(np.searchsorted(token, first[upto]))
        field = fit_field(first[:upto + 1], token[:cut], feature[:cut], mark[:first[upto]], len(lexicon.listed))
        x = np.empty(len(n))
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(first, first[at] + BATCH_TOKENS, side="right")) - 1)
            lo, hi = first[at], first[to]
            i, j = np.searchsorted(token, [lo, hi])
            x[at:to] = evidence(_toxic_chances(field, first[at:to + 1] - lo, token[i:j] - lo, feature[i:j]),
                                first[at:to + 1] - lo)
            at = to
        curve = calibrate(x, toxic.astype(np.float64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([field.weight.tobytes()]), pa.array([field.chain.tolist()]), pa.array([curve.tolist()])],
            names=["weight", "chain", "curve"])
    return run


def _toxic_chances(field: Field, first: np.ndarray, token: np.ndarray, feature: np.ndarray) -> np.ndarray:
    n = int(first[-1])
    if not n:
        return np.zeros(0)
    begins = np.unique(first[:-1][first[:-1] < n])
    return marginals(*messages(field.steps(field.emission(n, token, feature), begins)))


class Model:
    """A lexicon, a field over it, and the curve of the document score; without a
    field every score is ``base``."""

    def __init__(self, base: float, lexicon: Lexicon | None = None, field: Field | None = None,
                 curve: np.ndarray | None = None):
        self.base, self.lexicon, self.field, self.curve = base, lexicon, field, curve


def held_out(doc_id: Column) -> Column:
    """The documents whose labels are not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, toxic 0 or 1) of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # at most ``rows`` ids and marks: a bounded broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    labelled = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
                .join(F.broadcast(chosen), "doc_id").withColumn("digest", F.md5("text")))
    sample = stored(labelled.groupBy("digest").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return Model(1.0 if n1 else 0.0)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    ratio = F.log(a / (n1 + 1.0)) - F.log(b / (n0 + 1.0)) - 1.64 * F.sqrt(1.0 / a + 1.0 / b)
    many, share = F.col("toxic") + F.col("clean"), n1 / (n1 + n0)
    g = 2 * (F.col("toxic") * F.log(F.greatest("toxic", F.lit(1)) / (many * share))
             + F.col("clean") * F.log(F.greatest("clean", F.lit(1)) / (many * (1 - share))))
    found = (sample.mapInArrow(_count_features, "feature long, toxic long, clean long")
             .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where(F.col("toxic") >= min(MIN_TOXIC, n1)).withColumn("ratio", ratio)
             .where((F.col("ratio") >= LEAST_RATIO) & (g >= LEAST_G))
             .select("feature", "ratio").orderBy(F.desc("ratio"), "feature").limit(MAX_FEATURES).collect())
    listed = np.array([r.feature for r in found], np.int64).view(np.uint64)
    order = np.argsort(listed)
    lexicon = Lexicon(listed[order], np.array([r.ratio for r in found], float)[order])
    learned = (sample.mapInArrow(_listed_tokens(lexicon), "digest string, toxic int, n long, token array<int>, feature array<int>")
               .repartition(1).mapInArrow(_learn(lexicon), "weight binary, chain array<double>, curve array<double>").first())
    return Model(n1 / (n1 + n0), lexicon, Field(np.frombuffer(bytes(learned.weight)), np.array(learned.chain)),
                 np.array(learned.curve))


# -- scoring -----------------------------------------------------------------

def _spans(p: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, texts: pa.Array) -> pa.Array:
    data, off = text_bytes(texts)
    index = Exceptions(data)
    hit = p >= TAGGED
    doc = np.searchsorted(first, np.arange(len(p)), side="right") - 1
    joins = np.zeros(len(p), bool)  # goes on the span of the token before
    joins[1:] = hit[1:] & hit[:-1] & (doc[1:] == doc[:-1])
    goes = np.append(joins[1:], False)
    a, z = np.flatnonzero(hit & ~joins), np.flatnonzero(hit & ~goes)
    base = index.chars(off)[doc[a]]
    struct = pa.StructArray.from_arrays([pa.array(index.chars(start[a]) - base), pa.array(index.chars(end[z]) - base)],
                                        names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(a, first), pa.int32()), struct)


def _scorer(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, "_text"):
            texts = b.column("_text")
            low, start, end, first = tokens(texts)
            p = np.zeros(len(start))
            score = np.full(b.num_rows, model.base)
            if model.field is not None:
                token, feature = model.lexicon.find(features(low, start, end))
                p = _toxic_chances(model.field, first, token, feature)
                x = model.curve[0] * evidence(p, first) + model.curve[1]
                score = 0.5 * (1 + np.tanh(0.5 * x))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(score), _spans(p, first, start, end, texts)],
                names=names)
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without its text, and score (0 to 1) and spans (start and stop, in
    code points, of the offending runs of words)."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in (*OUTPUTS, "text", "_text")]
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([docs.schema[c] for c in own]
                          + [T.StructField("score", T.DoubleType()), T.StructField("spans", spans)])
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    return docs.select(*[F.col(f"`{c}`") for c in own], text).mapInArrow(_scorer(model, schema.names), schema)
