"""Fill-in-the-middle, toxicity and ranked lexical search: brute force, exact round
trips, held-out labels, and the defined edge cases."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from sentier.llm import fill_middle, lexical, toxicity

from conftest import SF01, SMOKE

LONG = " ".join(f"wörd{i % 977} x{i % 613}" for i in range(40_000))
ROWS = [(1, "a few words, naïve 日本 text 😀 here\n", "s"), (1, "a few words, naïve 日本 text 😀 here\n", "s"),
        (2, None, None), (None, "a text without an id", "n"), (3, "", "e"), (4, " \n\t ", "b"), (5, "x" * 70_000, "x"),
        (6, LONG, "l"), (7, "holds <M> inside", "m"), (8, "<", "q"), (9, "é", "one"), (10, " lead and tail  ", "t")]
CLASH = "doc_id long, text string, n string, form string, output string, score string, spans string, _h1 string, _text string, rank string"


def _rows(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, e, e, e, e, e, e, e, e) for d, t, e in rows], CLASH)


def _fim(doc_id, text, cut=lambda t: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    u = cut(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_of_edge_cases(spark):
    rows = ROWS + [(100 + i, f"ünit {i} of <S many > wörds\t" + "ß" * (i % 5), "z") for i in range(300)]
    out = fill_middle.transform(_rows(spark, rows))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == Counter((d, *_fim(d, t)) for d, t, _ in rows)
    assert set(out.columns) >= {"score", "rank"} and "text" not in out.columns
    back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t, _ in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(_rows(spark).limit(0)).collect() == []


def test_fill_middle_by_code_points(spark):
    out = fill_middle.transform(_rows(spark), unit="char").collect()
    assert (Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
            == Counter((d, *_fim(d, t, list)) for d, t, _ in ROWS))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a é日😀\n", max_size=12), min_size=1, max_size=6))
def test_exception_index_converts_both_ways(texts):
    whole = "".join(texts)
    index = fill_middle.Exceptions(np.frombuffer(whole.encode(), np.uint8))
    chars = np.arange(len(whole) + 1)
    offsets = np.array([len(whole[:i].encode()) for i in chars])
    assert (index.bytes(chars) == offsets).all() and (index.chars(offsets) == chars).all()


# -- ranked search -----------------------------------------------------------

def _terms(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute_search(docs, items, k=50):
    tf = [Counter(_terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    big, total = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in tf for w in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    for i, words in asked.items():
        scored = []
        for (d, _), c, m in zip(docs, tf, n):
            s = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[w] + 1)))
                    * ((10**9 * c[w]) // (1000 * c[w] + 20 * (50 + (50 * m * big) // total))) for w in words if c[w])
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: x[:3] if x[2] is not None
                                                                         else (x[0], True, 0))[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "common w3 W4 rare7"), (1, "w5"), (2, None), (3, ""), (4, "no such term"), (None, "w6 common"), (5, "common common"),
         (6, " ".join(f"w{i}" for i in range(60)))]


def _corpus():
    rng = np.random.default_rng(4)
    rows = [(int(i), "Common, " + " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 80)) for i in range(600)]
    rows += [(5000, f"rare7 {rows[3][1]}"), (5000, f"rare7 {rows[3][1]}"), (None, "rare7 w3"), (6000, None), (6001, ""),
             (6002, "w3 " * 30_000), (6003, "?!")]
    return rows


@pytest.mark.parametrize("cells,postings", [(1 << 17, 1 << 18), (20, 500)])
def test_search_against_brute_force(spark, monkeypatch, cells, postings):
    monkeypatch.setattr(lexical, "GROUP_CELLS", cells)      # several groups of items,
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)  # many blocks, so that floors prune
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"term": F.lit("x"), "item_id": F.lit(0)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    got = sorted((tuple(r) for r in lexical.search(docs.repartition(5), items).collect()), key=repr)
    assert got == _brute_search(rows, ITEMS)
    for k in (1, 3):
        got = sorted((tuple(r) for r in lexical.search(docs, items, k).collect()), key=repr)
        assert got == _brute_search(rows, ITEMS, k)


def test_search_in_empty_tables(spark):
    docs = spark.createDataFrame(_corpus()[:5], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(0, 3000))
def test_hybrid_evaluation_keeps_every_document_above_the_floor(seed, docs, floor):
    rng = np.random.default_rng(seed)
    lists = []
    for _ in range(rng.integers(0, 9)):
        pos = np.sort(rng.choice(docs, rng.integers(1, docs + 1) if rng.random() < 0.6 else 1, replace=False))
        impact = rng.integers(1, 900, len(pos))
        lists.append((pos, impact, int(impact.max())))
    whole = np.zeros(docs, np.int64)
    for pos, impact, _ in lists:
        whole[pos] += impact
    at, score = lexical.evaluate(lists, docs, max(1, floor))
    want = np.flatnonzero(whole >= max(1, floor))
    assert at.tolist() == want.tolist() and score.tolist() == whole[want].tolist()


# -- toxicity ----------------------------------------------------------------

def _chain(seed, n, begins):
    rng = np.random.default_rng(seed)
    field = toxicity.Field(np.zeros(1), rng.normal(size=5))
    return field, rng.normal(size=n), np.array(begins)


@pytest.mark.parametrize("n,begins", [(1, [0]), (7, [0]), (9, [0, 1, 4]), (10, [0, 9])])
def test_marginals_against_all_label_sequences(n, begins):
    field, e, begins = _chain(n, n, begins)
    m = field.steps(e, begins)
    got = toxicity.marginals(*toxicity.messages(m))
    _, start, ct, tc, tt = field.chain
    edge = {(0, 0): 0.0, (0, 1): ct, (1, 0): tc, (1, 1): tt}
    total, toxic = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(e[t] * y[t] + (start * y[t] if t in begins else edge[y[t - 1], y[t]]) for t in range(n))
        total += math.exp(s)
        toxic += math.exp(s) * np.array(y)
    assert np.allclose(got, toxic / total, rtol=1e-9)


def test_long_chains_stay_finite_and_texts_stay_apart():
    field, e, _ = _chain(3, 5000, [0])
    begins = np.array([0, 1, 2, 1700, 4999])
    whole = toxicity.marginals(*toxicity.messages(field.steps(30 * e, begins)))
    for a, z in zip(begins, [*begins[1:], 5000]):
        alone = toxicity.marginals(*toxicity.messages(field.steps(30 * e[a:z], np.array([0]))))
        assert np.allclose(whole[a:z], alone, atol=1e-12)
    assert np.isfinite(whole).all() and (whole >= 0).all() and (whole <= 1).all()


def test_the_field_learns_what_the_labelled_tokens_say():
    """The likelihood of the token labels rises, and the learned marginals follow them."""
    rng = np.random.default_rng(0)
    n = 4000
    feature = rng.integers(0, 6, n)
    mark = (feature < 2) & (rng.random(n) < 0.95)
    first = np.arange(0, n + 1, 20)
    field = toxicity.fit_field(first, np.arange(n), feature, mark, 6)
    p = toxicity._toxic_chances(field, first, np.arange(n), feature)
    rate = [p[feature == f].mean() for f in range(6)]
    assert min(rate[:2]) > 0.85 and max(rate[2:]) < 0.1
    assert field.weight[:2].min() > field.weight[2:].max() + 3


def _toxic_rows():
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{x}" for x in rng.integers(0, 300, rng.integers(3, 60))]
        toxic = i % 6 == 0
        for _ in range(int(rng.integers(1, 4)) * toxic):
            w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(["Trash,", "scum", f"loweit{rng.integers(50)}"])))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_scores_spans_and_edges(spark):
    rows, labels = _toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where(~toxicity.held_out(F.col("doc_id"))))
    extra = [(2000, "é日 w1 SCUM, scum w2", "a"), (2001, None, None), (2002, "", "b"), (2003, "?! ..", "c"),
             (None, "w1 w2", "d"), (2004, "w9 " * 40_000 + "scum", "e"), (2004, "w9 " * 40_000 + "scum", "e"),
             (2005, "x" * 70_000, "f")]
    out = toxicity.score(_rows(spark, [(d, t, "z") for d, t in rows] + extra), model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(extra) and {"n", "rank", "form"} <= set(out[0].asDict())
    wrong = [i for i, y in labels if (got[i].score >= toxicity.PREDICTED) != bool(y)]
    assert len(wrong) <= 9  # 99 in 100, held out or not
    text = extra[0][1]
    assert [text[s.start:s.stop] for s in got[2000].spans] == ["SCUM, scum"]
    assert got[2004].score >= 0.7 and [(s.start, s.stop) for s in got[2004].spans] == [(120_000, 120_004)]
    least = got[2002].score
    assert got[2001].score == got[2003].score == least < 0.05 and got[2001].spans == []
    assert all(0 <= r.score <= 1 for r in out) and got[None].score < 0.5
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("marks,want", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1)], 1.0)])
def test_toxicity_without_both_labels(spark, marks, want):
    docs = spark.createDataFrame([(1, "some words"), (2, "others")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {want}
    assert toxicity.fit(docs.limit(0), spark.createDataFrame(marks, "doc_id long, toxic int")).base == 0.0


def test_toxicity_query_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    out = E.queries()["op12_toxicity"](spark, d)
    marks = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    r = out.where("held_out").join(marks, "doc_id").select("predicted", "toxic", "score").toPandas()
    assert out.count() == 10_000 and len(r) > 1000
    assert r.predicted[r.toxic == 1].mean() > 0.8 and r.predicted[r.toxic == 0].mean() < 0.005
    assert r.score[r.toxic == 1].mean() > 0.8 > 0.1 > r.score[r.toxic == 0].mean()


def test_toxic_features_of_a_token():
    low, start, end, first = toxicity.tokens(pa.array(["Été, LOWEIT1", None, "é"]))
    words = [bytes(low[a:b]).decode() for a, b in zip(start, end)]
    assert words == ["été", "loweit1", "é"] and first.tolist() == [0, 2, 2, 3]
    h = toxicity.features(low, start, end)
    assert (h[1] != 0).tolist() == [True, True, True, True, True, False, False, True]


def test_queries_read_whole_tables(spark):
    for key in ("op11_fill_middle", "op12_toxicity"):
        assert E.queries()[key](spark, SMOKE).count() == spark.read.parquet(f"{SMOKE}/documents.parquet").count()
    found = E.queries()["op13_lexical_search"](spark, SF01)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _brute_search(docs, items)
