"""S14, C1 and C5 with vectors of the places' texts: one saved model, every place."""

import math

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from sentier.plans import ml
from sentier.registry import _place_texts, _places, _text_vectors
from sentier.session import shared_path
from sentier.sources.tables import role

from conftest import SMOKE


def test_a_saved_model_gives_old_and_new_rows_one_space(spark):
    rows = spark.createDataFrame([(i, f"w{i % 5} w{i % 7} common") for i in range(40)] + [(40, None), (41, "")], "id long, t string")
    path = shared_path(spark, "model")
    first = rows.where("id < 20")
    model = ml.stored_embedder(spark, path, first, "t", 32)
    store = ml.embed(model, first, "t").select("id", "vector")
    again = ml.stored_embedder(spark, path, rows, "t", 32)  # loaded: the later corpus isn't fitted
    out = {r.id: list(r.vector) for r in ml.embed_incremental(store, rows, "id", "t", again).collect()}
    whole = {r.id: list(r.vector) for r in ml.embed(model, rows, "t").collect()}
    other = {r.id: list(r.vector) for r in ml.embed_texts(rows, "t", 32).collect()}
    assert out == whole and out != other and len(out) == 42
    assert out[40] == out[41] == [0.0] * 32
    everything = ml.embed_incremental(ml.embed(model, rows, "t").select("id", "vector"), rows, "id", "t", model)
    assert everything.where("source = 'new'").count() == 0 and everything.count() == 42


def _km(a, b, c, d):
    p1, l1, p2, l2 = map(math.radians, (a, b, c, d))
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * 6371.009 * math.asin(min(1.0, math.sqrt(h)))


def test_recommendations_for_every_place(spark):
    vectors, _ = _text_vectors(spark, SMOKE)
    v = {r.tsid: np.array(r.vector, float) for r in vectors.collect()}
    at = {r.tsid: (r.latitude, r.longitude) for r in _places(spark, SMOKE).collect()}
    assert set(v) == set(at)
    got = {}
    for r in E.queries()["recommend_by_text"](spark, SMOKE).collect():
        got.setdefault(r.ref_tsid, {})[r["rank"]] = r.score
    assert set(got) == set(at)
    for i in at:
        scores = sorted((float(v[i] @ v[j]) - 0.5 * _km(*at[i], *at[j]) for j in at if j != i), reverse=True)[:8]
        assert np.allclose([got[i][k + 1] for k in range(8)], scores, atol=1e-5)


def test_retrieval_over_every_place(spark):
    vectors, model = _text_vectors(spark, SMOKE)
    v = vectors.collect()
    m = np.array([r.vector for r in v], float)
    asked = ml.embed(model, role(spark, SMOKE, "v_queries").select("qid", "query"), "query").orderBy("qid").limit(20).collect()
    got = E.queries()["rag_by_text"](spark, SMOKE)
    assert got.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where("n <> 10").count() == 0
    from sentier.operators.vectors import knn
    q = spark.createDataFrame([(r.qid, list(r.vector)) for r in asked], "qid long, vector array<float>")
    near = {}
    for r in knn(q, vectors, 5, q_id="qid", q_vec="vector", v_id="tsid", v_vec="vector").collect():
        near.setdefault(r.qid, {})[r["rank"]] = r.score
    for r in asked:
        d = np.sort(((m - np.array(r.vector, float)) ** 2).sum(axis=1))[:5]
        assert np.allclose([near[r.qid][k + 1] for k in range(5)], d, atol=1e-6)
    assert _place_texts(spark, SMOKE).count() == len(v)
