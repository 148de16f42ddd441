"""Latent vectors beside an exact decomposition, and saved models in a session that did not fit them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import latent, matrix, network, saved
from tests.conftest import SMALL
from tests.test_network import graph


def sparse_rows(spark, n, terms, seed, parts=5):
    rng = np.random.default_rng(seed)
    dense = np.zeros((n, terms))
    for i in range(n):
        at = rng.choice(terms, rng.integers(1, 9), replace=False)
        dense[i, at] = rng.random(len(at)) * (1 + 5 * (at < 4))
    rows = [(i, np.flatnonzero(x).tolist(), x[x != 0].tolist()) for i, x in enumerate(dense)]
    return dense, spark.createDataFrame(rows, "doc_id long, at array<int>, weight array<double>").repartition(parts)


def test_singular_vectors_are_those_of_an_exact_decomposition(spark, monkeypatch):
    """Blocks of a few weights, leaves of a few rows and blocks of a few terms, so that all of them meet."""
    monkeypatch.setattr(latent, "NONZERO", 40)
    monkeypatch.setattr(latent, "LEAF_ROWS", 50)
    monkeypatch.setattr(latent, "BLOCK_TERMS", 7)
    dense, rows = sparse_rows(spark, 400, 60, 1)
    values, vectors = latent.singular_vectors(rows, 60, 12)
    exact, right = np.linalg.svd(dense)[1:]
    assert np.allclose(values, exact[:12], rtol=0.01)
    assert np.allclose(values[:4], exact[:4], rtol=1e-6)
    assert np.allclose(np.abs((vectors[:, :4] * right[:4].T).sum(0)), 1, atol=1e-5)
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-9)
    assert (vectors[np.abs(vectors).argmax(axis=0), np.arange(12)] > 0).all()
    got = {r.doc_id: r.vector for r in latent.projected(rows, vectors, "doc_id").collect()}
    assert np.allclose([got[i] for i in range(400)], dense @ vectors)


def test_more_dimensions_than_there_are(spark):
    dense, rows = sparse_rows(spark, 30, 9, 2)
    values, vectors = latent.singular_vectors(rows, 9, 128)
    assert vectors.shape == (9, 9) and np.allclose(values, np.linalg.svd(dense)[1][:9])
    none, _ = latent.learned(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long"))
    assert none.count() == 0


def test_saved_text_model_gives_equal_vectors_elsewhere(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    train = docs.where("doc_id % 3 > 0").select("doc_id")
    vectors, basis = latent.learned(docs, train, 6)
    saved.TextVectorsModel(basis).write().save(f"file://{tmp_path}/model")
    model = saved.TextVectorsModel.load(f"file://{tmp_path}/model")
    assert model.getOrDefault("k") == 6 and model.getOrDefault("share") == pytest.approx(basis.share)
    other = spark.newSession().read.parquet(f"{SMALL}/documents.parquet")
    a, b = ({r.doc_id: r.vector for r in df.collect()} for df in (vectors, model.transform(other)))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)
    assert 0 < basis.share < 1


def test_saved_scale_and_network(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 5, True), (2, 4.0, 5, True), (3, None, 9, False)], "review_id long, a double, b int, train boolean")
    model = saved.Scale(["a", "b"], "train").fit(df)
    model.write().save(f"file://{tmp_path}/scale")
    again = saved.ScaleModel.load(f"file://{tmp_path}/scale")
    assert again.uid == model.uid
    expected = matrix.scaled(df, ["a", "b"], F.col("train")).orderBy("review_id").collect()
    assert again.transform(df).orderBy("review_id").collect() == expected
    nodes, edges, *_ = graph(spark, 20, 1)
    net = network.RelationNetwork(3, 3, hidden=4, learned_mix=True)
    net.prepare(nodes, edges)
    w = net.initial(5)
    saved.NetworkModel(w, net).write().save(f"file://{tmp_path}/net")
    scores = saved.NetworkModel.load(f"file://{tmp_path}/net").over(edges).transform(nodes)
    assert scores.orderBy("review_id").collect() == net.scores(w).orderBy("review_id").collect()
    net.release()
