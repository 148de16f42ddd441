"""Passes over weights go by as many tasks as run at a time, whatever the parts of the input, and common terms are multiplied densely."""

import numpy as np

from reviewloom.operators import latent
from tests.conftest import SMALL
from tests.test_latent import sparse_rows


def test_texts_of_one_file_are_dealt_to_all_tasks(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").coalesce(1)
    vectors, _ = latent.learned(docs, docs.select("doc_id"), 4)
    sizes = vectors.select("doc_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in sizes) > 4 and max(sizes) < sum(sizes) / 2


def test_common_terms_change_no_product(spark, monkeypatch):
    monkeypatch.setattr(latent, "NONZERO", 40)
    dense, rows = sparse_rows(spark, 300, 60, 3, parts=20)
    basis = np.random.default_rng(1).normal(size=(60, 5))
    for common in (None, np.array([0, 2, 3, 41]), np.arange(60)):
        assert np.allclose(latent.gathered(rows, basis, common), dense.T @ dense @ basis)
        r = latent.triangle(rows, basis, common)
        assert np.allclose(r.T @ r, (dense @ basis).T @ (dense @ basis))
        got = {x.doc_id: x.vector for x in latent.projected(rows, basis, "doc_id", common).collect()}
        assert np.allclose([got[i] for i in range(300)], dense @ basis)
