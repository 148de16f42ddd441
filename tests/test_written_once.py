"""Frames that a fit reads many times are tables."""

from pyspark.ml.classification import MultilayerPerceptronClassifier

from reviewloom.plans import graphs
from tests.conftest import SMALL
from tests.test_sampling_plans import plan


def test_network_is_fitted_on_a_table(spark, monkeypatch):
    seen, fit = [], MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, df, *a: seen.append(plan(df)) or fit(self, df, *a))
    scored = graphs._network(spark, SMALL)
    assert len(seen) == 1 and not any(step in p for p in (seen[0], plan(scored)) for step in ("Window", "Join"))
    assert scored.count() == 1000


def test_heads_make_the_features_once(spark, monkeypatch):
    from reviewloom.plans import edges

    calls, features = [], edges.features
    for module in (edges, graphs):
        monkeypatch.setattr(module, "features", lambda s, d: calls.append(d) or features(s, d))
    assert graphs._heads(spark, SMALL).count() == 1000 and len(calls) == 1


def test_matrix_of_array_columns():
    import numpy as np
    import pandas as pd

    from reviewloom.operators.network import matrix

    rows = [np.array([1.0, 2.0]), None, np.array([3.0, 4.0])]
    assert matrix(pd.Series(rows), 2).tolist() == [[1, 2], [0, 0], [3, 4]]
    assert matrix(pd.Series([rows[0], rows[2]]), 2).tolist() == [[1, 2], [3, 4]]
    assert matrix(pd.Series([], dtype=object), 2).shape == (0, 2) and matrix(pd.Series([None, None]), 2).tolist() == [[0, 0], [0, 0]]
