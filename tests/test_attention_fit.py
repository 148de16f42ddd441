"""The query of the attention network fits that network alone."""

from reviewloom.plans import graphs
from tests.conftest import SMALL


def test_attention_fits_no_other_network(spark, monkeypatch):
    seen = []

    def fit(model, nodes, edges, **_):
        seen.append(type(model).__name__)
        model.prepare(nodes, edges)
        return model.initial(1), []

    monkeypatch.setattr(graphs.network, "fit", fit)
    monkeypatch.setattr(graphs, "_FITS", {})
    assert graphs._attention(spark, SMALL).count() == 1000
    assert seen == ["AttentionNetwork"]
