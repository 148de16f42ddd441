"""An attention network over many blocks is the one over a single block, in stretches of a few edges, and no edge is a row of a pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import network
from tests.test_network import graph


def test_blocks_and_stretches_change_nothing(spark, monkeypatch):
    nodes, edges, *_ = graph(spark, 40, 9)
    edges = edges.union(spark.createDataFrame([(i, 38, 2) for i in range(38)] + [(5, 5, 0), (1, 2, 0), (1, 2, 0)], "src long, dst long, edge_type int"))
    nodes = nodes.withColumn("review_id", F.col("review_id") - 3 + F.when(F.col("review_id") > 20, 1 << 40).otherwise(0))  # negative ids and large ones
    new = lambda c: F.col(c) - 3 + F.when(F.col(c) > 20, 1 << 40).otherwise(0)
    edges = edges.select(new("src").alias("src"), new("dst").alias("dst"), "edge_type")
    found = []
    for size, met in ((network.BLOCK, network.MET), (6, 7)):
        monkeypatch.setattr(network, "BLOCK", size)
        monkeypatch.setattr(network, "MET", met)
        model = network.AttentionNetwork(3, hidden=4, layers=3, heads=2, dropout=0.3)
        model.prepare(nodes, edges)
        w = {k: v + 0.1 for k, v in model.initial(3).items()}
        loss, g = model.gradients(w, None, 5)
        found.append((model.base.count, loss, g, [tuple(r) for r in model.scores(w).orderBy("review_id").collect()]))
        plan = model.base.begin(lambda b: [])._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
        model.release()
    (one, loss, g, scores), (many, loss2, g2, scores2) = found
    assert (one, many) == (1, 7) and len(scores) == 40
    assert loss == pytest.approx(loss2) and all(np.allclose(g[k], g2[k], atol=1e-12) for k in g)
    assert [r[:3] for r in scores] == [r[:3] for r in scores2] and np.allclose([r[3] for r in scores], [r[3] for r in scores2])
