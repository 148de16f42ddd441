"""A relation network over many blocks is the one over a single block, and only sums that blocks need cross between them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import network
from tests.test_network import graph


@pytest.mark.parametrize("layers, home", [(1, False), (3, True)])
def test_blocks_change_nothing(spark, monkeypatch, layers, home):
    nodes, edges, *_ = graph(spark, 40, 9)
    edges = edges.union(spark.createDataFrame([(i, 38, 2) for i in range(38)], "src long, dst long, edge_type int"))  # one node that nearly all point to
    if home:  # homes of one node, and one of half of all
        nodes = nodes.withColumn("home", F.when(F.col("review_id") < 20, -1).otherwise(F.col("review_id")))
    found = []
    for size in (network.BLOCK, 6):
        monkeypatch.setattr(network, "BLOCK", size)
        model = network.RelationNetwork(3, 3, hidden=4, layers=layers, dropout=0.3, relation_dropout=0.0)
        model.prepare(nodes, edges)
        w = {k: v + 0.1 for k, v in model.initial(3).items()}
        loss, g = model.gradients(w, np.random.default_rng(8), 5)
        found.append((model.base.count, loss, g, [tuple(r) for r in model.scores(w).orderBy("review_id").collect()]))
        if size == 6:
            rows = model.base.table.select("block", "in_peer", "in_rows").collect()
            assert all(r <= 40 for row in rows for r in np.frombuffer(row["in_rows"], np.int32))
        model.release()
    (one, loss, g, scores), (many, loss2, g2, scores2) = found
    assert (one, many) == (1, 7)
    assert loss == pytest.approx(loss2) and all(np.allclose(g[k], g2[k], atol=1e-12) for k in g)
    assert [r[:3] for r in scores] == [r[:3] for r in scores2] and np.allclose([r[3] for r in scores], [r[3] for r in scores2])
