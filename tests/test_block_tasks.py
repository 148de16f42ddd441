"""Steps of a network have a bounded number of tasks, do not deal out the table of blocks, and leave nothing named behind."""

import numpy as np
import pytest

from reviewloom.operators import network
from tests.test_network import graph


def test_steps_move_mail_alone_in_few_tasks(spark, monkeypatch):
    nodes, edges, *_ = graph(spark, 120, 9)
    found = []
    for size, waves in ((network.BLOCK, network.WAVES), (6, 0)):
        monkeypatch.setattr(network, "BLOCK", size)
        monkeypatch.setattr(network, "WAVES", waves)
        model = network.RelationNetwork(3, 3, hidden=4, layers=2)
        model.prepare(nodes, edges)
        found.append(model.gradients(model.initial(3), np.random.default_rng(8), 5))
        if size == 6:
            assert (model.base.count, model.base.tasks) == (20, 8)
            plan = model.base.then(model.base.begin(lambda b: []), lambda b: [])._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1
        model.release()
        assert not spark.sql("SHOW TABLES").where("tableName LIKE 'kept%'").count()
    assert found[0][0] == pytest.approx(found[1][0]) and all(np.allclose(found[0][1][k], found[1][1][k], atol=1e-12) for k in found[0][1])
