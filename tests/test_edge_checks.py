"""The check of faulty edges reads the typed edges from a table, and counts ends before they meet the nodes."""

from reviewloom.operators import edges
from reviewloom.plans.edges import _faulty_edges
from tests.conftest import SMALL
from tests.test_sampling_plans import plan


def test_faulty_edges_read_a_table(spark):
    assert not any(step in plan(_faulty_edges(spark, SMALL)) for step in ("Window", "Join"))


def test_ends_are_counted_as_often_as_they_stand(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "review_id long")
    found = edges.edge_violations(spark.createDataFrame([(9, i % 4, 0) for i in range(50)] + [(1, -1, 7), (2, 2, 1), (None, 3, 1)], "src long, dst long, edge_type long"), nodes)
    assert [tuple(r) for r in found.select("self_loops", "unknown_types", "repeats", "unknown_ends").collect()] == [(1, 1, 46, 52)]
    none = edges.edge_violations(spark.createDataFrame([], "src long, dst long, edge_type long"), nodes)
    assert [tuple(r) for r in none.select("self_loops", "unknown_types", "repeats", "unknown_ends").collect()] == [(0, 0, 0, 0)]
