"""Pairs that meet in blocks beside brute force, and plans without a table of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from reviewloom.operators import blocks, similar, stats
from tests.compare import differences
from tests.conftest import SMALL


@pytest.mark.parametrize("seed, n, k", [(0, 1, 3), (1, 50, 3), (2, 1000, 5), (3, 130, 31)])
def test_candidates_hold_all_of_the_largest(seed, n, k):
    values = np.random.default_rng(seed).integers(0, 40, (7, n)).astype(float)
    rows, cols = blocks.at_least_kth(values, k, 0.0)
    for i in range(7):
        kth = np.sort(values[i])[::-1][: min(k, n)][-1]
        assert set(np.flatnonzero(values[i] >= kth)) <= set(cols[rows == i])


@pytest.mark.parametrize("block", [9, 16_384])
def test_nearest_beside_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(60, 5)), np.repeat(rng.normal(size=(1, 5)), 40, axis=0), np.zeros((2, 5))])
    df = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "part long, src long, v array<double>")
    got = {(r.src, r.dst) for r in similar.nearest(df, df.select("part", F.col("src").alias("dst"), "v", F.col("src").alias("rank_as")), ["part"], 4, block=block).collect()}
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    want = set()
    for i in range(len(v)):
        order = sorted((-round(float(np.clip(u[i] @ u[j], -1, 1)), 9), j) for j in range(i % 2, len(v), 2))
        want |= {(i, j) for _, j in order[:4]}
    assert got == want


def test_vectors_of_a_hot_key_are_dealt_out_once(spark):
    """Six thousand rows of a product week are one block, not three times three."""
    df = spark.range(6000).select(F.lit(0).alias("part"), F.col("id").alias("src"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("v"))
    plan = similar.nearest(df, df.select("part", F.col("src").alias("dst"), "v", F.col("src").alias("rank_as")), ["part"], 2)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "16384" in text and "cast(v" not in text


@pytest.mark.parametrize("name", ["ed06", "ed10"])
def test_pairs_are_no_rows_of_a_join(spark, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert "FlatMapCoGroupsInPandas" in df._jdf.queryExecution().optimizedPlan().toString()
    assert differences(df, __spark_entry__.oracle_sql()[name], SMALL) == ""


def test_exact_tails_are_not_counted_where_the_limit_is_taken(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(stats, "rank_sum_tails", never)
    monkeypatch.setattr(stats, "distance_tail", never)
    monkeypatch.setattr(stats, "EXACT_DISTANCE", 10)
    df = spark.range(200).select((F.col("id") % 2).alias("y"), (F.col("id") % 17).cast("double").alias("v"))
    assert 0 < stats.two_groups(df, "v", "y").first()["mann_whitney_p"] <= 1
    assert 0 < stats.kolmogorov_smirnov(df, "v", "y", exact=True).first()["p_value"] <= 1
