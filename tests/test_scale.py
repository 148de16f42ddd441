"""Exact quantiles beside numpy, and plans in which a hot key is many tasks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import edges, history, stats
from tests.test_fixtures import nodes


@pytest.mark.parametrize("make", [lambda rng, n: rng.normal(size=n), lambda rng, n: rng.integers(0, 5, n).astype(float), lambda rng, n: np.full(n, 2.5), lambda rng, n: rng.integers(0, n, n) ** 3.0])
@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_quantiles_are_exact(spark, make, n):
    x = make(np.random.default_rng(n), n)
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(x)] + [(0, None)], "g long, v double")
    points = {"low": 0.0, "q": 0.25, "half": 0.5, "most": 0.9, "high": 1.0}
    got = stats.quantiles(df, {k: (F.col("v"), q) for k, q in points.items()}).first()
    assert [got[k] for k in points] == pytest.approx([np.quantile(x, q) for q in points.values()])
    for r in stats.quantiles(df, {"a": (F.col("v"), 0.3), "b": (-F.col("v"), 0.3)}, ["g"]).collect():
        own = x[np.arange(n) % 3 == r["g"]]
        assert (r["a"], r["b"]) == pytest.approx((np.quantile(own, 0.3), np.quantile(-own, 0.3)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert stats.quantiles(df, {"a": (F.col("v"), 0.5)}).first()["a"] is None


def test_no_window_of_rows_is_dealt_by_a_whole_key(spark):
    """Rows are put in order inside a key's week; windows over a whole key see weeks only."""
    f = history.rating_features(nodes(spark, [(i, 1, 1, f"2024-0{1 + i % 6}-1{i % 9}", 1 + i % 5) for i in range(60)]))
    for df in (history.user_history(f), history.product_history(f), edges.last_k(f, "user_id", 3), edges.prior_context(f, 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.split("\n") if "windowspecdefinition" in x]
        assert windows
        for line in windows:
            whole = re.search(r"windowspecdefinition\((user|prod)_id#\d+L?, (week|_w\d+)#\d+ ASC", line)  # weeks of a key in order
            assert whole or re.search(r"windowspecdefinition\((user|prod)_id#\d+L?, week#\d+,", line), line
            assert not whole or "review_id#" not in line, line


def test_history_of_one_hot_key_is_that_of_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    data = [(i, 1, 1, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", int(r)) for i, (d, r) in enumerate(zip(rng.integers(0, 300, 400), rng.integers(1, 6, 400), strict=True))]
    got = {r.review_id: r for r in history.product_history(history.user_history(history.rating_features(nodes(spark, data)))).collect()}
    order = sorted(data, key=lambda r: (r[3], r[0]))
    day = lambda r: (np.datetime64(r[3]) - np.datetime64("1970-01-01")).astype(int)
    for at, r in enumerate(order):
        past = [float(p[4]) for p in order[:at]]
        g = got[r[0]]
        assert g.prior_user_review_count == at
        assert g.prior_user_avg_rating == pytest.approx(np.mean(past) if past else 0.0)
        assert g.prior_product_rating_std == pytest.approx(np.std(past) if past else 0.0, abs=1e-9)
        assert g.days_since_user_last_review == (day(r) - day(order[at - 1]) if at else -1)
        assert g.product_reviews_last_7d == sum(1 <= day(r) - day(p) <= 7 for p in order)
        assert g.product_reviews_last_30d == sum(1 <= day(r) - day(p) <= 30 for p in order)
    last = edges.last_k(nodes(spark, data), "user_id", 3)
    assert {(e.src, e.dst) for e in last.collect()} == {(order[at - i][0], r[0]) for at, r in enumerate(order) for i in (1, 2, 3) if at >= i}
