"""Exact p-values beside tabled ones and beside all orders counted."""

from itertools import combinations

import numpy as np
import pytest

from reviewloom.operators import stats


@pytest.mark.parametrize("u, n1, n2, p", [(0, 3, 3, 0.1), (2, 5, 5, 8 / 252), (0, 4, 4, 2 / 70), (1, 4, 5, 4 / 126), (6, 3, 4, 1.0), (23, 5, 5, 8 / 252)])
def test_rank_sums_of_tables(u, n1, n2, p):
    assert stats.rank_sum_tails(u, n1, n2) == pytest.approx(p)


@pytest.mark.parametrize("d, n1, n2, p", [(1.0, 4, 4, 2 / 70), (1.0, 5, 5, 2 / 252), (0.8, 5, 5, 20 / 252), (0.0, 3, 7, 1.0)])
def test_distances_of_tables(d, n1, n2, p):
    assert stats.distance_tail(d, n1, n2) == pytest.approx(p)


@pytest.mark.parametrize("n1, n2", [(3, 5), (4, 6), (6, 2)])
def test_all_orders(n1, n2):
    us, ds = [], []
    for at in combinations(range(n1 + n2), n1):
        other = [i for i in range(n1 + n2) if i not in at]
        us.append(sum(a > b for a in at for b in other))
        ds.append(max(abs(sum(a <= x for a in at) / n1 - sum(b <= x for b in other) / n2) for x in range(n1 + n2)))
    for u in set(us):
        low = min(u, n1 * n2 - u)
        assert stats.rank_sum_tails(u, n1, n2) == pytest.approx(min(1.0, 2 * np.mean(np.array(us) <= low)))
    for d in set(ds):
        assert stats.distance_tail(d, n1, n2) == pytest.approx(np.mean(np.array(ds) >= d - 1e-12))


def test_small_samples_in_frames(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (0, 4.0), (0, 5.0), (0, 6.0)], "y long, v double")
    assert stats.two_groups(df, "v", "y").first()["mann_whitney_p"] == pytest.approx(0.1)
    assert stats.kolmogorov_smirnov(df, "v", "y", exact=True).first()["p_value"] == pytest.approx(0.1)
    assert stats.kolmogorov_smirnov(df, "v", "y").first()["p_value"] == pytest.approx(0.0996, abs=1e-3)
