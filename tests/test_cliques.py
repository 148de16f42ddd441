"""The capped clique beside a plain greedy version, in groups on both sides of every bound."""

import pytest

from reviewloom.operators.edges import capped_clique


def plain(ids, cap):
    if len(ids) <= cap + 1:
        return {(a, b) for a in ids for b in ids if a != b}
    degree, out = [0] * len(ids), set()
    for step in range(1, len(ids)):
        for i in range(len(ids) - step):
            if degree[i] < cap and degree[i + step] < cap:
                out |= {(ids[i], ids[i + step]), (ids[i + step], ids[i])}
                degree[i] += 1
                degree[i + step] += 1
    return out


@pytest.mark.parametrize("cap", [1, 2, 5, 10])
def test_capped_clique(spark, cap):
    rows, want = [], set()
    sizes = sorted({1, 2, cap + 1, cap + 2, 3 * cap, *range(6 * cap, 6 * cap + cap + 4), 211})
    for g, size in enumerate(sizes):
        # several reviews a day, ids against the order of days
        group = [((i // 3), 1000 * g + (i * 7) % 1000) for i in range(size)]
        rows += [(g, f"2024-{1 + day // 28:02d}-{1 + day % 28:02d}", i) for day, i in group]
        want |= plain([i for _, i in sorted(group)], cap)
    df = spark.createDataFrame(rows, "k long, date string, review_id long").selectExpr("k", "cast(date as date) as date", "review_id")
    got = [tuple(r) for r in capped_clique(df, ["k"], cap).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_group_goes_to_python(spark):
    """Which members are linked is told by patterns, of groups on both sides of the bound; members are read once."""
    df = spark.createDataFrame([(1, i) for i in range(200)] + [(2, i) for i in range(300, 320)], "k long, review_id long").selectExpr("k", "review_id", "date '2024-01-01' as date")
    made = capped_clique(df, ["k"], 5)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3
    assert {tuple(r) for r in made.collect()} == plain(list(range(200)), 5) | plain(list(range(300, 320)), 5)
