"""The likest later reviews of a context's sources beside a plain version, with reviews of one vector and equal scores."""

import numpy as np

from reviewloom.operators import edges
from tests.conftest import SMALL


def test_likest_after_is_that_of_a_plain_version(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(12, 4)).round(3).tolist() + [[0.0] * 4]
    rows = [(int(rng.integers(0, 2)), int(d), i, int(rng.integers(0, 13))) for i, d in enumerate(rng.integers(0, 35, 400))]
    df = spark.createDataFrame(rows, "prod_id long, day int, review_id long, vec_id long").selectExpr("prod_id", "date_add(date '2024-01-01', day) AS date", "date_add(date '2024-01-01', cast(floor(day / 7) * 7 AS int)) AS week", "review_id", "vec_id")
    got = {tuple(r) for r in edges.likest_after(df, spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"), 6, 2).collect()}
    v = np.array(vectors, np.float32).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    met = {}
    for p, day, dst, vec in rows:
        before = sorted(((d, i, x) for q, d, i, x in rows if q == p and d // 7 < day // 7), reverse=True)[:6]
        for d, src, x in before:
            met.setdefault(src, []).append((-round(float(np.clip(v[x] @ v[vec], -1, 1)), 9), day - d, dst))
    want = {(src, dst, -score, apart) for src, found in met.items() for score, apart, dst in sorted(found)[:2]}
    key = lambda rows: sorted((s, d, round(x, 7) + 0.0, a) for s, d, x, a in rows)
    assert key(got) == key(want)


def test_so05_makes_no_edge_of_each_review(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["so05"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "explode(earlier" not in plan
