"""Risk-text edges beside a loop over sources, one after the other."""

import numpy as np
import pytest

from reviewloom.operators import similar


@pytest.mark.parametrize("targets, seed", [("both_risky", 1), ("anchor_risky", 2)])
def test_only_new_pairs_use_up_a_place(spark, targets, seed):
    rng = np.random.default_rng(seed)
    n, k = 90, 3
    vectors = rng.normal(size=(25, 3)).round(2)
    rows = [(i, int(rng.integers(-1, 2)), int(rng.integers(0, 25)), int(rng.integers(0, 4)), "2024-01-01" if rng.random() < 0.5 else "2024-01-08", int(rng.random() < 0.5), int(rng.random() < 0.4)) for i in range(n)]
    f = spark.createDataFrame(rows, "review_id long, rating_direction long, vec_id long, prod_id long, week string, short_review_flag long, extreme_rating long")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pairs, any_pairs = set(), set()
    for direction in (-1, 0, 1):
        group = [r for r in rows if r[1] == direction]
        sources = [r for r in group if r[5] or r[6]]
        pool = sources if targets == "both_risky" else group
        for a in sources:
            near = sorted(((-round(float(np.clip(unit[a[2]] @ unit[b[2]], -1, 1)), 9), b[0], b) for b in pool))[: k * 10 + 1]
            added = 0
            seen = [b for sim, _, b in near if -sim >= 0.5 and b[0] != a[0] and b[3:5] != a[3:5]]
            any_pairs |= {frozenset((a[0], b[0])) for b in seen[:k]}
            for b in seen:
                if added < k and frozenset((a[0], b[0])) not in pairs:
                    pairs.add(frozenset((a[0], b[0])))
                    added += 1
    for new_only, want in ((True, pairs), (False, any_pairs)):
        got = similar.risk_text(f, v, threshold=0.5, k=k, targets=targets, new_only=new_only).collect()
        assert {frozenset((e.src, e.dst)) for e in got} == want and len(got) == 2 * len(want)
    assert pairs > any_pairs or len(pairs) > len(any_pairs)


def test_likeness_of_large_weeks_in_blocks_is_that_of_a_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from reviewloom.operators import profiles

    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), "w", int(rng.integers(0, 12))) for i in range(40)] + [(99, 7, "w", 3)]
    f = spark.createDataFrame(rows, "review_id long, prod_id long, week string, vec_id long").withColumn("is_train", F.col("review_id") % 3 > 0)
    v = spark.createDataFrame([(i, [0.0, 0.0] if i == 0 else x.tolist()) for i, x in enumerate(rng.normal(size=(12, 2)))], "vec_id long, embedding array<double>")
    got = []
    for most in (1000, 3):
        monkeypatch.setattr(profiles, "SMALL_WEEK", most)
        made = profiles.template_similarity(f, v, F.col("is_train"))
        got.append({r.review_id: (round(r.max_sim, 8), round(r.top3_sim, 8), r.high_sim) for r in made.collect()})
    assert got[0] == got[1] and got[0][99] == (0.0, 0.0, 0)
