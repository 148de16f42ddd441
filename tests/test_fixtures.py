"""Hand-made rows for the semantics most likely to go wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import quartile, text_columns
from reviewloom.operators import anchors, edges, history, matrix, profiles, roles, sampling, similar, stats, units
from reviewloom.sources import cut, standardize


def day(text):
    return dt.date.fromisoformat(text)


def nodes(spark, rows):
    """Typed reviews of (review_id, user_id, prod_id, date, rating[, text])."""
    full = [(*r[:4], float(r[4]), -1 if r[0] % 2 else 1, r[5] if len(r) > 5 else "some words") for r in rows]
    raw = spark.createDataFrame(full, "review_id long, user_id long, prod_id long, date string, rating double, label int, text string")
    return standardize(raw)


def features(spark, rows):
    f = history.rating_features(nodes(spark, rows))
    f = f.withColumns(text_columns(F.col("text")))
    return cut(history.with_weekly_shift(history.group_sizes(history.interactions(history.product_history(history.user_history(f))))))


def by_id(df, *columns):
    return {r["review_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_same_day_counts_for_the_prior_but_not_for_the_last_week(spark):
    f = features(spark, [(1, 7, 3, "2024-03-04", 5), (2, 7, 3, "2024-03-06", 1), (3, 7, 3, "2024-03-06", 3)])
    got = by_id(f, "prior_user_review_count", "product_reviews_last_7d", "prior_user_avg_rating")
    assert got == {1: (0, 0, 0.0), 2: (1, 1, 5.0), 3: (2, 1, 3.0)}


def test_weeks_begin_on_monday(spark):
    f = features(spark, [(1, 1, 1, "2024-01-07", 4), (2, 1, 1, "2024-01-08", 4)])
    assert by_id(f, "week") == {1: day("2024-01-01"), 2: day("2024-01-08")}


def test_weeks_without_reviews_count_as_zero(spark):
    rows = [(1, 1, 1, "2024-01-01", 5), (2, 2, 1, "2024-01-08", 5), (3, 3, 1, "2024-02-12", 5)]
    got = by_id(features(spark, rows), "same_dir_log_count_lift_4w")
    assert got[1] == pytest.approx(0.6931472) and got[2] == pytest.approx(0.6931472 - 0.2231436) and got[3] == pytest.approx(0.6931472)


def test_later_rows_change_no_earlier_feature(spark):
    rows = [(i, i % 2, i % 3, f"2024-01-{1 + i:02d}", 1 + i % 5) for i in range(9)]
    other = rows[:-1] + [(8, 0, 2, "2024-01-29", 5)]
    columns = ["prior_user_review_count", "prior_product_avg_rating", "product_reviews_last_30d", "rating_deviation_from_prior_product_mean", "days_since_user_last_review"]
    a, b = by_id(features(spark, rows), *columns), by_id(features(spark, other), *columns)
    assert {k: v for k, v in a.items() if k != 8} == {k: v for k, v in b.items() if k != 8}


def test_quartiles_of_six_ranks(spark):
    got = spark.range(1, 7).select(quartile(F.col("id"), F.lit(6)).alias("q")).collect()
    assert [r["q"] for r in got] == [0, 0, 1, 2, 3, 3]


def test_words_are_parted_by_unicode_space(spark):
    row = spark.createDataFrame([("a\u00a0b c",), (None,)], "text string").select(text_columns(F.col("text"))["word_len"].alias("n")).collect()
    assert [r["n"] for r in row] == [3, 0]


def test_of_equal_rows_the_smallest_id_stays(spark):
    df = nodes(spark, [(9, 1, 1, "2024-01-01", 5), (5, 1, 1, "2024-01-01", 5)])
    assert list(by_id(history.without_repeats(df, ["user_id", "date", "rating"]), "rating")) == [5]


def test_positional_split_parts_a_day_and_date_split_does_not(spark):
    df = nodes(spark, [(i, i, 1, "2024-01-01" if i < 5 else "2024-01-02", 3) for i in range(10)])
    assert sorted(by_id(units.temporal_split(df), "split").items()) == [(i, "train" if i < 6 else "valid" if i < 7 else "test") for i in range(10)]
    dated = by_id(units.date_split(df), "split")
    assert len({dated[i] for i in range(5, 10)}) == 1


def test_campaign_triplet(spark):
    f = features(spark, [(1, 1, 1, "2024-01-01", 5), (2, 2, 1, "2024-01-02", 5), (3, 3, 1, "2024-01-03", 5)]).withColumn("vec_id", F.col("review_id"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r["src"], r["dst"]): r["score"] for r in edges.campaign_pairs(f, vectors).collect()}
    assert set(got) == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert got[1, 2] == pytest.approx(0.35 + 0.16 + 0.14 + 0.15) and got[1, 3] == pytest.approx(0.16 + 0.14 + 0.15)
    some = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert (1, 2) not in {(r["src"], r["dst"]) for r in edges.campaign_pairs(f, vectors, existing=some).collect()}


def test_shocks_meet_strangers_only(spark):
    before = [(10 + p, 90 + p, p, "2023-12-01", 1) for p in (1, 2, 3)]
    shocks = [(1, 1, 1, "2024-01-02", 5), (2, 2, 2, "2024-01-03", 5), (3, 1, 3, "2024-01-03", 5), (4, 4, 1, "2024-01-03", 5)]
    got = {(r["src"], r["dst"]) for r in edges.shock_peers(features(spark, before + shocks)).collect()}
    assert got == {p for a, b in ((1, 2), (2, 3), (2, 4), (3, 4)) for p in ((a, b), (b, a))}


def test_the_highest_type_of_a_pair_stays(spark):
    e = spark.createDataFrame([(1, 2, 0), (1, 2, 2), (2, 1, 0), (3, 3, 1)], "src long, dst long, edge_type int")
    assert sorted(map(tuple, edges.collapsed(e).collect())) == [(1, 2, 2), (2, 1, 0)]


def test_likeness_to_itself_counts_as_zero(spark):
    f = features(spark, [(1, 1, 1, "2024-01-01", 5), (2, 2, 1, "2024-01-02", 5)]).withColumns({"vec_id": F.col("review_id"), "split": F.lit("train")})
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert set(by_id(profiles.template_similarity(f, vectors, F.col("split") == "train"), "max_sim").values()) == {0.0}


def test_a_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 4.0, True), (2, 4.0, True), (3, float("inf"), False)], "review_id long, x double, t boolean")
    assert by_id(matrix.scaled(df, ["x"], F.col("t")), "x") == {1: 0.0, 2: 0.0, 3: -4.0}


def test_average_precision_steps_over_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, y long")
    assert stats.average_precision(df, "score", "y").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_corrected_chi_square(spark):
    df = spark.createDataFrame([("a", 0)] * 8 + [("a", 1)] * 2 + [("b", 0)] * 3 + [("b", 1)] * 7, "x string, y long")
    gap = 2.5 - 0.5
    assert stats.chi_square(df, "x", "y").first()["chi2"] == pytest.approx(2 * gap * gap / 5.5 + 2 * gap * gap / 4.5)


def test_context_triples(spark):
    df = nodes(spark, [(i, 1, 1, f"2024-01-{1 + i:02d}", r) for i, r in enumerate([5, 1, 3, 3, 4])])
    got = {(r["review_id"], r["role"]): r["chosen"] for r in anchors.prior_triple(df, "user_id").collect()}
    assert got == {(1, "recent"): 0, (2, "recent"): 1, (2, "mid"): 0, (3, "recent"): 2, (3, "mid"): 1, (3, "baseline"): 0, (4, "recent"): 3, (4, "mid"): 1, (4, "baseline"): 0}


def test_context_of_earlier_weeks_of_some_seeds(spark):
    f = history.rating_features(nodes(spark, [(1, 1, 1, "2024-01-01", 5), (2, 1, 1, "2024-01-09", 5), (3, 1, 1, "2024-01-10", 5)]))
    seeds = spark.createDataFrame([(3,)], "review_id long")
    assert [tuple(r) for r in anchors.prior_triple(f, "prod_id", "week", seeds).collect()] == [(3, "recent", 1)]


def test_largest_remainders(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b" if i < 8 else "c") for i in range(10)], "id long, s string")
    got = sampling.stratified_take(df, 4, ["s"], [F.col("id")]).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"a": 2, "b": 1, "c": 1}


def test_history_bins_break_ties_by_day_and_id(spark):
    df = nodes(spark, [(i, i, 1, f"2024-01-{1 + i // 3:02d}", 3) for i in range(12)]).withColumn("prior_product_review_count", F.col("review_id") % 2)
    order = sorted(range(12), key=lambda i: (i % 2, i // 3, i))
    want = {x: 0 if k <= 1 + 11 / 4 else 1 if k <= 1 + 11 / 2 else 2 if k <= 1 + 33 / 4 else 3 for k, x in enumerate(order, 1)}
    assert by_id(roles.history_bin(df), "history_bin") == want


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_by_blocks(spark, block):
    rows = [(i % 2, i, [float((i * 7) % 5 - 2), float((i * 3) % 4 - 1), float(i % 3)]) for i in range(40)] + [(0, 40, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g long, src long, v array<double>")
    got = similar.nearest(df, df.select("g", F.col("src").alias("dst"), "v", F.col("src").alias("rank_as")), ["g"], 4, 0.2, block)

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    want = set()
    for g, i, v in rows:
        near = sorted((-cos(v, w), j) for h, j, w in rows if h == g)[:4]
        want |= {(i, j) for s, j in near if -s >= 0.2}
    assert {(r["src"], r["dst"]) for r in got.collect()} == want


def test_roles_and_samples_of_no_rows(spark):
    f = features(spark, [(1, 1, 1, "2024-01-01", 5)])
    u = cut(roles.burst_roles(cut(units.flagged(units.product_week_units(f)))))
    n = cut(roles.role_nodes(f, u))
    seeds = cut(roles.contrast_seeds(n))
    assert seeds.count() == 0 and roles.contrast_sample(seeds, roles.contrast_edges(f, seeds), 10).count() == 0
    assert roles.preserved_sample(n.where("false"), n.where("false"), 10).count() == 0
    with pytest.raises(ValueError):
        roles.preserved_sample(n, n, 0)
