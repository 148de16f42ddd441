"""Queries of review features, units and splits."""

from __future__ import annotations


from reviewloom.operators import history, units
from reviewloom.plans.base import FEATURES_SQL, features, register, register_columns, rounded
from reviewloom.sources import reviews, standardize

for _name, _columns in {
    "prj02": ["rating_norm", "rating_direction", "rating_bucket", "extreme_rating"],
    "prj03": ["weak_product_prior_count_flag", "new_user_short_extreme_flag", "short_weak_product_flag", "extreme_rating_impact_abs", "new_user_rating_impact_abs"],
    "sc01": ["char_len"], "sc02": ["word_len"], "sc03": ["log_word_len"], "sc04": ["short_review_flag"], "sc06": ["unique_token_ratio"], "sc07": ["avg_token_len"], "sc08": ["numeric_token_flag"],
    "sc09": ["upper_ratio"], "sc10": ["exclamation_count", "question_count"], "sc11": ["text_hash"], "sc14": ["day_of_week", "month"], "sc15": ["week"],
    "wn01": ["prior_user_review_count", "prior_user_avg_rating", "prior_user_rating_std", "prior_user_extreme_ratio", "is_new_user_at_review_time"],
    "wn02": ["rating_deviation_from_prior_user_mean", "abs_rating_deviation_from_prior_user_mean"],
    "wn03": ["days_since_user_last_review", "has_prior_user_review_7d", "has_prior_user_review_30d"],
    "wn04": ["prior_user_active_span_days"],
    "wn05": ["log1p_prior_user_review_count", "log1p_days_since_user_last_review", "log1p_prior_user_active_span_days", "log1p_prior_product_review_count", "log1p_product_age_days", "log1p_product_reviews_last_7d", "log1p_product_reviews_last_30d"],
    "wn06": ["prior_product_review_count", "prior_product_avg_rating", "prior_product_rating_std", "prior_product_extreme_ratio"],
    "wn07": ["rating_deviation_from_prior_product_mean", "rating_impact_signed", "rating_impact_abs", "product_age_days"],
    "wn08": ["product_reviews_last_7d", "product_reviews_last_30d"],
    "wn10": units.SHIFTS,
    "ag06": ["product_day_review_count", "product_week_rating_bucket_size", "same_text_count_in_product_week"],
}.items():
    register_columns(_name, _columns)

register("prj01", lambda s, d: standardize(reviews(s, d)).select("review_id", "user_id", "prod_id", "rating", "date", "is_fake"), f"WITH {FEATURES_SQL} SELECT review_id, user_id, prod_id, rating, date, CAST(is_fake AS BIGINT) AS is_fake FROM r")
register("wn12", lambda s, d: rounded(history.dense_index(standardize(reviews(s, d))).select("review_id", "node_idx")), f"WITH {FEATURES_SQL} SELECT review_id, row_number() OVER (ORDER BY date, review_id) - 1 AS node_idx FROM r")
register("wn13", lambda s, d: history.without_repeats(standardize(reviews(s, d)), ["user_id", "date", "rating"]).select("review_id"), f"WITH {FEATURES_SQL} SELECT review_id FROM r QUALIFY row_number() OVER (PARTITION BY user_id, date, rating ORDER BY review_id) = 1")
register(
    "wn20",
    lambda s, d: rounded(_average_ranks(features(s, d).select("review_id", "word_len"), "word_len")),
    f"WITH {FEATURES_SQL} SELECT review_id, round(rank() OVER (ORDER BY word_len) + (count(*) OVER (PARTITION BY word_len) - 1) / 2, 6) AS avg_rank FROM f",
)


def _average_ranks(df, column):
    from reviewloom.operators.stats import average_ranks

    return average_ranks(df, column).select("review_id", "avg_rank")


_UNITS = f"""WITH {FEATURES_SQL}, q AS (
  SELECT prod_id, week, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, median(product_reviews_last_30d) AS growth_base_30d, avg(is_new_user_at_review_time) AS new_user_ratio,
    avg(extreme_rating) AS extreme_ratio, avg(short_review_flag) AS short_ratio, median(prior_product_review_count) AS prior_product_review_count_median,
    avg(abs(rating_deviation_from_prior_product_mean)) AS mean_abs_rating_dev, median(prior_product_rating_std) AS prior_product_rating_std_median, avg(rating_impact_abs) AS rating_impact_abs_mean,
    avg(extreme_rating_impact_abs) AS extreme_rating_impact_abs_mean, max(CASE WHEN same_text_count_in_product_week >= 2 THEN 1 ELSE 0 END) AS local_template_repeat_flag,
    avg(CASE WHEN same_text_count_in_product_week >= 2 THEN 1 ELSE 0 END) AS local_template_repeat_ratio, avg(is_fake) AS fake_rate, sum(is_fake) AS fake_count,
    {', '.join(f'median({c}) AS {c}_median' for c in units.SHIFTS)},
    greatest(count(*) FILTER (rating_direction = -1), count(*) FILTER (rating_direction = 0), count(*) FILTER (rating_direction = 1)) / count(*) AS rating_direction_concentration
  FROM f GROUP BY prod_id, week
), u AS (
  SELECT *, n_reviews / (growth_base_30d / 30 * 7 + 1.0) AS growth_ratio_30d, 1 / ln(1 + prior_product_review_count_median + 1) AS weak_product_score,
    n_reviews / (greatest(prior_product_review_count_median, 0) + 1.0) AS current_week_share_of_history, n_reviews >= 10 AND n_users >= 8 AS base_candidate FROM q
), x AS (
  SELECT *, mean_abs_rating_dev / greatest(prior_product_rating_std_median, (SELECT greatest(coalesce(quantile_cont(prior_product_rating_std_median, 0.25), 1), 1e-6) FROM u WHERE base_candidate AND prior_product_rating_std_median > 0)) AS standardized_mean_abs_rating_dev FROM u
)"""
_UNIT_WHOLE = ["n_reviews", "n_users", "local_template_repeat_flag", "fake_count"]


def _unit_sql(columns: list[str]) -> str:
    return _UNITS + " SELECT prod_id, week, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in _UNIT_WHOLE else f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns) + " FROM u"


for _name, _columns in {
    "ag01": ["n_reviews", "n_users", "growth_base_30d", "new_user_ratio", "extreme_ratio", "short_ratio", "prior_product_review_count_median", "mean_abs_rating_dev", "prior_product_rating_std_median", "rating_impact_abs_mean", "extreme_rating_impact_abs_mean", "local_template_repeat_flag", "local_template_repeat_ratio", "fake_rate", "fake_count"],
    "ag02": [f"{c}_median" for c in units.SHIFTS],
    "ag03": ["rating_direction_concentration"],
    "ag04": ["growth_ratio_30d", "weak_product_score", "current_week_share_of_history"],
}.items():
    register(_name, lambda s, d, c=_columns: rounded(units.product_week_units(features(s, d)).select("prod_id", "week", *c)), _unit_sql(_columns))


def _flag_sql(sources: dict[str, str]) -> str:
    flags = ", ".join(f"CASE WHEN {c} >= (SELECT quantile_cont({c}, 0.75) FROM x WHERE base_candidate) THEN 1 ELSE 0 END AS {f}" for f, c in sources.items())
    return f"{_UNITS}, y AS (SELECT *, {flags} FROM x), z AS (SELECT *, {' + '.join(sources)} + local_template_repeat_flag AS sampling_flag_count FROM y), v AS (SELECT *, base_candidate AND sampling_flag_count >= 2 AS selected FROM z)"


for _name, _mode, _sources in (("sm02", "absolute", units.ABSOLUTE), ("sm03", "relative", units.RELATIVE)):
    register(
        _name,
        lambda s, d, m=_mode, k=tuple(_sources): rounded(units.flagged(units.product_week_units(features(s, d)), m).select("prod_id", "week", *k, "sampling_flag_count", "selected")),
        _flag_sql(_sources) + f" SELECT prod_id, week, {', '.join(f'CAST({f} AS BIGINT) AS {f}' for f in _sources)}, CAST(sampling_flag_count AS BIGINT) AS sampling_flag_count, selected FROM v",
    )


def _sampled(s, d):
    f = features(s, d)
    return units.sampled_nodes(f, units.flagged(units.product_week_units(f), "relative"))


_SAMPLED = _flag_sql(units.RELATIVE) + ", n AS (SELECT f.* FROM f JOIN v USING (prod_id, week) WHERE selected), m AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM n)"
_SPLIT = "CASE WHEN pos <= floor(n * 0.64) THEN 'train' WHEN pos <= floor(n * 0.64) + floor(n * 0.16) THEN 'valid' ELSE 'test' END"
register("sm04", lambda s, d: _sampled(s, d).select("review_id", "prod_id", "week"), _SAMPLED + " SELECT review_id, prod_id, week FROM n")
register("sm11", lambda s, d: rounded(history.dense_index(_sampled(s, d), "sampled_node_idx").select("review_id", "sampled_node_idx")), _SAMPLED + " SELECT review_id, pos - 1 AS sampled_node_idx FROM m")
register("sm12", lambda s, d: units.temporal_split(_sampled(s, d)).select("review_id", "split"), _SAMPLED + f" SELECT review_id, {_SPLIT} AS split FROM m")
register("sm14", lambda s, d: units.date_split(standardize(reviews(s, d))).select("review_id", "split"), f"WITH {FEATURES_SQL}, m AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM r) SELECT review_id, CASE WHEN date <= (SELECT max(date) FROM m WHERE pos = greatest(floor(n * 0.8), 1)) THEN 'train' ELSE 'test' END AS split FROM m")
register(
    "sm13",
    lambda s, d: units.stratified_split(standardize(reviews(s, d))).select("review_id", "split"),
    f"WITH {FEATURES_SQL}, m AS (SELECT review_id, row_number() OVER (PARTITION BY is_fake ORDER BY md5('42|' || review_id)) AS pos, count(*) OVER (PARTITION BY is_fake) AS n FROM r) SELECT review_id, {_SPLIT} AS split FROM m",
)
register(
    "ag21",
    lambda s, d: rounded(units.split_summary(units.temporal_split(_sampled(s, d)))),
    _SAMPLED + f", k AS (SELECT *, {_SPLIT} AS split FROM m) SELECT split, count(*) AS nodes, CAST(sum(is_fake) AS BIGINT) AS fake, round(avg(is_fake), 6) AS fake_rate, min(date) AS first_date, max(date) AS last_date FROM k GROUP BY split",
)
