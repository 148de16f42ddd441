"""What the registered queries share: the feature frame, rounding, and the SQL of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions import text_columns
from reviewloom.operators import history
from reviewloom.sources import cut, reviews, standardize, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, whole numbers to long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(out)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text features, once per document rather than once per review."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in text_columns(F.col("text")).items()])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All review features: rating, text, user and product history, interactions, group sizes, weekly shift."""
    f = history.rating_features(standardize(reviews(spark, sf_dir))).join(texts(spark, sf_dir), "doc_id", "left")
    return history.with_weekly_shift(history.group_sizes(history.interactions(history.product_history(history.user_history(f)))))


#: What histories, interactions, group sizes and shifts read of a review and its text.
STEPS = ["review_id", "user_id", "prod_id", "date", "week", "rating", "rating_bucket", "rating_direction", "extreme_rating", "short_review_flag", "word_len", "text_hash"]


def written_features(spark: SparkSession, sf_dir: str, wanted: list[str]) -> DataFrame:
    """``wanted`` columns of ``features``, as a table.

    Each history reads its rows twice and the shifts read them once more, so in one plan events are read and parsed four
    times, in as few tasks as their file has parts. Here rows are dealt out once and written before and after the history
    of users, with the columns that the rest reads.
    """
    f = history.rating_features(standardize(reviews(spark, sf_dir)).repartition("review_id")).join(texts(spark, sf_dir), "doc_id", "left")
    f = cut(f.select(*dict.fromkeys([*STEPS, *[c for c in wanted if c in f.columns]])))
    u = history.user_history(f)
    u = cut(u.select(*dict.fromkeys([*f.columns, "is_new_user_at_review_time", *[c for c in wanted if c in u.columns]])))
    return cut(history.with_weekly_shift(history.group_sizes(history.interactions(history.product_history(u))), u).select(*dict.fromkeys(wanted)))


#: The same frame as DuckDB common table expressions; ``f`` has every column.
FEATURES_SQL = r"""
r AS (
  SELECT event_id AS review_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS prod_id, CAST(ts AS DATE) AS date,
    1 + (CAST(round(value * 100) AS BIGINT) % 5) AS rating, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fake,
    event_id % (SELECT count(*) FROM documents) AS doc_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id
  FROM events
), t AS (
  SELECT doc_id, length(text) AS char_len, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_len,
    len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS tokens, length(regexp_replace(text, '\s+', '', 'g')) AS solid,
    CASE WHEN regexp_matches(text, '\d') THEN 1 ELSE 0 END AS numeric_token_flag, len(regexp_extract_all(text, '[A-Z]')) AS uppers,
    length(text) - length(replace(text, '!', '')) AS exclamation_count, length(text) - length(replace(text, '?', '')) AS question_count, md5(text) AS text_hash
  FROM documents
), a AS (
  SELECT r.*, (rating - 3) / 2.0 AS rating_norm, CASE WHEN rating <= 2 THEN -1 WHEN rating = 3 THEN 0 ELSE 1 END AS rating_direction,
    CASE WHEN rating <= 2 THEN 'low_1_2' WHEN rating = 3 THEN 'mid_3' ELSE 'high_4_5' END AS rating_bucket, CASE WHEN rating IN (1, 5) THEN 1 ELSE 0 END AS extreme_rating,
    isodow(date) - 1 AS day_of_week, month(date) AS month, CAST(date_trunc('week', date) AS DATE) AS week,
    char_len, word_len, ln(1 + word_len) AS log_word_len, CASE WHEN char_len <= 100 THEN 1 ELSE 0 END AS short_review_flag, tokens / greatest(word_len, 1) AS unique_token_ratio,
    solid / greatest(word_len, 1) AS avg_token_len, numeric_token_flag, uppers / greatest(char_len, 1) AS upper_ratio, exclamation_count, question_count, text_hash
  FROM r JOIN t USING (doc_id)
), b AS (
  SELECT *, count(*) OVER u AS prior_user_review_count, coalesce(avg(rating) OVER u, 0) AS prior_user_avg_rating, coalesce(stddev_pop(rating) OVER u, 0) AS prior_user_rating_std,
    coalesce(avg(extreme_rating) OVER u, 0) AS prior_user_extreme_ratio, coalesce(date - lag(date) OVER (PARTITION BY user_id ORDER BY date, review_id), -1) AS days_since_user_last_review,
    coalesce(date - min(date) OVER u, 0) AS prior_user_active_span_days,
    count(*) OVER p AS prior_product_review_count, coalesce(avg(rating) OVER p, 0) AS prior_product_avg_rating, coalesce(stddev_pop(rating) OVER p, 0) AS prior_product_rating_std,
    coalesce(avg(extreme_rating) OVER p, 0) AS prior_product_extreme_ratio, coalesce(date - min(date) OVER p, 0) AS product_age_days,
    count(*) OVER (PARTITION BY prod_id ORDER BY date - DATE '1970-01-01' RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS product_reviews_last_7d,
    count(*) OVER (PARTITION BY prod_id ORDER BY date - DATE '1970-01-01' RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS product_reviews_last_30d,
    count(*) OVER (PARTITION BY prod_id, date) AS product_day_review_count, count(*) OVER (PARTITION BY prod_id, week, rating_bucket) AS product_week_rating_bucket_size,
    count(*) OVER (PARTITION BY prod_id, week, text_hash) AS same_text_count_in_product_week
  FROM a WINDOW u AS (PARTITION BY user_id ORDER BY date, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    p AS (PARTITION BY prod_id ORDER BY date, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, CASE WHEN prior_user_review_count = 0 THEN 1 ELSE 0 END AS is_new_user_at_review_time,
    CASE WHEN prior_user_review_count > 0 THEN rating - prior_user_avg_rating ELSE 0 END AS rating_deviation_from_prior_user_mean,
    CASE WHEN days_since_user_last_review BETWEEN 0 AND 7 THEN 1 ELSE 0 END AS has_prior_user_review_7d, CASE WHEN days_since_user_last_review BETWEEN 0 AND 30 THEN 1 ELSE 0 END AS has_prior_user_review_30d,
    ln(1 + prior_user_review_count) AS log1p_prior_user_review_count, ln(1 + greatest(days_since_user_last_review, 0)) AS log1p_days_since_user_last_review, ln(1 + prior_user_active_span_days) AS log1p_prior_user_active_span_days,
    CASE WHEN prior_product_review_count > 0 THEN rating - prior_product_avg_rating ELSE 0 END AS rating_deviation_from_prior_product_mean,
    ln(1 + prior_product_review_count) AS log1p_prior_product_review_count, ln(1 + product_age_days) AS log1p_product_age_days,
    ln(1 + product_reviews_last_7d) AS log1p_product_reviews_last_7d, ln(1 + product_reviews_last_30d) AS log1p_product_reviews_last_30d,
    CASE WHEN prior_product_review_count <= 30 THEN 1 ELSE 0 END AS weak_product_prior_count_flag FROM b
), d AS (
  SELECT *, abs(rating_deviation_from_prior_user_mean) AS abs_rating_deviation_from_prior_user_mean, rating_deviation_from_prior_product_mean / (prior_product_review_count + 1) AS rating_impact_signed,
    abs(rating_deviation_from_prior_product_mean / (prior_product_review_count + 1)) AS rating_impact_abs, is_new_user_at_review_time * short_review_flag * extreme_rating AS new_user_short_extreme_flag,
    short_review_flag * weak_product_prior_count_flag AS short_weak_product_flag FROM c
), w0 AS (
  SELECT prod_id, rating_direction, week, (week - DATE '1970-01-05') // 7 AS no, count(*) AS c, sum(is_new_user_at_review_time) AS new, sum(short_review_flag) AS short, sum(word_len) AS words FROM d GROUP BY ALL
), w1 AS (
  SELECT *, coalesce(sum(c) OVER w, 0) AS pc, coalesce(sum(new) OVER w, 0) AS pnew, coalesce(sum(short) OVER w, 0) AS pshort, coalesce(sum(words) OVER w, 0) AS pwords FROM w0
  WINDOW w AS (PARTITION BY prod_id, rating_direction ORDER BY no RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)
), w2 AS (SELECT prod_id, week, no, sum(c) AS total FROM w0 GROUP BY ALL
), w3 AS (SELECT prod_id, week, total, coalesce(sum(total) OVER (PARTITION BY prod_id ORDER BY no RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS ptotal FROM w2
), w4 AS (
  SELECT prod_id, rating_direction, week, ln(1 + c) - ln(1 + pc / 4) AS same_dir_log_count_lift_4w, ln(1 + total) - ln(1 + ptotal / 4) AS total_log_count_lift_4w,
    c / total - CASE WHEN ptotal > 0 THEN pc / ptotal ELSE 0 END AS direction_concentration_lift_4w, new / c - CASE WHEN pc > 0 THEN pnew / pc ELSE 0 END AS new_user_ratio_lift_4w,
    short / c - CASE WHEN pc > 0 THEN pshort / pc ELSE 0 END AS short_review_ratio_lift_4w,
    CASE WHEN pwords > 0 THEN greatest(-1, least(1, (pwords / pc - words / c) / (pwords / pc))) ELSE 0 END AS word_len_drop_ratio_4w FROM w1 JOIN w3 USING (prod_id, week)
), f AS (
  SELECT d.*, extreme_rating * rating_impact_abs AS extreme_rating_impact_abs, is_new_user_at_review_time * rating_impact_abs AS new_user_rating_impact_abs, w4.* EXCLUDE (prod_id, rating_direction, week),
    greatest(same_dir_log_count_lift_4w, 0) + greatest(direction_concentration_lift_4w, 0) + greatest(new_user_ratio_lift_4w, 0) + greatest(short_review_ratio_lift_4w, 0) + greatest(word_len_drop_ratio_4w, 0) AS abuse_burst_behavior_score_4w
  FROM d JOIN w4 USING (prod_id, rating_direction, week)
)"""

WHOLE = {"review_id", "user_id", "prod_id", "rating", "is_fake", "rating_direction", "extreme_rating", "day_of_week", "month", "char_len", "word_len", "short_review_flag", "numeric_token_flag", "exclamation_count", "question_count", "prior_user_review_count", "days_since_user_last_review", "prior_user_active_span_days", "prior_product_review_count", "product_age_days", "product_reviews_last_7d", "product_reviews_last_30d", "product_day_review_count", "product_week_rating_bucket_size", "same_text_count_in_product_week", "is_new_user_at_review_time", "has_prior_user_review_7d", "has_prior_user_review_30d", "weak_product_prior_count_flag", "new_user_short_extreme_flag", "short_weak_product_flag"}
PLAIN = {"date", "week", "rating_bucket", "text_hash", "split"}


def sql_columns(names: list[str]) -> str:
    return ", ".join(n if n in PLAIN else f"CAST({n} AS BIGINT) AS {n}" if n in WHOLE else f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


def register_columns(name: str, names: list[str]) -> None:
    """A query of some columns of the feature frame; Catalyst prunes the windows that they do not need."""
    names = ["review_id", *names]
    register(name, lambda spark, sf_dir: rounded(features(spark, sf_dir).select(*names)), f"WITH {FEATURES_SQL} SELECT {sql_columns(names)} FROM f")
