"""Features of reviews that look at earlier reviews only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions import clip, day_number, safe_ratio, week_of


def rating_features(df: DataFrame) -> DataFrame:
    r = F.col("rating")
    direction = F.when(r <= 2, -1).when(r == 3, 0).when(r >= 4, 1).otherwise(0)
    bucket = F.when(r <= 2, "low_1_2").when(r == 3, "mid_3").when(r >= 4, "high_4_5").otherwise("unknown")
    return df.withColumns({"rating_norm": (r - 3) / 2.0, "rating_direction": direction.cast("long"), "rating_bucket": bucket, "extreme_rating": r.isin(1, 5).cast("long"), "day_of_week": F.weekday("date").cast("long"), "month": F.month("date").cast("long"), "week": week_of(F.col("date"))})


#: What ``_prior`` joins to rows.
PAST = [f"_past_{n}" for n in ("n", "sum", "square", "extreme", "first", "last", "days")]


def _inside(key: str):
    """Rows of the same key and week before this one in (date, review_id) order: same-day rows of smaller id count."""
    return Window.partitionBy(key, "week").orderBy("date", "review_id").rowsBetween(Window.unboundedPreceding, -1)


def _weeks(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """(key, week, ...): what a key's weeks before hold: rows, sums, first and last date; and for each weekday of the week
    (_days) the rows of the 7 and 30 days before it.

    A key is never one task: its rows are summed by day where they lie, and only days and weeks, as many as the calendar
    has, are put in order.
    """
    days = df.groupBy(key, "week", "date").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    last = lambda n: F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(day_number(F.col("date"))).rangeBetween(-n, -1)), F.lit(0))
    days = days.withColumn("_last_days", F.struct(last(7).alias("d7"), last(30).alias("d30")))
    each = F.array(*[F.max(F.when(F.weekday("date") == i, F.col("_last_days"))) for i in range(7)])
    weeks = days.groupBy(key, "week").agg(F.sum("_n").alias("_n"), *[F.sum(f"_{n}").alias(f"_{n}") for n in sums], F.min("date").alias("_first"), F.max("date").alias("_last"), each.alias("_days"))
    before = Window.partitionBy(key).orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_{n}").over(before).alias(f"_past_{n}") for n in ("n", *sums)]
    return weeks.select(key, "week", *carried, F.min("_first").over(before).alias("_past_first"), F.max("_last").over(before).alias("_past_last"), F.col("_days").alias("_past_days"))


def _prior(df: DataFrame, key: str, sums: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """(rows beside their key's weeks before, expressions of prior n, sums, first and last date): a prefix over weeks and
    a window inside each, so that a hot key is as many tasks as it has weeks."""
    w = _inside(key)
    out = df.join(_weeks(df, key, sums), [key, "week"], "left")
    whole = {n: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.coalesce(F.col(f"_past_{n}"), F.lit(0)) for n, c in {"n": F.lit(1), **sums}.items()}
    return out, {**whole, "first": F.least(F.min("date").over(w), F.col("_past_first")), "last": F.greatest(F.max("date").over(w), F.col("_past_last"))}


def _moments() -> dict[str, Column]:
    r = F.col("rating")
    return {"sum": r, "square": r * r, "extreme": F.col("extreme_rating")}


def _rating_prior(p: dict[str, Column], who: str) -> dict[str, Column]:
    """Count, mean, population deviation and share of extremes of prior ratings, 0 where there are none."""
    n = p["n"]
    some = lambda x: F.when(n > 0, x).otherwise(0.0)
    spread = F.greatest(n * p["square"] - p["sum"] * p["sum"], F.lit(0))
    return {f"prior_{who}_review_count": n.cast("long"), f"prior_{who}_avg_rating": some(p["sum"] / n), f"prior_{who}_rating_std": some(F.sqrt(spread) / n), f"prior_{who}_extreme_ratio": some(p["extreme"] / n)}


def user_history(df: DataFrame) -> DataFrame:
    """Prior count, rating mean, deviation and extremes, gaps and span of the review's user."""
    df, p = _prior(df, "user_id", _moments())
    df = df.withColumns(
        {
            **_rating_prior(p, "user"),
            "days_since_user_last_review": F.coalesce(F.datediff("date", p["last"]), F.lit(-1)).cast("long"),
            "prior_user_active_span_days": F.coalesce(F.datediff("date", p["first"]), F.lit(0)).cast("long"),
        }
    ).drop(*PAST)
    n, gap, span = F.col("prior_user_review_count"), F.col("days_since_user_last_review"), F.col("prior_user_active_span_days")
    dev = F.when(n > 0, F.col("rating") - F.col("prior_user_avg_rating")).otherwise(0.0)
    return df.withColumns(
        {
            "is_new_user_at_review_time": (n == 0).cast("long"),
            "rating_deviation_from_prior_user_mean": dev,
            "abs_rating_deviation_from_prior_user_mean": F.abs(dev),
            "has_prior_user_review_7d": gap.between(0, 7).cast("long"),
            "has_prior_user_review_30d": gap.between(0, 30).cast("long"),
            "log1p_prior_user_review_count": F.log1p(n),
            "log1p_days_since_user_last_review": F.log1p(F.greatest(gap, F.lit(0))),
            "log1p_prior_user_active_span_days": F.log1p(span),
        }
    )


def product_history(df: DataFrame) -> DataFrame:
    """Prior reputation of the review's product, and its reviews in the 7 and 30 days before today."""
    df, p = _prior(df, "prod_id", _moments())
    last = lambda days: F.coalesce(F.get("_past_days", F.weekday("date"))[f"d{days}"], F.lit(0))
    df = df.withColumns(
        {
            **_rating_prior(p, "product"),
            "product_age_days": F.coalesce(F.datediff("date", p["first"]), F.lit(0)).cast("long"),
            "product_reviews_last_7d": last(7),
            "product_reviews_last_30d": last(30),
        }
    ).drop(*PAST)
    n = F.col("prior_product_review_count")
    dev = F.when(n > 0, F.col("rating") - F.col("prior_product_avg_rating")).otherwise(0.0)
    return df.withColumns(
        {
            "rating_deviation_from_prior_product_mean": dev,
            "rating_impact_signed": dev / (n + 1),
            "rating_impact_abs": F.abs(dev / (n + 1)),
            "log1p_prior_product_review_count": F.log1p(n),
            "log1p_product_age_days": F.log1p("product_age_days"),
            "log1p_product_reviews_last_7d": F.log1p("product_reviews_last_7d"),
            "log1p_product_reviews_last_30d": F.log1p("product_reviews_last_30d"),
        }
    )


def interactions(df: DataFrame) -> DataFrame:
    new, short, extreme = (F.col(c) == 1 for c in ("is_new_user_at_review_time", "short_review_flag", "extreme_rating"))
    weak = F.col("prior_product_review_count") <= 30
    return df.withColumns(
        {
            "weak_product_prior_count_flag": weak.cast("long"),
            "new_user_short_extreme_flag": (new & short & extreme).cast("long"),
            "short_weak_product_flag": (short & weak).cast("long"),
            "extreme_rating_impact_abs": F.col("extreme_rating") * F.col("rating_impact_abs"),
            "new_user_rating_impact_abs": F.col("is_new_user_at_review_time") * F.col("rating_impact_abs"),
        }
    )


def group_sizes(df: DataFrame) -> DataFrame:
    """Sizes of groups inside a product's week; a day is given with its week, so rows dealt out by product and week stay."""
    over = lambda *keys: F.count("*").over(Window.partitionBy(*keys))
    return df.withColumns({"product_day_review_count": over("prod_id", "week", "date"), "product_week_rating_bucket_size": over("prod_id", "week", "rating_bucket"), "same_text_count_in_product_week": over("prod_id", "week", "text_hash")})


LIFTS = ["same_dir_log_count_lift_4w", "total_log_count_lift_4w", "direction_concentration_lift_4w", "new_user_ratio_lift_4w", "short_review_ratio_lift_4w", "word_len_drop_ratio_4w"]
SCORE = "abuse_burst_behavior_score_4w"


def weekly_shifts(df: DataFrame) -> DataFrame:
    """(prod_id, week, shifts): how this week's reviews of a product in each direction differ from its four weeks before.

    shifts has an entry for the directions -1, 0 and 1. Weeks without reviews count as zero: the frame ranges over week
    numbers, so no grid of weeks is made. All directions are counted in one pass, and one window over a product's weeks
    sums what came before.
    """
    of = {"c": F.lit(1), "new": F.col("is_new_user_at_review_time"), "short": F.col("short_review_flag"), "words": F.col("word_len")}
    counted = [F.sum(F.when(F.col("rating_direction") == d, x).otherwise(0)).alias(f"{n}_{d + 1}") for d in (-1, 0, 1) for n, x in of.items()]
    weeks = df.groupBy("prod_id", "week").agg(*counted, F.count("*").alias("total"))
    no = (F.datediff("week", F.lit("1970-01-05")) / 7).cast("long")
    w = Window.partitionBy("prod_id").orderBy(no).rangeBetween(-4, -1)
    names = [*(f"{n}_{i}" for i in range(3) for n in of), "total"]
    weeks = weeks.select("prod_id", "week", *names, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"p_{n}") for n in names])

    def shift(i: int) -> Column:
        now, past, total, seen = F.col(f"c_{i}"), F.col(f"p_c_{i}"), F.col("total"), F.col("p_total")
        part = lambda n: safe_ratio(F.col(f"{n}_{i}"), now) - safe_ratio(F.col(f"p_{n}_{i}"), past)
        mean_now, mean_past = safe_ratio(F.col(f"words_{i}"), now), safe_ratio(F.col(f"p_words_{i}"), past)
        lifts = [
            F.log1p(now) - F.log1p(past / 4),
            F.log1p(total) - F.log1p(seen / 4),
            safe_ratio(now, total) - safe_ratio(past, seen),
            part("new"),
            part("short"),
            F.when(mean_past > 0, clip((mean_past - mean_now) / mean_past, -1.0, 1.0)).otherwise(0.0),
        ]
        up = [F.greatest(x, F.lit(0.0)) for x, n in zip(lifts, LIFTS, strict=True) if n != "total_log_count_lift_4w"]
        return F.struct(*[x.alias(n) for x, n in zip(lifts, LIFTS, strict=True)], sum(up[1:], up[0]).alias(SCORE))

    return weeks.select("prod_id", "week", F.array(*[shift(i) for i in range(3)]).alias("shifts"))


def with_weekly_shift(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows with the shift of their product, week and direction; shifts are counted on ``rows``, if these are the same rows
    as a table."""
    own = F.get("shifts", F.col("rating_direction") + 1)
    met = df.join(weekly_shifts(df if rows is None else rows), ["prod_id", "week"], "left")
    return met.withColumns({n: F.coalesce(own[n], F.lit(0.0)) for n in (*LIFTS, SCORE)}).drop("shifts")


def dense_index(df: DataFrame, name: str = "node_idx") -> DataFrame:
    """Numbers 0 to n - 1 by (date, review_id): rows per day are summed, then numbered inside their day."""
    counts = df.groupBy("date").agg(F.count("*").alias("_n"))
    first = counts.select("date", (F.sum("_n").over(Window.orderBy("date")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("date").orderBy("review_id")) - 1
    return df.withColumn("_inside", inside).join(first, "date").withColumn(name, F.col("_first") + F.col("_inside")).drop("_first", "_inside")


def without_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows equal in ``keys``, the one of smallest review_id."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("review_id"))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
