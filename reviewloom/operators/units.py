"""Product-week units, their flags, selection and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.stats import quantiles
from reviewloom.sources import cut

SHIFTS = ["same_dir_log_count_lift_4w", "total_log_count_lift_4w", "direction_concentration_lift_4w", "new_user_ratio_lift_4w", "short_review_ratio_lift_4w", "word_len_drop_ratio_4w", "abuse_burst_behavior_score_4w"]
#: Columns that ``product_week_units`` reads.
UNIT = ["prod_id", "week", "user_id", "product_reviews_last_30d", "is_new_user_at_review_time", "extreme_rating", "short_review_flag", "prior_product_review_count", "rating_deviation_from_prior_product_mean", "prior_product_rating_std", "rating_impact_abs", "extreme_rating_impact_abs", "same_text_count_in_product_week", "is_fake", "rating_direction", *SHIFTS]
#: Fixed values, this map and the next: sources of the quantile flags in absolute mode.
ABSOLUTE = {"review_growth_flag": "growth_ratio_30d", "new_user_ratio_flag": "new_user_ratio", "extreme_rating_ratio_flag": "extreme_ratio", "short_review_ratio_flag": "short_ratio", "weak_product_flag": "weak_product_score", "rating_deviation_flag": "mean_abs_rating_dev", "rating_direction_concentration_flag": "rating_direction_concentration"}
#: In relative mode; names and sources no longer agree, which is kept.
RELATIVE = {"review_growth_flag": "same_dir_log_count_lift_4w_median", "new_user_ratio_flag": "new_user_ratio_lift_4w_median", "extreme_rating_ratio_flag": "abuse_burst_behavior_score_4w_median", "short_review_ratio_flag": "short_review_ratio_lift_4w_median", "weak_product_flag": "word_len_drop_ratio_4w_median", "rating_deviation_flag": "standardized_mean_abs_rating_dev", "rating_direction_concentration_flag": "direction_concentration_lift_4w_median"}


def product_week_units(f: DataFrame) -> DataFrame:
    """One row per (prod_id, week): counts, medians and means of its reviews' features, and ratios of these.

    A user is counted at one of its rows: beside a distinct count every median would first be taken per user of a unit.
    """
    n = F.count("*")
    nth = F.row_number().over(Window.partitionBy("prod_id", "week", "user_id").orderBy("user_id"))
    f = f.withColumn("_user", (nth == 1) & F.col("user_id").isNotNull())
    of = lambda d: F.count_if(F.col("rating_direction") == d)
    units = f.groupBy("prod_id", "week").agg(
        n.alias("n_reviews"),
        F.count_if("_user").alias("n_users"),
        F.median("product_reviews_last_30d").alias("growth_base_30d"),
        F.avg("is_new_user_at_review_time").alias("new_user_ratio"),
        F.avg("extreme_rating").alias("extreme_ratio"),
        F.avg("short_review_flag").alias("short_ratio"),
        F.median("prior_product_review_count").alias("prior_product_review_count_median"),
        F.avg(F.abs("rating_deviation_from_prior_product_mean")).alias("mean_abs_rating_dev"),
        F.median("prior_product_rating_std").alias("prior_product_rating_std_median"),
        F.avg("rating_impact_abs").alias("rating_impact_abs_mean"),
        F.avg("extreme_rating_impact_abs").alias("extreme_rating_impact_abs_mean"),
        F.max((F.col("same_text_count_in_product_week") >= 2).cast("long")).alias("local_template_repeat_flag"),
        F.avg((F.col("same_text_count_in_product_week") >= 2).cast("long")).alias("local_template_repeat_ratio"),
        F.avg("is_fake").alias("fake_rate"),
        F.sum("is_fake").alias("fake_count"),
        *[F.median(c).alias(f"{c}_median") for c in SHIFTS],
        (F.greatest(of(-1), of(0), of(1)) / n).alias("rating_direction_concentration"),
    )
    prior = F.col("prior_product_review_count_median")
    return units.withColumns(
        {
            "growth_ratio_30d": F.col("n_reviews") / (F.col("growth_base_30d") / 30 * 7 + 1.0),
            "weak_product_score": 1 / F.log1p(prior + 1),
            "current_week_share_of_history": F.col("n_reviews") / (F.greatest(prior, F.lit(0.0)) + 1.0),
        }
    )


def flagged(units: DataFrame, mode: str = "absolute", quantile: float = 0.75, min_reviews: int = 10, min_users: int = 8, min_flags: int = 2) -> DataFrame:
    """Adds base_candidate, seven quantile flags, sampling_flag_count and selected.

    Thresholds are exact quantiles over base candidates only, one row joined to all units; without a base candidate no
    quantile flag is set and nothing is selected.
    """
    if mode not in ("absolute", "relative"):
        raise ValueError(f"unknown flag mode {mode!r}")
    sources = ABSOLUTE if mode == "absolute" else RELATIVE
    # The units are written once, as cutoffs and flags read them several times.
    units = cut(units.withColumn("base_candidate", (F.col("n_reviews") >= min_reviews) & (F.col("n_users") >= min_users)))
    base = units.where("base_candidate")
    if mode == "relative":
        std = F.col("prior_product_rating_std_median")
        positive = quantiles(base, {"_std": (F.when(std > 0, std), 0.25)}).select(F.greatest(F.coalesce("_std", F.lit(1.0)), F.lit(1e-6)).alias("_floor"))
        scaled = lambda u: u.crossJoin(F.broadcast(positive)).withColumn("standardized_mean_abs_rating_dev", F.col("mean_abs_rating_dev") / F.greatest(F.col("prior_product_rating_std_median"), F.col("_floor"))).drop("_floor")
        units, base = scaled(units), scaled(base)
    cuts = quantiles(base, {f"_{flag}": (F.col(c), quantile) for flag, c in sources.items()})  # one row
    units = units.crossJoin(F.broadcast(cuts)).withColumns({flag: F.coalesce((F.col(c) >= F.col(f"_{flag}")).cast("long"), F.lit(0).cast("long")) for flag, c in sources.items()})
    count: Column = sum((F.col(flag) for flag in sources), F.lit(0)) + F.col("local_template_repeat_flag")
    units = units.withColumn("sampling_flag_count", count.cast("long"))
    return units.withColumn("selected", F.col("base_candidate") & (F.col("sampling_flag_count") >= min_flags)).drop(*[f"_{flag}" for flag in sources])


def sampled_nodes(f: DataFrame, units: DataFrame) -> DataFrame:
    """All reviews of the selected units."""
    return f.join(units.where("selected").select("prod_id", "week"), ["prod_id", "week"], "left_semi")


def positions(nodes: DataFrame) -> DataFrame:
    """Adds pos (from 1, by date and id) and n; counts per day come first, so no task holds all rows."""
    days = nodes.groupBy("date").agg(F.count("*").alias("_c"))
    first = days.select("date", (F.sum("_c").over(Window.orderBy("date")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("date").orderBy("review_id"))
    return nodes.withColumn("_inside", inside).join(first, "date").withColumn("pos", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def temporal_split(nodes: DataFrame, train: float = 0.64, valid: float = 0.16) -> DataFrame:
    """Cut by position, truncated: reviews of one day may fall on both sides."""
    p = positions(nodes)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * valid)
    return p.withColumn("split", F.when(F.col("pos") <= a, "train").when(F.col("pos") <= a + b, "valid").otherwise("test")).drop("pos", "n")


def date_split(nodes: DataFrame, train: float = 0.8) -> DataFrame:
    """Cut by date: all reviews of the cut's day go to training."""
    p = positions(nodes)
    cut = p.where(F.col("pos") == F.greatest(F.floor(F.col("n") * train), F.lit(1))).agg(F.max("date").alias("_cut"))
    return p.crossJoin(F.broadcast(cut)).withColumn("split", F.when(F.col("date") <= F.col("_cut"), "train").otherwise("test")).drop("pos", "n", "_cut")


def stratified_split(nodes: DataFrame, seed: int = 42, train: float = 0.64, valid: float = 0.16) -> DataFrame:
    """Within each label, in order of a hash of seed and id; counts per hash prefix come first."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("review_id").cast("string")))
    hashed = nodes.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    counts = hashed.groupBy("is_fake", "_b").agg(F.count("*").alias("_c"))
    first = counts.select("is_fake", "_b", (F.sum("_c").over(Window.partitionBy("is_fake").orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("is_fake")).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("is_fake", "_b").orderBy("_h"))
    p = hashed.withColumn("_i", inside).join(first, ["is_fake", "_b"]).withColumn("_pos", F.col("_before") + F.col("_i"))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * valid)
    return p.withColumn("split", F.when(F.col("_pos") <= a, "train").when(F.col("_pos") <= a + b, "valid").otherwise("test")).drop("_h", "_b", "_i", "_before", "_n", "_pos")


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("nodes"), F.sum("is_fake").alias("fake"), F.avg("is_fake").alias("fake_rate"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
