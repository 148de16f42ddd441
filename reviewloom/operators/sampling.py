"""Choice of reviews under a budget: shock seeds with context, whole normal units, and stratified takes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.stats import quantiles
from reviewloom.sources import cut

#: Quantiles of the shock impact, tried in this order until the chosen reviews fit the budget.
LADDER = (0.0, 0.25, 0.50, 0.60, 0.70, 0.75, 0.80, 0.90, 0.95)

#: Columns that ``shock_reach`` reads.
REACH = ["review_id", "user_id", "prod_id", "date", "rating_direction", "prior_product_review_count", "rating_deviation_from_prior_product_mean", "rating_impact_abs"]


def shock_reach(f: DataFrame, excluded: DataFrame | None = None, max_prior: int = 30, min_dev: float = 1.0, product_context: int = 5, user_context: int = 3) -> DataFrame:
    """Adds impact (of a shock seed, else null) and reach: the largest impact for which the review is taken.

    A review is taken with a seed, or as one of the reviews of the same product or user just before a seed. So the
    largest impact among itself and the next few of its product and user decides for every threshold at once, and the
    whole ladder costs one pass. Reviews of ``excluded`` (review_id) are no seeds.
    """
    seed = F.col("prior_product_review_count").between(1, max_prior) & (F.abs("rating_deviation_from_prior_product_mean") >= min_dev) & (F.col("rating_direction") != 0)
    if excluded is not None:
        f = f.join(excluded.select("review_id", F.lit(True).alias("_out")), "review_id", "left")
        seed = seed & F.col("_out").isNull()
    f = f.withColumn("impact", F.when(seed, F.round("rating_impact_abs", 12)))
    ahead = lambda key, k: F.max("impact").over(Window.partitionBy(key).orderBy("date", "review_id").rowsBetween(1, k))
    return f.withColumn("reach", F.greatest("impact", ahead("prod_id", product_context), ahead("user_id", user_context))).drop("_out")


def ladder_threshold(reached: DataFrame, max_nodes: int, taken: int = 0) -> tuple[float | None, float | None]:
    """The first impact quantile at which all that is reached fits beside ``taken``, or null; and the last rung's.

    Two rows of nine numbers are fetched.
    """
    found = quantiles(reached, {f"c{i}": (F.col("impact"), q) for i, q in enumerate(LADDER)}).first()
    cuts = [found[f"c{i}"] for i in range(len(LADDER))]
    if cuts[0] is None:
        return None, None
    counts = reached.agg(*[F.count_if(F.col("reach") >= c).alias(f"n{i}") for i, c in enumerate(cuts)]).first()
    return next((c for i, c in enumerate(cuts) if counts[i] + taken <= max_nodes), None), cuts[-1]


def shock_context(f: DataFrame, max_nodes: int, legacy: DataFrame | None = None, **seeds) -> DataFrame:
    """(review_id): seeds and their context under a budget, with ``legacy`` reviews first if given.

    If no rung fits, the seeds of the last rung fill what the budget leaves, largest impact first, without context. What
    is reached is written once, as the ladder, the choice and all that takes up the choice read it.
    """
    reached = cut(shock_reach(f, legacy, **seeds).select("review_id", "date", "impact", "reach"))
    if legacy is not None:  # context may fall on legacy reviews, which count once
        reached = reached.join(legacy.select("review_id"), "review_id", "left_anti")
    taken = legacy.count() if legacy is not None else 0
    if taken > max_nodes:
        raise ValueError(f"{taken} reviews of selected units exceed {max_nodes}")
    rung, last = ladder_threshold(reached, max_nodes, taken)
    if rung is None:
        chosen = reached.where(F.col("impact") >= F.lit(last).cast("double")).orderBy(F.desc("impact"), "date", "review_id").limit(max_nodes - taken)
    else:
        chosen = reached.where(F.col("reach") >= rung)
    chosen = chosen.select("review_id")
    return chosen if legacy is None else chosen.unionByName(legacy.select("review_id"))


def normal_units(units: DataFrame) -> DataFrame:
    """Base units of low direction concentration and long history, by the medians of base units."""
    base = units.where("base_candidate")
    cuts = base.agg(F.median("rating_direction_concentration").alias("_d"), F.median("prior_product_review_count_median").alias("_h"))
    return base.crossJoin(F.broadcast(cuts)).where((F.col("rating_direction_concentration") <= F.col("_d")) & (F.col("prior_product_review_count_median") >= F.col("_h"))).drop("_d", "_h")


def hard_negative_units(f: DataFrame, units: DataFrame, chosen: DataFrame, max_nodes: int) -> DataFrame:
    """(prod_id, week, added): normal units taken whole, largest first, each if its new reviews still fit.

    The room only shrinks, so the units taken of one size are the first of that size, at most room / size of them. What
    the sequential pass can take is therefore bounded by the budget (room * (1 + ln room) rows), whatever the input.
    """
    room = max_nodes - chosen.count()
    fresh = f.select("prod_id", "week", "review_id").join(chosen.select("review_id"), "review_id", "left_anti").groupBy("prod_id", "week").agg(F.count("*").alias("added"))
    sized = normal_units(units).select("prod_id", "week", "n_reviews", "n_users").join(fresh, ["prod_id", "week"])
    order = [F.desc("n_reviews"), F.desc("n_users"), F.col("prod_id"), F.col("week")]
    first = sized.where(F.col("added") <= room).withColumn("_k", F.row_number().over(Window.partitionBy("added").orderBy(*order))).where(F.col("_k") * F.col("added") <= room)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_reviews", "n_users", "prod_id", "week"], ascending=[False, False, True, True])
        left, keep = room, []
        for n in pdf["added"]:
            keep.append(n <= left)
            left -= n if keep[-1] else 0
        return pdf.loc[keep, ["prod_id", "week", "added"]]

    return first.drop("_k").groupBy(F.lit("all").alias("_g")).applyInPandas(fill, "prod_id long, week date, added long")


def with_hard_negatives(f: DataFrame, units: DataFrame, chosen: DataFrame, max_nodes: int) -> DataFrame:
    """(review_id): ``chosen`` and the reviews of the normal units that still fit."""
    extra = f.join(hard_negative_units(f, units, chosen, max_nodes), ["prod_id", "week"], "left_semi").select("review_id")
    return chosen.select("review_id").union(extra).distinct()


def stratified_take(df: DataFrame, n: int, strata: list[str], order: list[Column]) -> DataFrame:
    """``n`` rows with strata in proportion: floors first, the rest to the largest fractions, then counts, then strata."""
    counts = df.groupBy(*strata).agg(F.count("*").alias("_c"))
    raw = F.col("_c") / F.sum("_c").over(Window.partitionBy()) * n
    quota = counts.withColumn("_raw", F.round(raw, 9)).withColumn("_q", F.floor("_raw"))
    spare = F.lit(n) - F.sum("_q").over(Window.partitionBy())
    nth = F.row_number().over(Window.orderBy((F.col("_q") - F.col("_raw")), F.desc("_c"), *strata))
    quota = quota.withColumn("_q", F.when(F.sum("_c").over(Window.partitionBy()) <= n, F.col("_c")).otherwise(F.col("_q") + (nth <= spare).cast("int")))
    return _first(df, quota, strata, order)


def _first(df: DataFrame, quota: DataFrame, strata: list[str], order: list[Column]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    ranked = df.withColumn("_k", nth)
    return ranked.join(quota, [ranked[c].eqNullSafe(quota[c]) for c in strata]).where(F.col("_k") <= F.col("_q")).select(*[ranked[c] for c in df.columns])


def stratified_fill(df: DataFrame, n: int, like: DataFrame, strata: list[str], order: list[Column], key: str = "review_id") -> DataFrame:
    """``n`` rows shaped as ``like``: floored quotas capped by what is there, the deficit topped up by ``order``."""
    have, shape = df.groupBy(*strata).agg(F.count("*").alias("_c")), like.groupBy(*strata).agg(F.count("*").alias("_l"))
    q = have.join(shape, strata, "left").fillna(0, ["_l"])
    total = F.sum("_l").over(Window.partitionBy())
    raw = F.when(total > 0, F.col("_l") / total * n).otherwise(F.col("_c") / F.sum("_c").over(Window.partitionBy()) * n)
    q = q.withColumn("_q", F.least(F.floor(F.round(raw, 9)), F.col("_c")))
    picked = _first(df, q.select(*strata, "_q"), strata, order)
    short = n - picked.count()
    if short <= 0:
        return picked
    return picked.unionByName(df.join(picked.select(key), key, "left_anti").select(*df.columns).orderBy(*order).limit(short))
