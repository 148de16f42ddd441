"""Samplings by the role of a product week: suspicious bursts, normal bursts, and the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions import quartile
from reviewloom.operators import anchors, sampling
from reviewloom.operators.stats import running

#: Unit columns beside the rating whose change is counted.
CHANGES = ["new_user_ratio", "short_ratio", "extreme_ratio", "rating_direction_concentration"]
STRATA = ["year", "rating_direction", "history_bin"]
ROLES = ["background_seed", "suspicious_seed", "normal_burst_seed"]


def burst_roles(units: DataFrame) -> DataFrame:
    """Adds the standardized rating shift, the count of other changes, and the flags of each role to ``units``.

    Units have base_candidate. Cutoffs are exact quantiles over base units and over those past the growth gate, three
    rows of a few numbers; without base units no unit has a role.
    """
    r9 = lambda c: F.round(c, 9)
    std = F.col("prior_product_rating_std_median")
    positive = F.percentile(F.when(std > 0, std), 0.25)
    one = units.where("base_candidate").agg(F.percentile("growth_ratio_30d", 0.75).alias("_growth"), F.greatest(F.coalesce(positive, F.lit(1.0)), F.lit(1e-6)).alias("_floor"))
    u = units.crossJoin(F.broadcast(one)).withColumns(
        {
            "burst_growth_gate": F.coalesce(F.col("base_candidate") & (r9(F.col("growth_ratio_30d")) >= r9(F.col("_growth"))), F.lit(False)),
            "standardized_rating_shift": r9(F.coalesce("mean_abs_rating_dev", F.lit(0.0)) / F.greatest(F.coalesce(std, F.col("_floor")), F.col("_floor"))),
        }
    )
    gate = u.where("burst_growth_gate")
    at = [F.percentile("standardized_rating_shift", q).alias(f"_s{int(100 * q)}") for q in (0.5, 0.75, 0.9)]
    two = gate.agg(*at, F.percentile("prior_product_review_count_median", 0.5).alias("_history"), *[F.median(c).alias(f"_m_{c}") for c in CHANGES])
    u = u.crossJoin(F.broadcast(two)).withColumns({f"_d_{c}": r9(F.abs(F.col(c) - F.col(f"_m_{c}"))) for c in CHANGES})
    three = u.where("burst_growth_gate").agg(*[F.percentile(f"_d_{c}", 0.75).alias(f"_c_{c}") for c in CHANGES])
    changed = reduce(lambda a, b: a + b, [F.coalesce((F.col(f"_d_{c}") > r9(F.col(f"_c_{c}"))).cast("long"), F.lit(0)) for c in CHANGES])
    u = u.crossJoin(F.broadcast(three)).withColumn("other_review_property_change_count", changed)
    shift, true = F.col("standardized_rating_shift"), lambda c: F.coalesce(F.col("burst_growth_gate") & c, F.lit(False))
    u = u.withColumns(
        {
            "suspicious_burst_unit": true(shift >= r9(F.col("_s75"))),
            "strong_suspicious_burst_unit": true(shift >= r9(F.col("_s90"))),
            "normal_burst_unit": true((shift <= r9(F.col("_s50"))) & (F.col("prior_product_review_count_median") >= F.col("_history")) & (changed <= 1)),
        }
    )
    u = u.withColumn("background_burst_unit", F.col("base_candidate") & ~F.col("suspicious_burst_unit") & ~F.col("normal_burst_unit"))
    return u.drop("_growth", "_floor", "_history", "_s50", "_s75", "_s90", *[f"{p}{c}" for p in ("_m_", "_d_", "_c_") for c in CHANGES])


def history_bin(f: DataFrame) -> DataFrame:
    """Adds history_bin, the quarter of the prior product count among all rows, ties by date and id.

    Rows are ranked within one count and day, and the counts and days summed up in ranges of values: no task holds all.
    """
    place = F.struct("prior_product_review_count", "date")
    counts = f.groupBy(place.alias("_place")).agg(F.count("*").alias("_c"))
    key = F.col("_place.prior_product_review_count") * 1000000 + F.datediff("_place.date", F.lit("1970-01-01"))
    sums = running(counts.select(F.col("_place.prior_product_review_count").alias("prior_product_review_count"), F.col("_place.date").alias("date"), key.cast("double").alias("_key"), "_c"), "_key", ["_c"])
    before = sums.select("prior_product_review_count", "date", (F.col("upto__c") - F.col("_c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("prior_product_review_count", "date").orderBy("review_id"))
    n = f.agg(F.count("*").alias("_n"))
    ranked = f.withColumn("_i", inside).join(before, ["prior_product_review_count", "date"]).crossJoin(F.broadcast(n))
    return ranked.withColumn("history_bin", quartile(F.col("_before") + F.col("_i"), F.col("_n"))).drop("_i", "_before", "_n")


def role_nodes(f: DataFrame, roles: DataFrame) -> DataFrame:
    """Reviews with year, history bin and their unit's role columns."""
    columns = ["base_candidate", "standardized_rating_shift", "other_review_property_change_count", "suspicious_burst_unit", "strong_suspicious_burst_unit", "normal_burst_unit", "background_burst_unit"]
    return history_bin(f.withColumn("year", F.year("date"))).join(roles.select("prod_id", "week", *columns), ["prod_id", "week"])


def contrast_seeds(nodes: DataFrame, per_role: int = 0) -> DataFrame:
    """(review_id, sample_role, is_strong_suspicious_seed): as many seeds of each role, stratified, at most ``per_role`` if above 0.

    ``nodes`` are role_nodes. If a role has no review there is no contrast and no seed. A review of two roles is a
    suspicious seed.
    """
    units = {"background_seed": "background_burst_unit", "suspicious_seed": "suspicious_burst_unit", "normal_burst_seed": "normal_burst_unit"}
    last = [F.col("date"), F.col("review_id")]
    order: dict[str, list[Column]] = {
        "background_seed": last,
        "suspicious_seed": [F.desc("strong_suspicious_burst_unit"), F.desc("standardized_rating_shift"), *last],
        "normal_burst_seed": [F.col("other_review_property_change_count"), F.col("standardized_rating_shift"), *last],
    }
    n = min(nodes.agg(*[F.count_if(F.col(c)).alias(c) for c in units.values()]).first())
    n = min(n, per_role) if per_role > 0 else n
    taken = []
    for place, (role, column) in enumerate(units.items()):
        strong = F.col("strong_suspicious_burst_unit") if role == "suspicious_seed" else F.lit(False)
        seeds = sampling.stratified_take(nodes.where(F.col(column)), n, STRATA, order[role])
        taken.append(seeds.select("review_id", F.struct(F.lit(place).alias("place"), F.lit(role).alias("sample_role"), strong.alias("strong")).alias("s")))
    each = reduce(lambda a, b: a.unionByName(b), taken).groupBy("review_id").agg(F.min("s").alias("s"))
    return each.select("review_id", "s.sample_role", F.col("s.strong").alias("is_strong_suspicious_seed"))


def contrast_edges(f: DataFrame, seeds: DataFrame) -> DataFrame:
    """(src, dst, relation_type, context_kind, context_stage, seed_role): earlier reviews of each seed's user and product.

    A product's reviews count from earlier weeks on. The baseline of a strong seed's product is a shock (type 2) as well.
    """
    def of(key: str, apart: str, number: int, kind: str) -> DataFrame:
        t = anchors.prior_triple(f, key, apart, seeds).join(seeds, "review_id")
        return t.select(F.col("chosen").alias("src"), F.col("review_id").alias("dst"), F.lit(number).alias("relation_type"), F.lit(kind).alias("context_kind"), F.col("role").alias("context_stage"), F.col("sample_role").alias("seed_role"), "is_strong_suspicious_seed")

    products = of("prod_id", "week", 1, "product")
    shocks = F.when(F.col("is_strong_suspicious_seed") & (F.col("context_stage") == "baseline"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    products = products.withColumn("relation_type", F.explode(shocks)).withColumn("context_kind", F.when(F.col("relation_type") == 2, "product_baseline_shock").otherwise("product"))
    return of("user_id", "date", 0, "user").unionByName(products).drop("is_strong_suspicious_seed")


def contrast_sample(seeds: DataFrame, edges: DataFrame, max_nodes: int) -> DataFrame:
    """(review_id and nine role columns) of all seeds and their context; more than ``max_nodes`` are an error."""
    context = edges.groupBy(F.col("src").alias("review_id")).agg(F.max(F.col("relation_type") == 0).alias("is_user_context_node"), F.max(F.col("relation_type") > 0).alias("is_product_context_node"))
    all_ = seeds.join(context, "review_id", "full").fillna(False, ["is_user_context_node", "is_product_context_node", "is_strong_suspicious_seed"]).fillna("context_only", ["sample_role"])
    n = all_.count()
    if n > max_nodes:
        raise ValueError(f"{n} seeds and context reviews exceed {max_nodes}: take fewer seeds per role")
    role = F.col("sample_role")
    return all_.select(
        "review_id", "sample_role", (role != "context_only").alias("is_target_node"), *[(role == r).alias(f"is_{r}") for r in ROLES], "is_strong_suspicious_seed",
        "is_user_context_node", "is_product_context_node", (F.col("is_user_context_node") | F.col("is_product_context_node")).alias("is_context_node"),
    )


def preserved_sample(nodes: DataFrame, legacy: DataFrame, max_nodes: int | None = None, room: int = 0) -> DataFrame:
    """(review_id, sample_role and five flags): selected units' reviews, hard seeds, and base reviews shaped as both.

    ``nodes`` are role_nodes, ``legacy`` the reviews of selected units. What ``max_nodes`` leaves, or ``room`` if that is
    not given, is filled; legacy and hard reviews beyond ``max_nodes`` are an error.
    """
    old = legacy.select("review_id", F.lit(True).alias("_old"))
    nodes = nodes.join(old, "review_id", "left").fillna(False, ["_old"])
    core = F.col("_old") | F.col("suspicious_burst_unit") | F.col("normal_burst_unit")
    if max_nodes is not None:
        taken = nodes.where(core).count()
        if taken > max_nodes:
            raise ValueError(f"{taken} reviews of selected units and hard seeds exceed {max_nodes}")
        room = max_nodes - taken
    kept = nodes.where(core).withColumn("_fill", F.lit(False))
    if room > 0:
        rest = nodes.where(F.col("base_candidate") & ~core)
        fill = sampling.stratified_fill(rest, room, nodes.where(core), STRATA, [F.col("date"), F.col("review_id")])
        kept = kept.unionByName(fill.withColumn("_fill", F.lit(True)))
    role = F.when(F.col("suspicious_burst_unit"), "suspicious_seed").when(F.col("normal_burst_unit"), "normal_burst_seed").when(F.col("_fill"), "distribution_fill").otherwise("legacy_core")
    return kept.select(
        "review_id", role.alias("sample_role"), F.lit(True).alias("is_target_node"), F.col("_old").alias("is_legacy_core"), F.col("suspicious_burst_unit").alias("is_suspicious_seed"),
        F.col("normal_burst_unit").alias("is_normal_burst_seed"), F.col("strong_suspicious_burst_unit").alias("is_strong_suspicious_seed"),
    )
