"""Which earlier reviews of a key stand for its history: recent ones, spaced anchors, and the triple of a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(nodes: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, review_id, date, rating, pos): pos from 0 by (date, review_id) inside the key."""
    order = Window.partitionBy(key).orderBy("date", "review_id")
    extra = [c for c in more if c != "date"]
    return nodes.select(key, "review_id", "date", "rating", *extra, (F.row_number().over(order) - 1).cast("long").alias("pos"))


def neighbour_gaps(nodes: DataFrame) -> DataFrame:
    """Days to the user's review before and after, null where there is none, and whether one lies within 7 or 30 days."""
    order = Window.partitionBy("user_id").orderBy("date", "review_id")
    before, after = F.datediff("date", F.lag("date").over(order)), F.datediff(F.lead("date").over(order), "date")
    gaps = nodes.select("review_id", before.alias("prev_gap_days"), after.alias("next_gap_days"))
    nearest = F.least("prev_gap_days", "next_gap_days")  # nulls are passed by
    return gaps.withColumns({f"neighbour_{d}d": F.coalesce((nearest <= d).cast("long"), F.lit(0)) for d in (7, 30)})


def recent_context(nodes: DataFrame, seed: str, key: str, k: int) -> DataFrame:
    """Adds is_context: one of the ``k`` reviews just before a seed of the same key, seeds themselves left out."""
    ahead = Window.partitionBy(key).orderBy("date", "review_id").rowsBetween(1, k)
    return nodes.withColumn("is_context", ((F.col(seed) == 0) & (F.coalesce(F.max(seed).over(ahead), F.lit(0)) == 1)).cast("long"))


def segmented_anchors(nodes: DataFrame, key: str, k: int) -> DataFrame:
    """Edges (src, dst) from spaced earlier reviews of a key: all if at most ``k``, else last, middle, first, then evenly spaced.

    Each review asks for at most k places, so a key of m reviews costs k * m rows.
    """
    at = placed(nodes, key)
    n = F.col("pos")
    spaced = [F.floor((n - 1) * i / (k - 1)).cast("long") for i in range(k)] if k > 3 else []
    wanted = F.slice(F.array_distinct(F.array(*([n - 1, F.floor(n / 2).cast("long"), F.lit(0).cast("long")][:k] + spaced))), 1, k)
    places = F.when(n <= k, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(wanted)
    asked = at.where("pos > 0").select(key, F.col("review_id").alias("dst"), F.explode(places).alias("pos"))
    return asked.join(at.select(key, "pos", F.col("review_id").alias("src")), [key, "pos"]).select("src", "dst")


def prior_triple(nodes: DataFrame, key: str, apart: str = "date", seeds: DataFrame | None = None) -> DataFrame:
    """(review_id, role, chosen): the recent, middle and baseline review of a key among those of strictly earlier days.

    With ``apart`` "week" they are those of earlier weeks. Of ``seeds`` (review_id) alone, if given.

    Of n earlier ones, by (date, id): recent is the last and mid the one at (n - 1) // 2. Baseline is, of those before mid,
    the one of rating nearest to the mean of all n, then earliest. Only the first review of each rating can be that one,
    so a key hands on one place per distinct rating rather than its whole history.
    """
    at = placed(nodes, key, apart)
    earlier = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy(key, apart)
    at = at.withColumn("_sum", F.coalesce(F.sum("rating").over(earlier), F.lit(0)))
    at = at.withColumns({"n": F.min("pos").over(day), "_before": F.min_by("_sum", "pos").over(day)})
    firsts = at.groupBy(key, "rating").agg(F.min("pos").alias("first")).groupBy(key).agg(F.collect_list(F.struct("rating", "first")).alias("firsts"))
    mid = F.floor((F.col("n") - 1) / 2).cast("long")
    wanted = at.where("n > 0") if seeds is None else at.where("n > 0").join(seeds.select("review_id"), "review_id", "left_semi")
    seeds = wanted.join(firsts, key).withColumn("mean", F.col("_before") / F.col("n"))
    pool = F.filter("firsts", lambda x: x["first"] < mid)
    best = F.array_min(F.transform(pool, lambda x: F.struct(F.round(F.abs(x["rating"] - F.col("mean")), 9).alias("gap"), x["first"].alias("first"))))["first"]
    role = lambda name, pos: F.struct(F.lit(name).alias("role"), pos.cast("long").alias("pos"))
    roles = F.array(role("recent", F.col("n") - 1), role("mid", F.when(F.col("n") >= 2, mid)), role("baseline", best))
    asked = seeds.select(key, "review_id", F.explode(roles).alias("r")).select(key, "review_id", "r.role", "r.pos").where("pos IS NOT NULL")
    return asked.join(at.select(key, "pos", F.col("review_id").alias("chosen")), [key, "pos"]).select("review_id", "role", "chosen")
