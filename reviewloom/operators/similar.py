"""Nearest vectors by cosine inside a key, and the edges built from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.blocks import ROWS, at_least_kth, first_of_each, gathered, in_blocks, pieces, unit
from reviewloom.operators.edges import both_ways
from reviewloom.sources import cut


def nearest(sources: DataFrame, targets: DataFrame, keys: list[str], k: int, threshold: float = -1.0, block: int = 16_384) -> DataFrame:
    """(src, dst, sim): for each source its ``k`` most similar targets of the same keys at ``threshold`` or more.

    ``sources`` has the keys, src and v, ``targets`` the keys, dst, v and rank_as; both v are arrays of numbers. Similarities
    are rounded to nine places, ties go to the least rank_as; all-zero vectors are similar to nothing (0). Every source
    meets every target of its keys exactly, in blocks of about ``block`` by ``block`` rows: a task holds two blocks and
    hands on at most k rows a source, so a hot key becomes many tasks and never a table of pairs. Single precision finds
    which pairs can be wanted, with room for all that it may be off by, and double precision settles these.
    """
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if left.empty or right.empty:
            return gathered(out, ["src", "dst", "sim", "rank_as"])
        x, y, src, dst, rank = unit(left["v"]), unit(right["v"]), left["src"].to_numpy(), right["dst"].to_numpy(), right["rank_as"].to_numpy()
        x4, y4 = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
        slack = (x.shape[1] + 8) * 2.0**-22 + 2e-9
        for start in range(0, len(x), ROWS):
            for r, c in pieces(*at_least_kth(x4[start : start + ROWS] @ y4, k, slack, threshold)):
                r = r + start
                sim = np.round(np.clip(np.einsum("nd,nd->n", x[r], y[c]), -1.0, 1.0), 9)
                keep = sim >= threshold
                r, c, sim = r[keep], c[keep], sim[keep]
                order = np.lexsort((rank[c], -sim, r))
                order = order[first_of_each(r[order], k)]
                out.append((src[r[order]], dst[c[order]], sim[order], rank[c[order]]))
        return gathered(out, ["src", "dst", "sim", "rank_as"])

    found = in_blocks(sources.select(*keys, "src", "v"), targets.select(*keys, "dst", "v", "rank_as"), keys, best, "src long, dst long, sim double, rank_as long", block)
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "rank_as")))
    return ranked.where(F.col("_n") <= k).select("src", "dst", "sim")


def _vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.col("embedding").alias("v"))  # as wide as it is stored


def template_similar(f: DataFrame, vectors: DataFrame, threshold: float = 0.9, k: int = 3, max_group: int = 2500) -> DataFrame:
    """Symmetric edges to the ``k`` most similar reviews of the same product week; weeks above ``max_group`` are left out."""
    week = Window.partitionBy("prod_id", "week")
    sized = f.select("prod_id", "week", "review_id", "vec_id").withColumn("_size", F.count("*").over(week)).where(F.col("_size").between(2, max_group))
    e = sized.join(_vectors(vectors), "vec_id").select("prod_id", "week", F.col("review_id").alias("src"), "v")
    # a review is its own nearest neighbour, or as near as a copy with a smaller id: one more is asked for
    found = nearest(e, e.select("prod_id", "week", F.col("src").alias("dst"), "v", F.col("src").alias("rank_as")), ["prod_id", "week"], k + 1, threshold)
    first = found.where("src <> dst").withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst")))
    return both_ways(first.where(F.col("_n") <= k))


def risk_text(f: DataFrame, vectors: DataFrame, threshold: float = 0.9, k: int = 3, targets: str = "both_risky", neutral: bool = True, same_week: bool = False, multiplier: int = 10, new_only: bool = True) -> DataFrame:
    """Symmetric edges from short or extreme reviews to the most similar ones of their rating direction.

    Of a source's k * multiplier + 1 nearest, itself among them, those of its own product week go unless ``same_week``;
    the first k stay; with ``new_only`` the first k pairs that no source of smaller id has made (``first_new``).
    ``targets`` are the risky reviews ("both_risky") or all ("anchor_risky"); ``neutral`` says whether direction 0 takes
    part. Reviews share vectors: classes of one direction and vector are compared, not reviews, and of a class only
    its first k * multiplier + 1 reviews can be wanted, nor can more classes than that.
    """
    if targets not in ("both_risky", "anchor_risky"):
        raise ValueError(f"unknown targets {targets!r}")
    n = k * multiplier + 1
    risky = (F.col("short_review_flag") == 1) | (F.col("extreme_rating") == 1)
    rows = f if neutral else f.where("rating_direction <> 0")
    rows = rows.select("review_id", "rating_direction", "vec_id", "prod_id", "week", risky.alias("risky"))
    sources = rows.where("risky")
    pool = sources if targets == "both_risky" else rows
    first = Window.partitionBy("rating_direction", "vec_id").orderBy("review_id")
    pool = pool.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")
    v = _vectors(vectors)
    left = sources.select("rating_direction", "vec_id").distinct().join(v, "vec_id")
    right = pool.groupBy("rating_direction", "vec_id").agg(F.min("review_id").alias("rank_as")).join(v, "vec_id")
    # a class's number is its own within the direction, so both are folded into one id
    number = F.col("vec_id") * 3 + F.col("rating_direction") + 1
    classes = nearest(left.select("rating_direction", number.alias("src"), "v"), right.select("rating_direction", number.alias("dst"), "v", "rank_as"), ["rating_direction"], n, threshold)
    ends = pool.select(number.alias("dst"), F.col("review_id").alias("to"), F.col("prod_id").alias("to_prod"), F.col("week").alias("to_week"))
    # what a class of sources asks for is the same for all its reviews: at most n rows a class
    near = classes.join(ends, "dst").withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "to"))).where(F.col("_n") <= n)
    met = sources.select(number.alias("src"), "review_id", "prod_id", "week").join(near.drop("dst"), "src").where("review_id <> to")
    if not same_week:
        met = met.where("NOT (prod_id = to_prod AND week = to_week)")
    lists = met.select(F.col("review_id").alias("src"), F.col("to").alias("dst"), "_n")
    return both_ways(first_new(lists, k) if new_only else _first(lists, k))


def _first(lists: DataFrame, k: int) -> DataFrame:
    return lists.withColumn("_k", F.row_number().over(Window.partitionBy("src").orderBy("_n"))).where(F.col("_k") <= k).select("src", "dst")


def first_new(lists: DataFrame, k: int) -> DataFrame:
    """Of each source's list (src, dst, _n) the first k pairs that are new when sources choose one after the other by id.

    What a source chooses depends on sources of smaller id alone. So all choose at once, passing over what smaller ones
    chose the round before, until nothing changes: after each round at least one more source in any chain of dependence
    is right for good, and the end is the same as one by one. Each round is a join on pairs.
    """
    lists = cut(lists)
    chosen = cut(_first(lists, k))
    while True:
        taken = chosen.where("src < dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        again = cut(_first(lists.join(taken, ["src", "dst"], "left_anti"), k))
        if again.count() == chosen.count() and again.join(chosen, ["src", "dst"], "left_anti").isEmpty():
            return again
        chosen = again
