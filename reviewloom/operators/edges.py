"""Builders of typed edges (src, dst) between reviews, and what is done with edge tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions import clip, day_number, week_of
from reviewloom.operators.blocks import ROWS, at_least_kth, first_of_each, gathered, in_blocks, pieces, unit
from reviewloom.operators.stats import quantiles
from reviewloom.sources import cut

#: Fixed values, these and the two lists below: weights of a campaign pair's score: text, both new users, both short, both deviating, joint lift.
CAMPAIGN_WEIGHTS = (0.35, 0.16, 0.14, 0.20, 0.15)
CAMPAIGN_LIFTS = ["same_dir_log_count_lift_4w", "direction_concentration_lift_4w", "new_user_ratio_lift_4w", "short_review_ratio_lift_4w"]
BEHAVIOR = ["short_review_flag", "extreme_rating", "is_new_user_at_review_time", "prior_user_review_count", "prior_product_review_count", "rating_deviation_from_prior_product_mean"]

#: Rows of a block of sources or targets that meet in one task.
BLOCK = 8192
#: Rows of a block of ``equal_pairs``; what the join keeps of a key is in plain memory up to 4,096 rows.
PAIRED = 2048


def last_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """Directed edges from the k latest earlier rows of the same key, in (date, review_id) order.

    Inside a key's week they are lags. Each week hands its k latest on, and as a week that is there has one row at least,
    the k weeks before hold the k latest of all: so a hot key is as many tasks as it has weeks.
    """
    df = df.select(key, "date", "review_id", week_of(F.col("date")).alias("week"))
    w = Window.partitionBy(key, "week").orderBy("date", "review_id")
    own = F.filter(F.array(*[F.lag("review_id", i).over(w) for i in range(1, k + 1)]), lambda x: x.isNotNull())
    inside = df.withColumn("_own", own).join(_carried_latest(df, key, k), [key, "week"], "left")
    srcs = F.slice(F.concat("_own", F.coalesce(F.transform("earlier", lambda e: e["review_id"]), F.array().cast("array<long>"))), 1, k)
    return inside.select(F.explode(srcs).alias("src"), F.col("review_id").alias("dst"))


def _carried_latest(df: DataFrame, key: str, k: int, *more: str) -> DataFrame:
    """(key, week, earlier): the k latest rows of the key in weeks before, the latest first, with ``more`` of their columns."""
    recent = Window.partitionBy(key, "week").orderBy(F.desc("date"), F.desc("review_id"))
    tops = df.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= k)
    weeks = tops.groupBy(key, "week").agg(F.collect_list(F.struct("date", "review_id", *more)).alias("own"))
    before = Window.partitionBy(key).orderBy("week").rowsBetween(-k, -1)
    return weeks.select(key, "week", F.slice(F.sort_array(F.flatten(F.collect_list("own").over(before)), False), 1, k).alias("earlier"))


def prior_context(df: DataFrame, k: int) -> DataFrame:
    """Directed edges from the k latest same-product reviews of earlier weeks; each week carries the k latest forward."""
    have = _carried_latest(df.select("prod_id", "week", "date", "review_id"), "prod_id", k).where(F.size("earlier") > 0)
    return df.join(have, ["prod_id", "week"]).select(F.explode("earlier").alias("e"), F.col("review_id").alias("dst")).select(F.col("e.review_id").alias("src"), "dst")


def context_sources(df: DataFrame, k: int, *more: str) -> DataFrame:
    """(prod_id, week, e): a row for each source of ``prior_context``, with its own date, review_id and ``more``."""
    return _carried_latest(df.select("prod_id", "week", "date", "review_id", *more), "prod_id", k, *more).select("prod_id", "week", F.explode("earlier").alias("e"))


def likest_after(df: DataFrame, vectors: DataFrame, context: int, k: int) -> DataFrame:
    """(src, dst, score, days_apart): of the edges of ``prior_context`` each source's ``k`` of largest cosine, then fewest days
    apart, then smallest id. ``df`` has vec_id beside a review's own columns, ``vectors`` has vec_id and embedding.

    A product week has at most ``context`` sources for all its reviews, so these meet its reviews in blocks and no edge is
    made that is not among a block's best. Reviews of one vector are equally like a source: the first ``k`` of a product
    week are enough.
    """
    n = df.select("prod_id", "week", "date", "review_id", "vec_id")
    there = Window.partitionBy("prod_id", "week", "vec_id").orderBy("date", "review_id")
    first = cut(n.withColumn("_n", F.row_number().over(there)).where(F.col("_n") <= k).drop("_n"))
    before = cut(context_sources(n, context, "vec_id").select("prod_id", "week", F.col("e.review_id").alias("src"), day_number(F.col("e.date")).alias("day"), F.col("e.vec_id").alias("vec_id")))
    v = vectors.select("vec_id", F.col("embedding").alias("v"))
    sources = before.join(v, "vec_id").drop("vec_id")
    targets = first.join(v, "vec_id").select("prod_id", "week", F.col("review_id").alias("dst"), day_number(F.col("date")).alias("day"), "v")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, names = [], ["src", "dst", "score", "days_apart"]
        if left.empty or right.empty:
            return gathered(out, names)
        dst, day = right["dst"].to_numpy(), right["day"].to_numpy()
        scores = np.round(np.clip(unit(left["v"]) @ unit(right["v"]).T, -1.0, 1.0), 9)
        for src, own, score in zip(left["src"], left["day"], scores, strict=True):
            order = np.lexsort((dst, day - own, -score))[:k]
            out.append((np.full(len(order), src), dst[order], score[order], day[order] - own))
        return gathered(out, names)

    found = in_blocks(sources, targets, ["prod_id", "week"], best, "src long, dst long, score double, days_apart long", BLOCK)
    return top_k(found, k, F.desc("score"), F.col("days_apart"), F.col("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def top_k(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def band_self_join(df: DataFrame, keys: list[str], days: int, columns: list[str]) -> DataFrame:
    """Pairs (a_*, b_*) of rows with equal keys at most ``days`` apart: an equi-join on day buckets, the right side in three."""
    day = day_number(F.col("date"))
    bucket = F.floor(day / max(days, 1))
    a = df.select(*keys, bucket.alias("_bucket"), day.alias("a_day"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(*keys, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"), day.alias("b_day"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col("a_day") - F.col("b_day")) <= days).withColumn("days_apart", F.abs(F.col("a_day") - F.col("b_day")))


def equal_pairs(df: DataFrame, keys: list[str], block: int = PAIRED) -> DataFrame:
    """(src, dst): every ordered pair of rows with equal keys. Rows with a null key have none.

    What comes out grows with the square of a key's rows, so a key is dealt out by blocks of about ``block`` rows: each two
    blocks meet by themselves, of which the join holds one. The number of tasks is fixed, as by the few bytes that go in
    adaptive execution would take all for one.
    """
    df = df.select(*keys, "review_id").dropna(subset=keys)
    sized = df.join(df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_n")), keys)
    spot, every = F.pmod(F.xxhash64("review_id"), F.col("_n")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    by, tasks = [*keys, "_a", "_b"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = sized.select(*keys, spot.alias("_a"), every.alias("_b"), F.col("review_id").alias("src")).repartition(tasks, *by)
    right = sized.select(*keys, every.alias("_a"), spot.alias("_b"), F.col("review_id").alias("dst")).repartition(tasks, *by)
    return left.join(right.hint("merge"), by).where("src <> dst").select("src", "dst")


def _strangers(pairs: DataFrame) -> DataFrame:
    """Other review, other user, other product week."""
    return pairs.where("a_review_id <> b_review_id AND a_user_id <> b_user_id AND NOT (a_prod_id = b_prod_id AND a_week = b_week)")


def shock_candidates(f: DataFrame, max_prior: int = 30, min_dev: float = 1.0, standardized: bool = False) -> DataFrame:
    """Reviews that depart from a little-reviewed product's mean, with their shock direction and score."""
    dev = F.col("rating_deviation_from_prior_product_mean")
    f = f.withColumn("abs_dev", F.abs(dev))
    score = F.col("abs_dev")
    if standardized:
        std = F.col("prior_product_rating_std")
        floor = quantiles(f, {"_floor": (F.when(std > 0, std), 0.25)})
        f = f.crossJoin(F.broadcast(floor))  # one row
        score = score / F.greatest(std, F.coalesce("_floor", F.lit(1.0)), F.lit(1e-6))
    f = f.withColumns({"shock_score": score, "shock_direction": F.when(dev > 0, 1).when(dev < 0, -1).otherwise(0)}).drop("_floor")
    return f.where((F.col("prior_product_review_count") <= max_prior) & (F.col("shock_score") >= min_dev) & (F.col("rating_direction") != 0))


def shock_peers(f: DataFrame, days: int = 3, k: int = 15, **candidates) -> DataFrame:
    """Symmetric edges between shocks of one direction near in time, of other users and product weeks."""
    c = shock_candidates(f, **candidates)
    pairs = _strangers(band_self_join(c, ["shock_direction", "rating_direction"], days, ["review_id", "user_id", "prod_id", "week", "abs_dev", "shock_score", "prior_product_review_count", "abuse_burst_behavior_score_4w"]))
    gap = lambda x: F.round(F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")), 9)
    burst = F.round(F.least("a_abuse_burst_behavior_score_4w", "b_abuse_burst_behavior_score_4w"), 9)
    pairs = pairs.withColumnsRenamed({"a_review_id": "src", "b_review_id": "dst"})
    return both_ways(top_k(pairs, k, burst.desc(), gap("shock_score"), gap("abs_dev"), gap("prior_product_review_count"), F.col("days_apart"), F.col("dst")))


def shock_baseline(f: DataFrame, k: int = 5, **candidates) -> DataFrame:
    """Directed edges to a shock with at least one prior review from the k latest earlier same-product reviews of others."""
    c = shock_candidates(f, **candidates).where("prior_product_review_count >= 1").select("prod_id", F.col("review_id").alias("dst"), F.col("user_id").alias("of"), F.col("date").alias("on"))
    # A shock's product has at most max_prior + 1 reviews up to it, so this join is bounded by that per shock.
    e = f.select("prod_id", F.col("review_id").alias("src"), "user_id", "date", "prior_product_review_count")
    met = c.join(e, "prod_id").where("(date < on OR (date = on AND src < dst)) AND user_id <> of")
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("date"), F.desc("src")))).where(F.col("_n") <= k).select("src", "dst")


def behavior_matrix(c: DataFrame) -> DataFrame:
    """Adds z_<c> for the columns of BEHAVIOR: missing values at the median, less the median, over the population deviation
    (1 where that is under 1e-12)."""
    medians = quantiles(c, {f"_m_{x}": (F.col(x), 0.5) for x in BEHAVIOR})
    filled = c.crossJoin(F.broadcast(medians)).withColumns({f"_x_{x}": F.coalesce(F.col(x).cast("double"), F.col(f"_m_{x}"), F.lit(0.0)) for x in BEHAVIOR})
    scale = filled.agg(*[F.stddev_pop(f"_x_{x}").alias(f"_s_{x}") for x in BEHAVIOR])
    z = {f"z_{x}": (F.col(f"_x_{x}") - F.coalesce(F.col(f"_m_{x}"), F.lit(0.0))) / F.when(F.col(f"_s_{x}") < 1e-12, 1.0).otherwise(F.col(f"_s_{x}")) for x in BEHAVIOR}
    return filled.crossJoin(F.broadcast(scale)).withColumns(z).drop(*[f"_{n}_{x}" for x in BEHAVIOR for n in "msx"])


def cold_start_cohort(f: DataFrame, max_prior: int = 1, days: int = 3, k: int = 5) -> DataFrame:
    """Symmetric edges between risky reviews of new users, of one direction and near in time, by likeness of behavior."""
    new = (F.col("prior_user_review_count") <= max_prior) | (F.col("is_new_user_at_review_time") == 1)
    risky = (F.col("short_review_flag") == 1) | (F.col("extreme_rating") == 1)
    c = f.where(new & risky)
    c = behavior_matrix(c)
    return both_ways(_likest(c.where("rating_direction <> 0"), days, k))


def _likest(c: DataFrame, days: int, k: int) -> DataFrame:
    """(src, dst): of each row's strangers (other user, other product week) of its direction at most ``days`` apart the first
    ``k`` by days apart, mean absolute difference of the z columns, and id.

    Days meet in blocks. As a smaller distance in days always comes first, rows meet their own day alone, and only those
    that find fewer than ``k`` strangers there meet the days around it.
    """
    z = F.array(*[F.col(f"z_{x}") for x in BEHAVIOR]).alias("z")
    e = cut(c.select("rating_direction", day_number(F.col("date")).alias("day"), "review_id", "user_id", "prod_id", day_number(F.col("week")).alias("week"), z))
    end = lambda name: e.select("rating_direction", F.col("day").alias("meet"), "day", F.col("review_id").alias(name), "user_id", "prod_id", "week", "z")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if left.empty or right.empty:
            return gathered(out, ["src", "dst", "days_apart", "distance"])
        x, y = np.array(left["z"].to_list()), np.ascontiguousarray(np.array(right["z"].to_list()).T)
        a, b = ({n: pdf[n].to_numpy() for n in ("user_id", "prod_id", "week", "day")} for pdf in (left, right))
        src, dst, apart = left["src"].to_numpy(), right["dst"].to_numpy(), np.abs(a["day"] - b["day"][0])  # the right side is one day
        for start in range(0, len(x), ROWS):
            rows = slice(start, start + ROWS)
            same = {n: a[n][rows, None] == b[n] for n in ("user_id", "prod_id", "week")}
            gap = reduce(lambda p, q: p + q, [np.abs(x[rows, i : i + 1] - y[i]) for i in range(len(y))]) / len(y)
            gap[same["user_id"] | (same["prod_id"] & same["week"])] = np.inf
            for r, t in pieces(*at_least_kth(-gap, k, 2e-9)):
                distance = np.round(gap[r, t], 9)
                keep = np.isfinite(distance)
                r, t, distance = r[keep], t[keep], distance[keep]
                order = np.lexsort((dst[t], distance, r))
                order = order[first_of_each(r[order], k)]
                out.append((src[start + r[order]], dst[t[order]], apart[start + r[order]], distance[order]))
        return gathered(out, ["src", "dst", "days_apart", "distance"])

    def met(sources: DataFrame) -> DataFrame:
        return in_blocks(sources, end("dst"), ["rating_direction", "meet"], best, "src long, dst long, days_apart long, distance double", BLOCK)

    first = F.col("days_apart"), F.col("distance"), F.col("dst")
    own = cut(top_k(met(end("src")), k, *first))
    full = own.groupBy("src").agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
    around = F.explode(F.array(*[F.col("day") + i for i in range(-days, days + 1) if i]))
    return top_k(own.unionByName(met(end("src").join(full, "src", "left_anti").withColumn("meet", around))), k, *first)


def campaign_pairs(f: DataFrame, vectors: DataFrame, train: Column | None = None, existing: DataFrame | None = None, quantile: float = 0.6, k: int = 3, budget: int = 6000, min_score: float = 0.2, min_group: int = 3) -> DataFrame:
    """Directed edges between like reviews of one product, week and direction where behavior has shifted.

    A group's reviews meet in blocks, which hand on each source's k best pairs that ``existing`` does not have.

    ``vectors`` has vec_id and embedding. Cutoffs are learned on rows where ``train`` holds, or on all. Groups are gated by size and mean lift before any pair is made; pairs that
    ``existing`` has are passed over; each source keeps its k best, then the best ``budget`` of all stay.
    """
    lift = reduce(lambda a, b: a + b, [F.greatest(F.col(c), F.lit(0.0)) for c in CAMPAIGN_LIFTS])
    f = f.withColumn("lift", lift)
    std = F.col("prior_product_rating_std")
    cuts = quantiles(f if train is None else f.where(train), {"cut": (F.col("lift"), quantile), "q90": (F.col("lift"), 0.9), "std_floor": (F.when(std > 0, std), 0.25)})
    cuts = cuts.select(F.coalesce("cut", F.lit(0.0)).alias("cut"), F.greatest("q90", "cut", F.lit(1e-6)).alias("q90"), F.greatest(F.coalesce("std_floor", F.lit(1.0)), F.lit(1e-6)).alias("std_floor"))
    g = Window.partitionBy("prod_id", "week", "rating_direction")
    f = f.where("rating_direction <> 0").withColumns({"_size": F.count("*").over(g), "_mean": F.avg("lift").over(g)}).crossJoin(F.broadcast(cuts))
    f = f.where((F.col("_size") >= min_group) & (F.round("_mean", 9) >= F.round("cut", 9)))
    f = f.withColumn("dev", clip(F.abs("rating_deviation_from_prior_product_mean") / F.greatest("prior_product_rating_std", "std_floor"), 0.0, 3.0) / 3)
    f = f.select("prod_id", "week", "rating_direction", "review_id", "vec_id", "date", "lift", "q90", "dev", F.col("is_new_user_at_review_time").alias("new"), F.col("short_review_flag").alias("short"))
    text, *weights = CAMPAIGN_WEIGHTS
    parts = [F.col(c).cast("double") for c in ("new", "short", "dev")] + [clip(F.col("lift") / F.col("q90"), 0.0, 1.0)]
    e = f.join(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id").select("prod_id", "week", "rating_direction", F.col("review_id").alias("src"), day_number(F.col("date")).alias("day"), F.array(*parts).alias("parts"), "v")
    targets = e.withColumnRenamed("src", "dst")
    known = F.array().cast("array<long>")
    if existing is None:
        e = e.withColumn("known", known)
    else:
        e = e.join(existing.groupBy("src").agg(F.collect_set("dst").alias("known")), "src", "left").withColumn("known", F.coalesce("known", known))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, names = [], ["src", "dst", "score", "days_apart"]
        if left.empty or right.empty:
            return gathered(out, names)
        x, y, src, dst, day, there = unit(left["v"]), unit(right["v"]), left["src"].to_numpy(), right["dst"].to_numpy(), left["day"].to_numpy(), right["day"].to_numpy()
        p, q, passed = np.array(left["parts"].to_list()), np.array(right["parts"].to_list()), [{own, *gone} for own, gone in zip(src.tolist(), left["known"], strict=True)]
        x4, y4, p4, q4 = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T), p.astype(np.float32), np.ascontiguousarray(q.astype(np.float32).T)
        asked, slack = k + max(map(len, passed)), (x.shape[1] + 16) * 2.0**-22 + 2e-9
        for start in range(0, len(x), ROWS):
            rows = slice(start, start + ROWS)
            about = x4[rows] @ y4
            np.clip(about, -1.0, 1.0, out=about)
            about += 1
            about *= text / 2
            for i, weight in enumerate(weights):
                about += np.float32(weight) * np.minimum(p4[rows, i : i + 1], q4[i])
            for r, c in pieces(*at_least_kth(about, asked, slack, min_score)):
                r = r + start
                new = np.fromiter((d not in passed[i] for i, d in zip(r.tolist(), dst[c].tolist(), strict=True)), bool, len(r))
                r, c = r[new], c[new]
                both = np.minimum(p[r], q[c])
                rest = reduce(lambda a, b: a + b, [w * both[:, i] for i, w in enumerate(weights)])
                score = np.round(text * ((np.clip(np.einsum("nd,nd->n", x[r], y[c]), -1.0, 1.0) + 1) / 2) + rest, 9)
                keep = score >= min_score
                r, c, score = r[keep], c[keep], score[keep]
                apart = np.abs(day[r] - there[c])
                order = np.lexsort((dst[c], apart, -score, r))
                order = order[first_of_each(r[order], k)]
                out.append((src[r[order]], dst[c[order]], score[order], apart[order]))
        return gathered(out, names)

    # A source's k best of every block are among these, so no table of pairs is made.
    scored = in_blocks(e, targets, ["prod_id", "week", "rating_direction"], best, "src long, dst long, score double, days_apart long", BLOCK)
    kept = top_k(scored, k, F.desc("score"), F.col("days_apart"), F.col("dst"))
    return kept.orderBy(F.desc("score"), "src", "dst").limit(budget).select("src", "dst", "score")


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds pos, from 0 in (date, review_id) order within the keys, and size. Rows with a null key or date go.

    Rows are ranked within a key's day and days by their prefix sums, so a hot key is no single task.
    """
    by = Window.partitionBy(*keys)
    days = df.groupBy(*keys, "date").agg(F.count("*").alias("_c"))
    days = days.select(*keys, "date", F.coalesce(F.sum("_c").over(by.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(by).alias("size"))
    nth = F.row_number().over(Window.partitionBy(*keys, "date").orderBy("review_id")) - 1
    return df.select(*keys, "date", "review_id").withColumn("_nth", nth).join(days, [*keys, "date"]).withColumn("pos", F.col("_nth") + F.col("_before")).select(*keys, "review_id", "pos", "size")


def _greedy(ids: list, at: list[int], degree: list[int], cap: int, done: int = 0) -> pd.DataFrame:
    """Edges by growing distance of positions, beyond ``done``, then by position, while both ends have fewer than ``cap``."""
    out, open_ = [], [i for i in range(len(ids)) if degree[i] < cap]
    for _, i, j in sorted((at[j] - at[i], i, j) for i in open_ for j in open_ if at[j] - at[i] > done):
        if degree[i] < cap and degree[j] < cap:
            out += [(ids[i], ids[j]), (ids[j], ids[i])]
            degree[i] += 1
            degree[j] += 1
    return pd.DataFrame(out, columns=["src", "dst"])


def _indices(n: int, at: list[int] | None = None, degree: list[int] | None = None, cap: int = 0, done: int = 0) -> list[tuple[int, int]]:
    """Edges of ``_greedy`` among n members by their numbers."""
    found = _greedy(list(range(n)), at or list(range(n)), list(degree or [0] * n), cap, done)
    return list(zip(found["src"].tolist(), found["dst"].tolist(), strict=True))


def clique_patterns(cap: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """Width of a pack of a large group, and by code which numbers of a pack are linked: of a group of up to ``6 * cap``
    members by its size, of a stretch of a large group under -1, and of its two ends under -2 less what its size leaves
    when divided by the double run.

    Neither depends on who the members are, so this table, of a size that ``cap`` alone decides, is all that is computed
    one after the other.
    """
    bound, half, odd = 6 * cap, cap // 2, cap % 2
    run = half + 1
    width = -(-max(bound, 64) // (2 * run)) * 2 * run
    found = {n: _indices(n, cap=cap) for n in range(2, bound + 1)}
    inner = [(i, i + step) for i in range(width) for step in range(1, half + 1 + (odd and i // run % 2 == 0))]
    found[-1] = inner + [(j, i) for i, j in inner]
    for size in range(bound + 1, bound + 1 + 2 * run):
        at = [*range(run), *range(size - run, size)]
        degree = [min(p, half) + min(size - 1 - p, half) + (odd and (p // run % 2 == 1 or p + run < size)) for p in at]
        found[-2 - size % (2 * run)] = _indices(2 * run, at, degree, cap, half + odd)
    return width, found


def capped_clique(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Symmetric edges within groups. Up to cap + 1 members all pairs; in larger groups by growing distance in (date, id)
    order, an edge being added only while both ends have fewer than ``cap``.

    What is added depends on what was added before, but only by the places of members: groups of up to ``6 * cap`` have
    one pattern a size. In a larger group every step of 1 to cap // 2 is added whole and gives each inner member two
    edges; with an odd cap the next step links alternate runs of its own length, which fills them. What stays open are the
    first and last cap // 2 + 1 members, with one pattern for each rest of the size. So members are packed by place, a
    stretch of a group a row and its two ends another, and each pack takes its pattern from ``clique_patterns``.
    """
    width, patterns = clique_patterns(cap)
    bound, run = 6 * cap, cap // 2 + 1
    n, large = numbered(df, keys).where("size > 1"), F.col("size") > bound
    own = F.floor(F.col("pos") / width)
    # (code, pack): a stretch's first members also end the one before.
    spots = F.array(
        F.struct(F.when(large, -1).otherwise(F.col("size")).cast("int").alias("_code"), F.when(large, own).otherwise(0).alias("_pack")),
        F.when(large & (own > 0) & (F.col("pos") % width < run), F.struct(F.lit(-1).alias("_code"), (own - 1).alias("_pack"))),
        F.when(large & ((F.col("pos") < run) | (F.col("pos") >= F.col("size") - run)), F.struct((-2 - F.col("size") % (2 * run)).cast("int").alias("_code"), F.lit(0).cast("long").alias("_pack"))),
    )
    packs = n.select(*keys, "pos", "review_id", F.explode(spots).alias("_s")).where("_s IS NOT NULL").groupBy(*keys, "_s").agg(F.sort_array(F.collect_list(F.struct("pos", "review_id"))).alias("_members"))
    table = df.sparkSession.createDataFrame([(c, [i for i, _ in e], [j for _, j in e]) for c, e in patterns.items() if e], "_code int, _i array<int>, _j array<int>")
    met = packs.select(F.col("_s._code").alias("_code"), F.col("_members.review_id").alias("_ids")).join(F.broadcast(table), "_code")
    links = F.zip_with("_i", "_j", lambda i, j: F.struct(F.get("_ids", i).alias("src"), F.get("_ids", j).alias("dst")))
    return met.select(F.explode(links).alias("_e")).select("_e.src", "_e.dst").where("src IS NOT NULL AND dst IS NOT NULL")


def collapsed(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst), of the highest type."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.max("edge_type").alias("edge_type"))


def edge_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per type 0 to 2: directed and undirected edges, mean degree over all nodes, nodes without an edge of the type."""
    types = edges.sparkSession.range(3).select(F.col("id").cast("int").alias("edge_type"))
    directed = edges.groupBy("edge_type").agg(F.count("*").alias("directed_edges"))
    undirected = edges.select("edge_type", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy("edge_type").agg(F.count("*").alias("undirected_edges"))
    ends = edges.select("edge_type", F.explode(F.array("src", "dst")).alias("n")).distinct().groupBy("edge_type").agg(F.count("*").alias("touched"))
    n = nodes.agg(F.count("*").alias("n"))
    t = types.join(directed, "edge_type", "left").join(undirected, "edge_type", "left").join(ends, "edge_type", "left").fillna(0).crossJoin(F.broadcast(n))
    return t.select("edge_type", "directed_edges", "undirected_edges", (F.col("directed_edges") / F.col("n")).alias("mean_degree"), (F.col("n") - F.col("touched")).alias("isolated_nodes"))


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of self-loops, repeats, unknown ends and unknown types; all 0 in a sound table.

    Ends are counted before they meet the nodes, so one of very many edges is one row there.
    """
    ids = nodes.select(F.col("review_id").alias("_id"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("_id")).groupBy("_id").agg(F.count("*").alias("_n"))
    lost = ends.join(ids, "_id", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("unknown_ends"))
    repeats = edges.groupBy("src", "dst", "edge_type").agg((F.count("*") - 1).alias("r")).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("repeats"))
    own = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.count_if(~F.col("edge_type").isin(0, 1, 2)).alias("unknown_types"))
    return own.crossJoin(repeats).crossJoin(lost)


def neighbour_means(edges: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """One hop of message passing: per node and edge type, the mean of its in-neighbours' columns."""
    sent = edges.join(values.select(F.col("review_id").alias("src"), *columns), "src")
    return sent.groupBy(F.col("dst").alias("review_id"), "edge_type").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
