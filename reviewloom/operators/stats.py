"""Ranking metrics and test statistics as aggregates over distinct values."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.sources import cut


def running(counts: DataFrame, value: str, sums: list[str], descending: bool = False, ranges: int = 128, keys: list[str] | None = None) -> DataFrame:
    """Adds upto_<s> for each of ``sums``: its total over all rows up to this one in the order of ``value``, which is distinct
    (within ``keys``, if any are given, which are few).

    A window over all values would run in one task. Values are cut into ranges at approximate quantiles, sums run inside
    each range, and what the ranges before hold, at most ``ranges`` rows a key, is broadcast. Rows whose sums are all 0 go.
    The rows are written once, as they are read three times.
    """
    keys = keys or []
    counts = cut(counts.where(reduce(lambda a, b: a + b, [F.col(c) for c in sums]) > 0))
    cuts = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(20 * ranges))).alias("_cuts"))
    met = counts.join(F.broadcast(cuts), keys) if keys else counts.crossJoin(F.broadcast(cuts))
    ranged = met.withColumn("_range", F.when(F.col(value).isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(value))))).drop("_cuts")
    order = (lambda c: F.desc(c)) if descending else F.asc
    before = Window.partitionBy(*keys).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in sums]).select(*keys, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(order(value))
    out = ranged.join(F.broadcast(whole), [*keys, "_range"])
    return out.withColumns({f"upto_{c}": F.sum(c).over(inside) + F.col(f"_before_{c}") for c in sums}).drop("_range", *[f"_before_{c}" for c in sums])


#: Ranges of values that an exact quantile is first looked for in.
RANGES = 64


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], keys: list[str] | None = None) -> DataFrame:
    """A row per group of ``keys`` (one row without) with the exact quantile of a value under each name, interpolated between
    neighbours as ``percentile`` does; null for a group or value without a number.

    No task holds all values of one: distinct values are counted, approximate quantiles cut each value into RANGES, the
    counts of ranges tell in which the wanted places lie, and only these ranges are put in order, each in its own task.
    The counts are written once, as they are read three times. The same value is counted once for all its quantiles.
    """
    keys = keys or []
    values: dict[str, tuple[int, Column]] = {}
    for column, _ in wanted.values():
        values.setdefault(str(column), (len(values), column))
    asked = [(name, values[str(c)][0], float(q)) for name, (c, q) in wanted.items()]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), c.cast("double").alias("_v")) for i, c in values.values()]))
    by = [*keys, "_i"]
    counts = cut(df.select(*keys, each.alias("_x")).select(*keys, "_x.*").where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_c")))
    cuts = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(20 * RANGES))).alias("_cuts"))
    ranged = counts.join(cuts.hint("broadcast") if not keys else cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_here"))
    whole = whole.withColumns({"_before": F.coalesce(F.sum("_here").over(before), F.lit(0)), "_n": F.sum("_here").over(Window.partitionBy(*by))})
    names = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(i).alias("_i"), F.lit(q).alias("_q")) for n, i, q in asked])))
    place = F.round(F.col("_q") * (F.col("_n") - 1), 9)
    ends = F.explode(F.array(F.struct(F.floor(place).alias("_at"), (1 - (place - F.floor(place))).alias("_share")), F.struct(F.ceil(place).alias("_at"), (place - F.floor(place)).alias("_share"))))
    places = whole.join(F.broadcast(names), "_i").select(*by, "_range", "_here", "_before", "_name", ends.alias("_e")).where("_e._at >= _before AND _e._at < _before + _here")
    some = places.select(*by, "_range", "_before").distinct()
    inside = Window.partitionBy(*by, "_range").orderBy("_v")
    ordered = ranged.join(some, [*by, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside)).select(*by, "_range", "_v", "_c", "_upto")
    met = ordered.join(places.select(*by, "_range", "_name", "_e"), [*by, "_range"]).where("_e._at < _upto AND _e._at >= _upto - _c")
    out = met.groupBy(*keys).agg(*[F.sum(F.when(F.col("_name") == n, F.col("_v") * F.col("_e._share"))).alias(n) for n in wanted])
    return out


def _gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by the series below a + 1 and the continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    value, n = 0.0, 300
    for i in range(n, 0, -1):
        value = i * (i - a) / (x + 2 * i + 1 - a - value)
    return front / (x + 1 - a - value)


def _t_tail(t: float, dof: float) -> float:
    """Both tails of Student's distribution: 1 less the series of the incomplete beta function, or the normal tails far out."""
    x, b = t * t / (dof + t * t), dof / 2
    if t * t > 600:
        return 0.0
    term = total = 1.0
    n = 0
    while term > total * 1e-16 and n < 100_000:
        term *= x * (0.5 + b + n) / (1.5 + n)
        total += term
        n += 1
    front = math.exp(0.5 * math.log(x) + b * math.log1p(-x) + math.lgamma(b + 0.5) - math.lgamma(b) - math.lgamma(0.5)) * 2 if x > 0 else 0.0
    return max(0.0, 1 - front * total)


def _helper(f):
    """A function of one or two numbers for result tables of a few rows; null in, null out."""
    return F.udf(lambda *xs: None if any(x is None for x in xs) else float(f(*xs)), "double")


def chi_square_p(chi2: Column, dof: Column) -> Column:
    return _helper(lambda x, k: _gamma_tail(k / 2, x / 2) if k > 0 else 1.0)(chi2, dof)


def t_p(t: Column, dof: Column) -> Column:
    return _helper(_t_tail)(t, dof)


def normal_p(z: Column) -> Column:
    """Both tails of the normal distribution."""
    return _helper(lambda z: math.erfc(abs(z) / math.sqrt(2)))(z)


#: Samples of which the smaller has so many values at most get Mann-Whitney's exact distribution, if no value is tied; and
#: the larger one so many, the exact distribution of the two-sample distance. Fixed values.
EXACT_RANKS, EXACT_DISTANCE = 8, 10_000


def rank_sum_tails(u: float, n1: int, n2: int) -> float:
    """Both tails of U without ties. The orders with U = k are the coefficients of a Gaussian binomial, built factor by
    factor: times 1 - x ** (n2 + i), over 1 - x ** i."""
    small, other = int(min(n1, n2)), int(max(n1, n2))
    ways = np.zeros(small * other + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        step = other + i
        if step < len(ways):
            ways[step:] = ways[step:] - ways[:-step]
        for start in range(i):
            ways[start::i] = ways[start::i].cumsum()
    low = int(math.floor(min(u, small * other - u)))
    return float(min(1.0, 2 * ways[: low + 1].sum() / ways.sum()))


def distance_tail(distance: float, n1: int, n2: int) -> float:
    """The chance that two samples of one distribution lie so far apart or farther: of all ways to merge them, the share
    that leaves the band, counted along diagonals as a chance so that no number grows."""
    a, b = int(min(n1, n2)), int(max(n1, n2))
    i = np.arange(a + 1)
    inside = np.zeros(a + 1)
    inside[0] = 1.0
    for s in range(1, a + b + 1):
        j = s - i
        moved = inside * np.clip(j, 0, None) / s
        moved[1:] += inside[:-1] * i[1:] / s
        moved[(j < 0) | (j > b) | (np.abs(i / a - j / b) >= distance - 1e-12)] = 0.0
        inside = moved
    return float(1 - inside[a])


def kolmogorov_p(distance: Column, n1: Column, n2: Column) -> Column:
    """Limit distribution of the two-sample distance."""
    x2 = distance * distance * n1 * n2 / (n1 + n2)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x2))
    return F.when(x2 < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """Adds avg_rank, ties sharing their mean rank. Counts per value are summed; no row is ranked by itself."""
    counts = df.groupBy(column).agg(F.count("*").alias("_c"))
    ranks = running(counts, column, ["_c"]).select(F.col(column).alias("_value"), (F.col("upto__c") - F.col("_c") + (F.col("_c") + 1) / 2).alias("avg_rank"))
    return df.join(ranks, df[column].eqNullSafe(ranks["_value"])).drop("_value")


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("v")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise: ties form one step; null if only one class is there."""
    steps = running(_by_score(df, score, label), "v", ["pos", "neg"], descending=True).withColumns({"tp": F.col("upto_pos"), "all": F.col("upto_pos") + F.col("upto_neg")})
    return steps.agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum(F.col("pos") * F.col("tp") / F.col("all")) / F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    pairs = running(_by_score(df, score, label), "v", ["pos", "neg"]).withColumn("won", F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2))
    n = F.sum("pos") * F.sum("neg")
    return pairs.agg(F.when(n > 0, F.sum("won") / n).alias("roc_auc"))


def confusion(df: DataFrame, score: str, label: str, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp, precision, recall, macro_f1 and accuracy at a threshold, 0 where a denominator is."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    t = df.groupBy(*(keys or [])).agg(F.count_if(~hit & ~real).alias("tn"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(hit & real).alias("tp"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1 = lambda good, other, missed: over(2 * good, 2 * good + other + missed)
    return t.withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2, "accuracy": over(tp + tn, tp + tn + fp + fn)})


def best_threshold(df: DataFrame, score: str, label: str, rate_cap: bool = False) -> DataFrame:
    """Of 0.05 to 0.95 by 0.01, the first of best macro F1; 0.5 if none qualifies.

    Rows are counted by the number of thresholds they reach, so 91 thresholds cost one pass. With ``rate_cap`` the
    predicted share may not exceed the prevalence.
    """
    reached = F.least(F.greatest(F.floor(F.round(F.col(score) * 100, 9)) - 4, F.lit(0)), F.lit(91))
    counts = df.groupBy(reached.alias("r")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    grid = df.sparkSession.range(1, 92).select(F.col("id").alias("t"))
    sums = grid.crossJoin(F.broadcast(counts)).groupBy("t").agg(
        F.sum(F.when(F.col("r") >= F.col("t"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("r") >= F.col("t"), F.col("q")).otherwise(0)).alias("fp"), F.sum("p").alias("ps"), F.sum("q").alias("qs")
    )
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("ps") - F.col("tp"), F.col("qs") - F.col("fp")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = (over(2 * tp, 2 * tp + fp + fn) + over(2 * tn, 2 * tn + fn + fp)) / 2
    rows = sums.select(((F.col("t") + 4) / 100).alias("threshold"), F.round(f1, 12).alias("macro_f1"), (tp + fp <= F.col("ps")).alias("in_rate"))
    rows = rows.where("in_rate") if rate_cap else rows
    best = rows.agg(F.min(F.struct((-F.col("macro_f1")).alias("m"), "threshold")).alias("b"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"), (-F.col("b.m")).alias("macro_f1"))


def evaluated(df: DataFrame, score: str, label: str, split: str = "split") -> DataFrame:
    """Test rows at the threshold of best macro F1 on validation rows: the threshold, ``confusion``, average precision, AUC."""
    valid, test = df.where(F.col(split) == "valid"), df.where(F.col(split) == "test").withColumn(score, F.round(score, 9))
    chosen = best_threshold(valid, score, label).select("threshold")
    hits = test.crossJoin(F.broadcast(chosen)).select(label, "threshold", (F.col(score) >= F.col("threshold")).cast("double").alias("_hit"))
    one = confusion(hits, "_hit", label, 0.5, ["threshold"])
    return one.crossJoin(average_precision(test, score, label)).crossJoin(roc_auc(test, score, label))


def odds_ratio(df: DataFrame, flag: str, label: str) -> DataFrame:
    """Odds ratio of the label by a flag with 0.5 added to each cell, and the label's rate on both sides."""
    on, real = F.col(flag) == 1, F.col(label) == 1
    t = df.agg(F.count_if(on & real).alias("a"), F.count_if(on & ~real).alias("b"), F.count_if(~on & real).alias("c"), F.count_if(~on & ~real).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    return t.select(F.lit(flag).alias("feature"), ((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))).alias("odds_ratio"), (a / F.greatest(a + b, F.lit(1))).alias("rate_on"), (c / F.greatest(c + d, F.lit(1))).alias("rate_off"))


def two_groups(df: DataFrame, value: str, label: str) -> DataFrame:
    """Cohen's d (pooled sample variance), Welch's t, Cliff's delta and Mann-Whitney U of a value, label 1 against 0.

    welch_p takes Welch's degrees of freedom; mann_whitney_p is exact for a sample of EXACT_RANKS values at most without
    ties, else the normal limit with ties and continuity.
    """
    one, two = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    m = df.agg(*[f(c).alias(n + s) for s, c in (("1", one), ("0", two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    auc = roc_auc(df, value, label)
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    gap = F.col("m1") - F.col("m0")
    e1, e0, n = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0"), F.col("n1") + F.col("n0")
    ties = df.where(F.col(label).isin(0, 1) & F.col(value).isNotNull()).groupBy(value).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    t = gap / F.sqrt(e1 + e0)
    dof = (e1 + e0) * (e1 + e0) / (e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1))
    product = F.col("n1") * F.col("n0")
    spread = F.sqrt(product / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest((F.abs(F.col("roc_auc") - 0.5) * product - 0.5) / spread, F.lit(0.0))
    # A function in Python is called whatever the branch it stands in: what it must not count has to come as null.
    exact = (F.least("n1", "n0") <= EXACT_RANKS) & (F.col("ties") == 0)
    return m.crossJoin(auc).crossJoin(ties).select(
        F.lit(value).alias("feature"), (gap / pooled).alias("cohens_d"), t.alias("welch_t"), t_p(t, dof).alias("welch_p"), (2 * F.col("roc_auc") - 1).alias("cliffs_delta"),
        (F.col("roc_auc") * product).alias("mann_whitney_u"), F.when(exact, _helper(rank_sum_tails)(F.when(exact, F.round(F.col("roc_auc") * product)), F.col("n1"), F.col("n0"))).otherwise(normal_p(z)).alias("mann_whitney_p"),
    )


def kolmogorov_smirnov(df: DataFrame, value: str, side: str, exact: bool = False) -> DataFrame:
    """Largest distance of the two cumulative distributions, side 1 against 0, and its p-value in the limit, or with
    ``exact`` the exact one where both sides have EXACT_DISTANCE values at most."""
    c = df.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(side) == 1).alias("a"), F.count_if(F.col(side) == 0).alias("b"))
    whole = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("upto_a") / F.col("na") - F.col("upto_b") / F.col("nb"))
    best = running(c, "v", ["a", "b"]).crossJoin(F.broadcast(whole)).groupBy("na", "nb").agg(F.max(gap).alias("ks_statistic"))
    p = kolmogorov_p(F.col("ks_statistic"), F.col("na"), F.col("nb"))
    if exact:
        small = F.greatest("na", "nb") <= EXACT_DISTANCE
        p = F.when(small, _helper(distance_tail)(F.when(small, F.col("ks_statistic")), F.col("na"), F.col("nb"))).otherwise(p)
    return best.select("ks_statistic", p.alias("p_value"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic (with Yates' correction at one degree of freedom), degrees of freedom, p-value and Cramer's V of two columns."""
    cells = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("o"))
    xs, ys = cells.groupBy("x").agg(F.sum("o").alias("nx")), cells.groupBy("y").agg(F.sum("o").alias("ny"))
    full = F.broadcast(xs).crossJoin(F.broadcast(ys)).join(cells, ["x", "y"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    size = xs.agg(F.count("*").alias("r"), F.sum("nx").alias("n")).crossJoin(ys.agg(F.count("*").alias("k")))
    t = full.crossJoin(F.broadcast(size)).withColumn("e", F.col("nx") * F.col("ny") / F.col("n")).withColumn("dof", (F.col("r") - 1) * (F.col("k") - 1))
    gap = F.abs(F.col("o") - F.col("e"))
    fixed = F.when(F.col("dof") == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    s = t.groupBy("dof", "n", "r", "k").agg(F.sum(fixed * fixed / F.col("e")).alias("chi2"))
    return s.select("chi2", "dof", chi_square_p(F.col("chi2"), F.col("dof")).alias("p_value"), F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "k") - 1))).alias("cramers_v"))


def feature_screen(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Pearson and Spearman correlation with a 0/1 label, the AUC and the average precision of each column.

    One pass counts rows per column and value; ranks and sums are taken over these counts, in ranges of values.
    """
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    counts = long.groupBy("x.feature", "x.v").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    steps = running(counts, "v", ["n", "p"], keys=["feature"])
    total = steps.groupBy("feature").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    ranked = steps.join(F.broadcast(total), "feature").withColumn("k", F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2)
    # From the top down: rows with this value or a higher one, and those of them with the label.
    above, hits = F.col("_n") - F.col("upto_n") + F.col("n"), F.col("_p") - F.col("upto_p") + F.col("p")
    n, p = F.sum("n"), F.sum("p")

    def correlation(x: str):
        s, ss, sy = F.sum(F.col("n") * F.col(x)), F.sum(F.col("n") * F.col(x) * F.col(x)), F.sum(F.col("p") * F.col(x))
        return F.try_divide(n * sy - s * p, F.sqrt((n * ss - s * s) * (n * p - p * p)))  # null for a column that is all one value

    auc = F.try_divide(F.sum(F.col("p") * F.col("k")) - p * (p + 1) / 2, p * (n - p))
    precision = F.try_divide(F.sum(F.col("p") * hits / above), p)
    return ranked.groupBy("feature").agg(correlation("v").alias("pearson"), correlation("k").alias("spearman"), auc.alias("auc"), precision.alias("average_precision"))


def odds_table(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """``odds_ratio`` of several flags in one pass."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in flags])).alias("x"))
    on, real = F.col("x.v") == 1, F.col("y") == 1
    t = long.groupBy("x.feature").agg(F.count_if(on & real).alias("a"), F.count_if(on & ~real).alias("b"), F.count_if(~on & real).alias("c"), F.count_if(~on & ~real).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    return t.select("feature", ((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))).alias("odds_ratio"), (a / F.greatest(a + b, F.lit(1))).alias("rate_on"), (c / F.greatest(c + d, F.lit(1))).alias("rate_off"))
