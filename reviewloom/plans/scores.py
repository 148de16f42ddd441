"""Queries of metrics, statistics and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewloom.operators import stats
from reviewloom.plans.base import FEATURES_SQL, features, register, rounded
from reviewloom.sources import reviews, standardize

_F = f"WITH {FEATURES_SQL}"
#: A fixed score of each review in [0, 1): what a model's probability is to the metrics.
_SCORE = "(abs(rating_norm) * 37 + prior_product_review_count % 61) / 100"
_S = _F + f", s AS (SELECT *, {_SCORE} AS score FROM f)"


def _scored(s, d):
    f = features(s, d)
    return f.select("review_id", "is_fake", "date", "extreme_rating", "rating_bucket", "word_len", "rating", ((F.abs("rating_norm") * 37 + F.col("prior_product_review_count") % 61) / 100).alias("score"))


def _confusion_sql(t: str, keys: str = "") -> str:
    by = f"GROUP BY {keys}" if keys else ""
    return f""", m AS (SELECT {keys + ',' if keys else ''} count(*) FILTER (score < {t} AND is_fake = 0) AS tn, count(*) FILTER (score >= {t} AND is_fake = 0) AS fp, count(*) FILTER (score < {t} AND is_fake = 1) AS fn, count(*) FILTER (score >= {t} AND is_fake = 1) AS tp FROM s {by})
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 6) AS macro_f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM m"""


register("me01", lambda s, d: rounded(stats.confusion(_scored(s, d), "score", "is_fake", 0.5)), _S + _confusion_sql("0.5"))
register("me05", lambda s, d: rounded(stats.confusion(_scored(s, d), "score", "is_fake", 0.794, ["rating_bucket"])), _S + _confusion_sql("0.794", "rating_bucket"))
_AUC = "(SELECT (sum(k) FILTER (is_fake = 1) - n1 * (n1 + 1) / 2) / (n0 * n1) FROM (SELECT is_fake, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2 AS k, sum(is_fake) OVER () AS n1, sum(1 - is_fake) OVER () AS n0 FROM s) GROUP BY n0, n1)"
register("me02", lambda s, d: rounded(stats.average_precision(_scored(s, d), "score", "is_fake")), _S + ", g AS (SELECT score, sum(is_fake) AS p, count(*) AS c FROM s GROUP BY score), h AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS n FROM g) SELECT round(sum(p * tp / n) / sum(p), 6) AS average_precision FROM h")
register("me03", lambda s, d: rounded(stats.roc_auc(_scored(s, d), "score", "is_fake")), _S + f" SELECT round({_AUC.format(v='score')}, 6) AS roc_auc")
register(
    "me04",
    lambda s, d: rounded(stats.best_threshold(_scored(s, d), "score", "is_fake")),
    _S + """, g AS (SELECT (t + 4) / 100 AS t FROM range(1, 92) x(t)), m AS (SELECT t, sum(is_fake) FILTER (round(score, 9) >= t) AS tp, sum(1 - is_fake) FILTER (round(score, 9) >= t) AS fp, sum(is_fake) AS p, sum(1 - is_fake) AS q FROM s, g GROUP BY t),
k AS (SELECT t, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, p - coalesce(tp, 0) AS fn, q - coalesce(fp, 0) AS tn FROM m)
SELECT t AS threshold, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 6) AS macro_f1 FROM k
ORDER BY round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 12) DESC, t LIMIT 1""",
)
_TWO = _S + f""", m AS (SELECT count(*) FILTER (is_fake = 1) AS n1, count(*) FILTER (is_fake = 0) AS n0, avg(word_len) FILTER (is_fake = 1) AS m1, avg(word_len) FILTER (is_fake = 0) AS m0, var_samp(word_len) FILTER (is_fake = 1) AS v1, var_samp(word_len) FILTER (is_fake = 0) AS v0, {_AUC.format(v='word_len')} AS auc FROM s)
SELECT 'word_len' AS feature, """
for _name, _column, _sql in (
    ("ts02", "cohens_d", "round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6)"),
    ("ts03", "cliffs_delta", "round(2 * auc - 1, 6)"),
):
    register(_name, lambda s, d, c=_column: rounded(stats.two_groups(_scored(s, d), "word_len", "is_fake").select("feature", c)), _TWO + f"{_sql} AS {_column} FROM m")


def _tail_sql(a: str, x: str) -> str:
    """Upper incomplete gamma function as 1 less a power series; 0 where the series would need too many terms."""
    return f"CASE WHEN {x} <= 0 THEN 1 WHEN {x} > 300 THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 1500), lambda n: exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1))))) END"


register(
    "ts05",
    lambda s, d: rounded(stats.two_groups(_scored(s, d), "word_len", "is_fake").select("feature", "welch_t", "welch_p")),
    _TWO.replace("SELECT 'word_len' AS feature, ", ", q AS (SELECT (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) AS dof FROM m), q1 AS (SELECT t, t * t / (dof + t * t) AS x, dof / 2 AS b FROM q) ")
    + "SELECT 'word_len' AS feature, round(t, 6) AS welch_t, round(CASE WHEN x <= 0 THEN 1 WHEN t * t > 600 THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 1500), lambda n: exp((0.5 + n) * ln(x) + b * ln(1 - x) + lgamma(0.5 + b + n) - lgamma(1.5 + n) - lgamma(b))))) END, 6) AS welch_p FROM q1",
)
register(
    "ts06",
    lambda s, d: rounded(stats.two_groups(_scored(s, d), "word_len", "is_fake").select("feature", "mann_whitney_u", "mann_whitney_p")),
    _TWO.replace("SELECT 'word_len' AS feature, ", ", tc AS (SELECT count(*) AS c FROM s GROUP BY word_len), q AS (SELECT auc * n1 * n0 AS u, greatest((abs(auc - 0.5) * n1 * n0 - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - (SELECT sum(c * c * c - c) FROM tc) / ((n1 + n0) * (n1 + n0 - 1)))), 0) AS z FROM m), q1 AS (SELECT u, z * z / 2 AS x FROM q) ")
    + f"SELECT 'word_len' AS feature, round(u, 6) AS mann_whitney_u, round({_tail_sql('0.5', 'x')}, 6) AS mann_whitney_p FROM q1",
)
register(
    "ts04",
    lambda s, d: rounded(stats.odds_ratio(_scored(s, d), "extreme_rating", "is_fake")),
    _S + ", m AS (SELECT sum(extreme_rating * is_fake) AS a, sum(extreme_rating * (1 - is_fake)) AS b, sum((1 - extreme_rating) * is_fake) AS c, sum((1 - extreme_rating) * (1 - is_fake)) AS d FROM s) SELECT 'extreme_rating' AS feature, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio, round(a / greatest(a + b, 1), 6) AS rate_on, round(c / greatest(c + d, 1), 6) AS rate_off FROM m",
)
_CHI = """, o AS (SELECT {a} AS x, is_fake AS y, count(*) AS o FROM s GROUP BY ALL), e AS (SELECT x, y, sum(o) AS nx FROM o GROUP BY ALL),
xs AS (SELECT x, sum(o) AS nx FROM o GROUP BY x), ys AS (SELECT y, sum(o) AS ny FROM o GROUP BY y), z AS (SELECT count(*) AS r, sum(nx) AS n, (SELECT count(*) FROM ys) AS k FROM xs),
g9 AS (SELECT abs(coalesce(o.o, 0) - nx * ny / n) AS gap, nx * ny / n AS e, (r - 1) * (k - 1) AS dof, n, least(r, k) AS l FROM xs CROSS JOIN ys CROSS JOIN z LEFT JOIN o ON o.x = xs.x AND o.y = ys.y)
SELECT round(c, 6) AS chi2, dof, round({tail}, 6) AS p_value, round(sqrt(c / (n * (l - 1))), 6) AS cramers_v FROM (SELECT sum(power(CASE WHEN dof = 1 THEN gap - least(gap, 0.5) ELSE gap END, 2) / e) AS c, dof, n, l, c / 2 AS x, dof / 2 AS a FROM g9 GROUP BY dof, n, l)"""
register("ts01", lambda s, d: rounded(stats.chi_square(_scored(s, d), "rating", "is_fake")), _S + _CHI.format(a="rating", tail=_tail_sql("a", "x")))
register("ts01_yates", lambda s, d: rounded(stats.chi_square(_scored(s, d), "extreme_rating", "is_fake")), _S + _CHI.format(a="extreme_rating", tail=_tail_sql("a", "x")))
register(
    "ts08",
    lambda s, d: rounded(stats.kolmogorov_smirnov(_scored(s, d), "word_len", "is_fake")),
    _S + ", g AS (SELECT word_len AS v, sum(is_fake) AS a, sum(1 - is_fake) AS b FROM s GROUP BY word_len), h AS (SELECT abs(sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER ()) AS gap FROM g WINDOW w AS (ORDER BY v)) SELECT round(max(gap), 6) AS ks_statistic, round(CASE WHEN x < 0.04 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2 * k * k * x))))) END, 6) AS p_value FROM (SELECT max(gap) AS gap, power(max(gap), 2) * (SELECT sum(a) * sum(b) / (sum(a) + sum(b)) FROM g) AS x FROM h) GROUP BY x",
)

register("ts08_exact", lambda s, d: rounded(stats.kolmogorov_smirnov(_scored(s, d), "word_len", "is_fake", exact=True)))  # the distribution has no SQL

for _name, _key in {"ag07_rating": "rating", "ag07_month": "month"}.items():
    register(
        _name,
        lambda s, d, k=_key: rounded(features(s, d).groupBy(k).agg(F.count("*").alias("reviews"), F.sum("is_fake").alias("fake"), F.avg("is_fake").alias("fake_rate"))),
        _F + f" SELECT {_key}, count(*) AS reviews, CAST(sum(is_fake) AS BIGINT) AS fake, round(avg(is_fake), 6) AS fake_rate FROM f GROUP BY 1",
    )
def _lengths(f):
    points = stats.quantiles(f, {n: (F.col("char_len"), q) for n, q in (("median_chars", 0.5), ("p90", 0.9), ("p99", 0.99))}, ["is_fake"])
    return f.groupBy("is_fake").agg(F.avg("char_len").alias("mean_chars")).join(points, "is_fake", "left")


register(
    "ag08",
    lambda s, d: rounded(_lengths(features(s, d))),
    _F + " SELECT CAST(is_fake AS BIGINT) AS is_fake, round(avg(char_len), 6) AS mean_chars, round(median(char_len), 6) AS median_chars, round(quantile_cont(char_len, 0.9), 6) AS p90, round(quantile_cont(char_len, 0.99), 6) AS p99 FROM f GROUP BY is_fake",
)
register(
    "ag07_year",
    lambda s, d: rounded(features(s, d).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("reviews"), F.sum("is_fake").alias("fake"), F.avg("is_fake").alias("fake_rate"))),
    _F + " SELECT year(date) AS year, count(*) AS reviews, CAST(sum(is_fake) AS BIGINT) AS fake, round(avg(is_fake), 6) AS fake_rate FROM f GROUP BY 1",
)


def _week_days(s, d):
    """All seven days, those without reviews too."""
    got = features(s, d).groupBy("day_of_week").agg(F.count("*").alias("reviews"), F.sum("is_fake").alias("fake"), F.avg("is_fake").alias("fake_rate"))
    return rounded(s.range(7).select(F.col("id").alias("day_of_week")).join(got, "day_of_week", "left").fillna(0, ["reviews", "fake"]))


register("ag07_dow", _week_days, _F + " SELECT w.x AS day_of_week, count(f.review_id) AS reviews, CAST(coalesce(sum(is_fake), 0) AS BIGINT) AS fake, round(avg(is_fake), 6) AS fake_rate FROM range(7) w(x) LEFT JOIN f ON f.day_of_week = w.x GROUP BY 1")
#: Right-closed bins of text length, the first with its lower end; labels are an interface.
_CUTS = (0, 50, 100, 200, 500, 1000, 5000, 1_000_000)
_LABELS = [f"({'-0.001' if i == 0 else float(a)}, {float(b)}]" for i, (a, b) in enumerate(zip(_CUTS, _CUTS[1:], strict=False))]


def _histogram(s, d):
    dim = s.createDataFrame([(i, x) for i, x in enumerate(_LABELS)], "bin int, label string")
    binned = features(s, d).withColumn("bin", sum((F.when(F.col("char_len") > c, 1).otherwise(0) for c in _CUTS[1:]), F.lit(0)))
    got = binned.groupBy("bin").agg(F.count("*").alias("reviews"), F.avg("is_fake").alias("fake_rate"))
    return rounded(F.broadcast(dim).join(got, "bin", "left").select("label", F.coalesce("reviews", F.lit(0)).alias("reviews"), "fake_rate"))


register("ag09", _histogram, _F + f", g AS (SELECT {' + '.join(f'CAST(char_len > {c} AS INT)' for c in _CUTS[1:])} AS bin, is_fake FROM f) SELECT label, count(g.bin) AS reviews, round(avg(is_fake), 6) AS fake_rate FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(_LABELS))}) l(bin, label) LEFT JOIN g USING (bin) GROUP BY label")


def _crosstab(s, d):
    t = features(s, d).groupBy("rating").agg(F.count_if(F.col("is_fake") == 1).alias("fake"), F.count_if(F.col("is_fake") == 0).alias("real"))
    whole = Window.partitionBy()
    return rounded(t.withColumns({f"{c}_share": F.col(c) / F.sum(c).over(whole) for c in ("fake", "real")}))


register(
    "ag10",
    _crosstab,
    _F + ", g9 AS (SELECT rating, count(*) FILTER (is_fake = 1) AS fake, count(*) FILTER (is_fake = 0) AS real FROM f GROUP BY rating) SELECT *, round(fake / sum(fake) OVER (), 6) AS fake_share, round(real / sum(real) OVER (), 6) AS real_share FROM g9",
)
register(
    "ag11",
    lambda s, d: rounded(standardize(reviews(s, d)).groupBy("prod_id").agg(F.count("*").alias("reviews"), F.count_distinct("user_id").alias("users"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))),
    _F + " SELECT prod_id, count(*) AS reviews, count(DISTINCT user_id) AS users, min(date) AS first_date, max(date) AS last_date FROM r GROUP BY prod_id",
)


def _concentration(s, d):
    """Shares of the largest products, by how many products have each number of reviews: few rows, whatever the products."""
    per = standardize(reviews(s, d)).groupBy("prod_id").agg(F.count("*").alias("c"), F.sum("is_fake").alias("fake"))
    sizes = per.groupBy("c").agg(F.count("*").alias("m"), F.count_if(F.col("fake") > 0).alias("any"), F.count_if(F.col("fake") == F.col("c")).alias("every"))
    whole = Window.partitionBy()
    ranked = sizes.withColumns({"upto": F.sum("m").over(Window.orderBy(F.desc("c"))), "n": F.sum("m").over(whole)})
    taken = lambda p: F.greatest(F.least(F.ceil(F.col("n") * p) - (F.col("upto") - F.col("m")), F.col("m")), F.lit(0))
    shares = [(F.sum(taken(p) * F.col("c")) / F.sum(F.col("c") * F.col("m"))).alias(a) for p, a in ((0.01, "top1_share"), (0.1, "top10_share"))]
    return rounded(ranked.agg(*shares, (F.sum("any") / F.sum("m")).alias("share_with_fake"), F.sum("every").alias("all_fake")))


register(
    "ag12",
    _concentration,
    _F + ", g9 AS (SELECT count(*) AS c, sum(is_fake) AS fake, row_number() OVER (ORDER BY count(*) DESC, prod_id) AS k, count(*) OVER () AS n FROM r GROUP BY prod_id) SELECT round(sum(c) FILTER (k <= ceil(n * 0.01)) / sum(c), 6) AS top1_share, round(sum(c) FILTER (k <= ceil(n * 0.1)) / sum(c), 6) AS top10_share, round(count(*) FILTER (fake > 0) / count(*), 6) AS share_with_fake, count(*) FILTER (fake = c) AS all_fake FROM g9",
)
register("ag13", lambda s, d: standardize(reviews(s, d)).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("prod_id").alias("products")), _F + " SELECT count(DISTINCT user_id) AS users, count(DISTINCT prod_id) AS products FROM r")
_POINTS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
register("ag14", lambda s, d: rounded(stats.quantiles(features(s, d), {f"q{int(p * 100)}": (F.col("word_len"), p) for p in _POINTS})), _F + " SELECT " + ", ".join(f"round(quantile_cont(word_len, {p}), 6) AS q{int(p * 100)}" for p in _POINTS) + " FROM f")


def _entropy(s, d):
    c = standardize(reviews(s, d)).groupBy("prod_id", "rating").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("prod_id"))
    return rounded(c.select("prod_id", p.alias("p")).groupBy("prod_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("rating_entropy")))


register("ag15", _entropy, _F + ", g9 AS (SELECT prod_id, count(*) / sum(count(*)) OVER (PARTITION BY prod_id) AS p FROM r GROUP BY prod_id, rating) SELECT prod_id, round(-sum(p * log2(p)), 6) AS rating_entropy FROM g9 GROUP BY prod_id")
register(
    "ag16",
    lambda s, d: rounded(standardize(reviews(s, d)).groupBy("user_id", "prod_id").agg(F.count("*").alias("n"), F.datediff(F.max("date"), F.min("date")).alias("span_days")).where("n > 1")),
    _F + " SELECT user_id, prod_id, count(*) AS n, CAST(max(date) - min(date) AS BIGINT) AS span_days FROM r GROUP BY ALL HAVING count(*) > 1",
)
register(
    "ag26",
    lambda s, d: rounded(features(s, d).groupBy((F.col("prior_user_review_count") > 0).alias("user_seen"), (F.col("prior_product_review_count") > 0).alias("product_seen")).agg(F.count("*").alias("reviews"), F.avg("is_fake").alias("fake_rate"))),
    _F + " SELECT prior_user_review_count > 0 AS user_seen, prior_product_review_count > 0 AS product_seen, count(*) AS reviews, round(avg(is_fake), 6) AS fake_rate FROM f GROUP BY ALL",
)
register(
    "so02",
    lambda s, d: rounded(standardize(reviews(s, d)).groupBy("prod_id").agg(F.count("*").alias("reviews"), F.avg("is_fake").alias("fake_rate")).where("reviews >= 10").orderBy(F.desc("fake_rate"), "prod_id").limit(10)),
    _F + " SELECT prod_id, count(*) AS reviews, round(avg(is_fake), 6) AS fake_rate FROM r GROUP BY prod_id HAVING count(*) >= 10 ORDER BY avg(is_fake) DESC, prod_id LIMIT 10",
)
