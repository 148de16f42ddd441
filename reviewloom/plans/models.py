"""Queries of anchors, model inputs, checks and label diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewloom.functions import cosine, quartile
from reviewloom.operators import anchors, history, matrix, stats, units
from reviewloom.plans.base import FEATURES_SQL, features, register, rounded, sql_columns
from reviewloom.plans.edges import _TYPED, typed_edges
from reviewloom.plans.reviews import _SPLIT
from reviewloom.plans.scores import _S, _confusion_sql, _scored
from reviewloom.sources import cut, reviews, standardize, table

_F = f"WITH {FEATURES_SQL}"


def _nodes(s, d):
    return standardize(reviews(s, d))


def _split(s, d):
    return units.temporal_split(features(s, d))


def train_documents(s, d):
    """Ids of the documents of training reviews, written once; the split asks for no feature."""
    return cut(units.temporal_split(_nodes(s, d)).where("split = 'train'").select("doc_id").distinct())


_PARTS = _F + f", p0 AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM f), p1 AS (SELECT *, {_SPLIT} AS split FROM p0)"

register(
    "wn11",
    lambda s, d: rounded(anchors.neighbour_gaps(_nodes(s, d))),
    _F + """, g AS (SELECT review_id, CAST(date - lag(date) OVER w AS BIGINT) AS prev_gap_days, CAST(lead(date) OVER w - date AS BIGINT) AS next_gap_days FROM r WINDOW w AS (PARTITION BY user_id ORDER BY date, review_id))
SELECT *, CAST(coalesce(prev_gap_days <= 7, false) OR coalesce(next_gap_days <= 7, false) AS BIGINT) AS neighbour_7d, CAST(coalesce(prev_gap_days <= 30, false) OR coalesce(next_gap_days <= 30, false) AS BIGINT) AS neighbour_30d FROM g""",
)
register(
    "wn15",
    lambda s, d: anchors.recent_context(_nodes(s, d).withColumn("seed", (F.col("rating") == 1).cast("long")), "seed", "user_id", 3).where("is_context = 1").select("review_id"),
    _F + ", g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) AS k FROM r) SELECT DISTINCT a.review_id FROM g a JOIN g b ON a.user_id = b.user_id AND b.k - a.k BETWEEN 1 AND 3 WHERE a.rating <> 1 AND b.rating = 1",
)
_TRIPLE = """, g0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) - 1 AS pos FROM r), g AS (SELECT *, min(pos) OVER (PARTITION BY user_id, date) AS n FROM g0),
gm AS (SELECT a.review_id, avg(b.rating) AS mean FROM g a JOIN g b ON a.user_id = b.user_id AND b.date < a.date GROUP BY 1),
g1 AS (SELECT a.review_id, 'recent' AS role, b.review_id AS chosen FROM g a JOIN g b ON a.user_id = b.user_id AND b.pos = a.n - 1
  UNION ALL SELECT a.review_id, 'mid', b.review_id FROM g a JOIN g b ON a.user_id = b.user_id AND a.n >= 2 AND b.pos = (a.n - 1) // 2
  UNION ALL SELECT review_id, 'baseline', chosen FROM (SELECT a.review_id, b.review_id AS chosen FROM g a JOIN gm USING (review_id) JOIN g b ON a.user_id = b.user_id AND a.n >= 2 AND b.pos < greatest(1, a.n // 2) AND b.pos <> a.n - 1 AND b.pos <> (a.n - 1) // 2
    QUALIFY row_number() OVER (PARTITION BY a.review_id ORDER BY round(abs(b.rating - mean), 9), b.pos) = 1))"""
register("wn17", lambda s, d: anchors.prior_triple(_nodes(s, d), "user_id"), _F + _TRIPLE + " SELECT * FROM g1")
register(
    "ed03",
    lambda s, d: anchors.segmented_anchors(_nodes(s, d), "user_id", 5),
    _F + """, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) - 1 AS pos FROM r), g1 AS (
  SELECT review_id AS dst, user_id, unnest([pos - 1, pos // 2, 0, 0, (pos - 1) // 4, (pos - 1) * 2 // 4, (pos - 1) * 3 // 4, pos - 1]) AS spot, unnest(range(8)) AS o FROM g WHERE pos > 5),
g2 AS (SELECT dst, user_id, spot FROM g1 GROUP BY dst, user_id, spot QUALIFY row_number() OVER (PARTITION BY dst ORDER BY min(o)) <= 5),
g3 AS (SELECT * FROM g2 UNION ALL SELECT a.review_id, a.user_id, b.pos FROM g a JOIN g b ON a.user_id = b.user_id AND b.pos < a.pos AND a.pos <= 5)
SELECT g.review_id AS src, dst FROM g3 JOIN g ON g.user_id = g3.user_id AND g.pos = g3.spot""",
)
register(
    "ed20",
    lambda s, d: rounded(_context_edges(s, d)),
    _F + _TRIPLE + " SELECT chosen AS src, review_id AS dst, CAST(CASE WHEN role = 'baseline' THEN 2 ELSE 0 END AS BIGINT) AS edge_type FROM g1",
)


def _context_edges(s, d):
    t = anchors.prior_triple(_nodes(s, d), "user_id")
    return t.select(F.col("chosen").alias("src"), F.col("review_id").alias("dst"), F.when(F.col("role") == "baseline", 2).otherwise(0).alias("edge_type"))


register("ed17", lambda s, d: rounded(typed_edges(s, d).orderBy("edge_type", "src", "dst")), _TYPED + " SELECT src, dst, CAST(edge_type AS BIGINT) AS edge_type FROM te ORDER BY edge_type, src, dst")
register("st08", lambda s, d: typed_edges(s, d).agg(F.count_distinct(F.struct(F.least("src", "dst"), F.greatest("src", "dst"))).alias("pairs")), _TYPED + " SELECT count(DISTINCT (least(src, dst), greatest(src, dst))) AS pairs FROM te")


def _quartiles(s, d):
    u = units.product_week_units(features(s, d))
    w = Window.orderBy("growth_ratio_30d", "prod_id", "week")  # units, one row per product and week
    return u.select("prod_id", "week", quartile(F.row_number().over(w), F.count("*").over(Window.partitionBy())).alias("growth_quartile"))


register(
    "wn14",
    lambda s, d: rounded(_quartiles(s, d)),
    _F + """, q AS (SELECT prod_id, week, count(*) / (median(product_reviews_last_30d) / 30 * 7 + 1.0) AS g FROM f GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY g, prod_id, week) AS k, count(*) OVER () AS n FROM q),
c4 AS (SELECT quantile_cont(k, 0.25) AS a, quantile_cont(k, 0.5) AS b, quantile_cont(k, 0.75) AS c FROM k)
SELECT prod_id, week, CAST(CASE WHEN k <= c4.a THEN 0 WHEN k <= c4.b THEN 1 WHEN k <= c4.c THEN 2 ELSE 3 END AS BIGINT) AS growth_quartile FROM k, c4""",
)
_WEEKS = ["prod_id", "rating_direction", "week"]
register(
    "ag05",
    lambda s, d: rounded(features(s, d).groupBy(*_WEEKS).agg(F.count("*").alias("n"), F.sum("is_new_user_at_review_time").alias("new_users"), F.sum("short_review_flag").alias("short"), F.sum("word_len").alias("words"))),
    _F + " SELECT prod_id, CAST(rating_direction AS BIGINT) AS rating_direction, week, CAST(c AS BIGINT) AS n, CAST(new AS BIGINT) AS new_users, CAST(short AS BIGINT) AS short, CAST(words AS BIGINT) AS words FROM w0",
)
register(
    "ag17",
    lambda s, d: rounded(features(s, d).groupBy("text_hash").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("prod_id").alias("products"), F.array_join(F.sort_array(F.collect_set("rating")).cast("array<string>"), ",").alias("ratings")).where("n > 1").orderBy(F.desc("n"), "text_hash").limit(10)),
    _F + " SELECT text_hash, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT prod_id) AS products, array_to_string(list_sort(list(DISTINCT rating)), ',') AS ratings FROM f GROUP BY text_hash HAVING count(*) > 1 ORDER BY n DESC, text_hash LIMIT 10",
)
register(
    "ag18",
    lambda s, d: rounded(stats.quantiles(_split(s, d).where("split = 'train'"), {"q25": (F.col("word_len"), 0.25), "median": (F.col("word_len"), 0.5)}, ["rating_bucket"])),
    _PARTS + " SELECT rating_bucket, round(quantile_cont(word_len, 0.25), 6) AS q25, round(median(word_len), 6) AS median FROM p1 WHERE split = 'train' GROUP BY 1",
)
register(
    "ag19",
    lambda s, d: rounded(stats.quantiles(_split(s, d).where("split = 'train'"), {f"q{int(p * 100)}": (F.col("word_len"), p) for p in (0.1, 0.25, 0.75, 0.9)})),
    _PARTS + " SELECT " + ", ".join(f"round(quantile_cont(word_len, {p}), 6) AS q{int(p * 100)}" for p in (0.1, 0.25, 0.75, 0.9)) + " FROM p1 WHERE split = 'train'",
)
register("ag20", lambda s, d: table(s, d, "documents").agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in ("text", "lang", "source")]), "SELECT count(*) FILTER (text IS NULL) AS text_missing, count(*) FILTER (lang IS NULL) AS lang_missing, count(*) FILTER (source IS NULL) AS source_missing FROM documents")


def _label_rates(s, d):
    rate = lambda k: F.avg("is_fake").over(Window.partitionBy(k))
    return _nodes(s, d).select("review_id", "is_fake", rate("user_id").alias("user_fake_rate"), rate("prod_id").alias("product_fake_rate"))


_RATES = _F + ", s AS (SELECT review_id, is_fake, avg(is_fake) OVER (PARTITION BY user_id) AS user_fake_rate, avg(is_fake) OVER (PARTITION BY prod_id) AS product_fake_rate FROM r)"
register("ag27", lambda s, d: rounded(_label_rates(s, d).drop("is_fake")), _RATES + " SELECT review_id, round(user_fake_rate, 6) AS user_fake_rate, round(product_fake_rate, 6) AS product_fake_rate FROM s")
_LEAKY = ["user_fake_rate", "product_fake_rate"]
#: The twelve features of the screen, in their order.
_SCREENED = {
    "rating": "rating", "extreme": "extreme_rating", "positive": "CAST(rating >= 4 AS INT)", "negative": "CAST(rating <= 2 AS INT)", "char_len": "char_len", "word_len": "word_len", "upper_ratio": "upper_ratio",
    "exclam": "exclamation_count", "question": "question_count", "dollar": "dollar", "user_total_reviews": "user_total_reviews", "prod_total_reviews": "prod_total_reviews",
}
_RATIO_FLAGS = ["extreme_rating", "short_review_flag", "is_new_user_at_review_time", "weak_product_prior_count_flag", "has_prior_user_review_7d", "numeric_token_flag", "new_user_short_extreme_flag"]


def _screen_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN min({c}) < max({c}) THEN round(corr({c}, is_fake), 6) END AS pearson, CASE WHEN min({c}) < max({c}) THEN round(corr(k, is_fake), 6) END AS spearman, round((sum(k * is_fake) - sum(is_fake) * (sum(is_fake) + 1) / 2) / (sum(is_fake) * sum(1 - is_fake)), 6) AS auc, round(sum(is_fake * hits / above) / sum(is_fake), 6) AS average_precision "
        f"FROM (SELECT {c}, is_fake, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS k, count(*) OVER (ORDER BY {c} DESC) AS above, sum(is_fake) OVER (ORDER BY {c} DESC) AS hits FROM s)"
        for c in columns
    )


def _rounded_screen(df, columns):
    """Values to 9 places, so that the last bits of a double neither make nor break ties."""
    return rounded(stats.feature_screen(df.select("is_fake", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in columns]), columns, "is_fake"))


register("ts10", lambda s, d: _rounded_screen(_label_rates(s, d), _LEAKY), _RATES.replace(", s AS (SELECT", ", s1 AS (SELECT") + ", s AS (SELECT is_fake, " + ", ".join(f"round({c}, 9) AS {c}" for c in _LEAKY) + " FROM s1) " + _screen_sql(_LEAKY))
def _screened(s, d):
    dollars = table(s, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("$")))).alias("dollar"))
    total = lambda k: F.count("*").over(Window.partitionBy(k))
    f = features(s, d).join(dollars, "doc_id").withColumns({"user_total_reviews": total("user_id"), "prod_total_reviews": total("prod_id")})
    return f.select("is_fake", *[F.expr(x).alias(n) for n, x in _SCREENED.items()])


register(
    "ts07",
    lambda s, d: _rounded_screen(_screened(s, d), list(_SCREENED)),
    _F + ", s0 AS (SELECT f.*, length(text) - length(replace(text, '$', '')) AS dollar, count(*) OVER (PARTITION BY user_id) AS user_total_reviews, count(*) OVER (PARTITION BY prod_id) AS prod_total_reviews FROM f JOIN documents USING (doc_id)), s AS (SELECT is_fake, "
    + ", ".join(f"round(CAST({x} AS DOUBLE), 9) AS {n}" for n, x in _SCREENED.items()) + " FROM s0) " + _screen_sql(list(_SCREENED)),
)
register(
    "ts11",
    lambda s, d: rounded(stats.odds_table(features(s, d), _RATIO_FLAGS, "is_fake")),
    _F + ", m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, sum({c} * is_fake) AS a, sum({c} * (1 - is_fake)) AS b, sum((1 - {c}) * is_fake) AS c, sum((1 - {c}) * (1 - is_fake)) AS d FROM f" for c in _RATIO_FLAGS) + ") SELECT feature, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6) AS odds_ratio, round(a / greatest(a + b, 1), 6) AS rate_on, round(c / greatest(c + d, 1), 6) AS rate_off FROM m",
)

_SCALED = ["prior_user_review_count", "days_since_user_last_review", "word_len", "upper_ratio", "rating_impact_abs"]
register(
    "fe09",
    lambda s, d: rounded(matrix.scaled(_split(s, d), _SCALED, F.col("split") == "train").select("review_id", *_SCALED)),
    _PARTS + ", z AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _SCALED) + " FROM p1 WHERE split = 'train') SELECT review_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED) + " FROM p1, z",
)
register("gn09", lambda s, d: rounded(matrix.class_weights(_split(s, d).where("split = 'train'"), "is_fake").drop("balanced_weight")), _PARTS + " SELECT CAST(is_fake AS BIGINT) AS label, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 6) AS inverse_weight FROM p1 WHERE split = 'train' GROUP BY is_fake")
register(
    "gn10",
    lambda s, d: rounded(matrix.class_weights(_split(s, d).where("split = 'train'"), "is_fake").drop("inverse_weight")),
    _PARTS + ", g AS (SELECT is_fake AS label, count(*) AS n, (1 - 0.999) / (1 - power(0.999, count(*))) AS w FROM p1 WHERE split = 'train' GROUP BY is_fake) SELECT CAST(label AS BIGINT) AS label, n, round(w / avg(w) OVER (), 6) AS balanced_weight FROM g",
)
register(
    "tx01",
    lambda s, d: rounded(matrix.tfidf(table(s, d, "documents"), train_documents(s, d))),
    _PARTS + r""", x0 AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
x1 AS (SELECT doc_id, unnest(w) AS term FROM x0 UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM x0),
x2 AS (SELECT doc_id, term, count(*) AS tf FROM x1 GROUP BY ALL), xt AS (SELECT DISTINCT p1.doc_id FROM p1 JOIN documents USING (doc_id) WHERE split = 'train'),
x3 AS (SELECT term, count(*) AS df, sum(tf) AS total, (SELECT count(*) FROM xt) AS n FROM x2 SEMI JOIN xt USING (doc_id) GROUP BY term),
x4 AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM x3 WHERE df >= 2 AND df <= 0.95 * n ORDER BY total DESC, term LIMIT 50000),
x5 AS (SELECT doc_id, term, tf * idf AS w FROM x2 JOIN x4 USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x5""",
)
def _is_dense(part):
    return F.lit(part).alias("part"), ((F.count("*") == F.max("node_idx") + 1) & (F.count("*") == F.count_distinct("node_idx")) & (F.min("node_idx") == 0)).alias("dense")


def _dense(s, d):
    """An index as it is made, and one that rows are missing from."""
    idx = history.dense_index(_nodes(s, d))
    return idx.agg(*_is_dense("whole")).unionByName(idx.where("node_idx % 7 <> 3").agg(*_is_dense("broken")))


_DENSE_SQL = "count(*) = max(i) + 1 AND count(*) = count(DISTINCT i) AND min(i) = 0 AS dense FROM k"
register("val01", _dense, _F + f", k AS (SELECT row_number() OVER (ORDER BY date, review_id) - 1 AS i FROM r) SELECT 'whole' AS part, {_DENSE_SQL} UNION ALL SELECT 'broken', {_DENSE_SQL} WHERE i % 7 <> 3")


def _mask_faults(s, d):
    """Counts over a split with faults put in: every tenth review in two parts, others in none."""
    split = _split(s, d).select("review_id", F.when(F.col("review_id") % 15 != 7, F.col("split")).alias("split"))
    twice = split.unionByName(split.where("review_id % 10 = 0").withColumn("split", F.lit("test")))
    return twice.groupBy("review_id").agg(F.count("*").alias("c"), F.count("split").alias("k")).agg(F.count_if(F.col("c") > 1).alias("in_several"), F.count_if(F.col("k") == 0).alias("in_none"))


register("val03", _mask_faults, _PARTS + " SELECT count(*) FILTER (review_id % 10 = 0) AS in_several, count(*) FILTER (review_id % 15 = 7 AND review_id % 10 <> 0) AS in_none FROM p1")
register(
    "sc23",
    lambda s, d: rounded(_shifted_cosines(s, d)),
    "SELECT a.vec_id, round((list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1) / 2, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)


def _shifted_cosines(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", ((cosine(F.col("embedding"), F.col("other")) + 1) / 2).alias("similarity"))


register(
    "prj05",
    lambda s, d: rounded(_nodes(s, d).select("review_id", (F.col("rating") >= 4).cast("long").alias("positive"), (F.col("rating") <= 2).cast("long").alias("negative"), (F.col("rating") == 3).cast("long").alias("neutral"), F.year("date").alias("year"), F.date_format("date", "yyyy-MM").alias("year_month"))),
    _F + " SELECT review_id, CAST(rating >= 4 AS BIGINT) AS positive, CAST(rating <= 2 AS BIGINT) AS negative, CAST(rating = 3 AS BIGINT) AS neutral, year(date) AS year, strftime(date, '%Y-%m') AS year_month FROM r",
)
register("prj04", lambda s, d: rounded(features(s, d).select("review_id", *_MATRIX)), _F + f" SELECT {sql_columns(['review_id'])}, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" if c not in ("char_len", "word_len", "rating") else f"CAST({c} AS BIGINT) AS {c}" for c in ("rating", "rating_norm", "char_len", "word_len", "log_word_len", "unique_token_ratio", "avg_token_len", "upper_ratio")) + " FROM f")
_MATRIX = ["rating", "rating_norm", "char_len", "word_len", "log_word_len", "unique_token_ratio", "avg_token_len", "upper_ratio"]
register(
    "gv02",
    lambda s, d: rounded(stats.confusion(units.temporal_split(_scored(s, d)), "score", "is_fake", 0.794, ["split"])),
    _S.replace(", s AS (", ", s1 AS (") + f", s2 AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM s1), s AS (SELECT *, {_SPLIT} AS split FROM s2)" + _confusion_sql("0.794", "split"),
)
register(
    "me06",
    lambda s, d: rounded(units.temporal_split(_scored(s, d)).select("review_id", "is_fake", "score", (F.col("score") >= 0.794).cast("long").alias("predicted"), "split")),
    _S + f", s2 AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM s) SELECT review_id, CAST(is_fake AS BIGINT) AS is_fake, round(score, 6) AS score, CAST(score >= 0.794 AS BIGINT) AS predicted, {_SPLIT} AS split FROM s2",
)
