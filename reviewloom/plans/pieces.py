"""Queries of single joins, set operations, sorts, filters and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewloom.functions import bin_right, clip, finite, safe_ratio
from reviewloom.operators import anchors, edges, history, stats, units
from reviewloom.plans.base import FEATURES_SQL, QUERIES, SQL, features, register, register_columns, rounded, texts
from reviewloom.plans.edges import _ABSOLUTE, _LAST, _PRIOR, _TYPED, typed_edges
from reviewloom.plans.reviews import _SAMPLED, _SPLIT, _UNITS, _flag_sql, _sampled
from reviewloom.sources import cut, reviews, scratch, standardize, table, write_summary

_F = f"WITH {FEATURES_SQL}"


def _nodes(s, d):
    return standardize(reviews(s, d))


def _flags(s, d):
    return units.flagged(units.product_week_units(features(s, d)), "relative")


def _pairs(s, d, rating):
    return _nodes(s, d).where(F.col("rating") == rating).select("user_id", "prod_id")


# Scalars.
register("sc05", lambda s, d: rounded(table(s, d, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9']+"), 0))).alias("tokens"))), "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+'))) AS BIGINT) AS tokens FROM documents")
register("sc12", lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")), "SELECT doc_id, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS chars FROM documents")
register(
    "sc13",
    lambda s, d: table(s, d, "events").select("event_id", F.try_to_timestamp(F.when(F.col("event_id") % 7 == 0, "no date").otherwise(F.to_date("ts").cast("string"))).cast("date").alias("date")),
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'no date' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS DATE) AS date FROM events",
)
register("sc16", lambda s, d: _nodes(s, d).select("review_id", F.abs(F.datediff("date", F.lit("2024-06-01"))).cast("long").alias("days")), _F + " SELECT review_id, CAST(abs(date - DATE '2024-06-01') AS BIGINT) AS days FROM r")
register("sc17", lambda s, d: rounded(features(s, d).select("review_id", clip(F.col("rating_impact_signed"), -0.25, 0.25).alias("clipped"), F.col("word_len").between(10, 50).cast("long").alias("within"))), _F + " SELECT review_id, round(greatest(-0.25, least(0.25, rating_impact_signed)), 6) AS clipped, CAST(word_len BETWEEN 10 AND 50 AS BIGINT) AS within FROM f")
register("sc18", lambda s, d: rounded(features(s, d).select("review_id", safe_ratio(F.col("product_reviews_last_7d"), F.col("product_reviews_last_30d")).alias("ratio"))), _F + " SELECT review_id, round(coalesce(product_reviews_last_7d / nullif(product_reviews_last_30d, 0), 0), 6) AS ratio FROM f")
register(
    "sc19",
    lambda s, d: rounded(_nodes(s, d).select("review_id", finite(F.when(F.col("rating") == 1, float("nan")).when(F.col("rating") == 2, float("inf")).when(F.col("rating") > 3, F.col("rating").cast("double"))).alias("value"))),
    _F + " SELECT review_id, CASE WHEN rating > 3 THEN CAST(rating AS DOUBLE) ELSE 0 END AS value FROM r",
)
register_columns("sc20", ["rating_bucket", "rating_direction"])
register("sc21", lambda s, d: features(s, d).select("review_id", F.round(F.when(F.col("prior_user_review_count") > 0, F.col("prior_user_extreme_ratio")) * 100, 4).alias("percent")), _F + " SELECT review_id, round(CASE WHEN prior_user_review_count > 0 THEN prior_user_extreme_ratio END * 100, 4) AS percent FROM f")


def _unit_vectors(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = v.withColumn("norm", norm).select("vec_id", F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("v"))
    return rounded(unit.select("vec_id", F.posexplode("v").alias("k", "value")))


register(
    "sc22",
    _unit_vectors,
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v) "
    "SELECT vec_id, CAST(unnest(range(len(v))) AS BIGINT) AS k, round(unnest(list_transform(v, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE 0 END)), 6) AS value FROM n",
)


def _vector_gaps(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    gaps = F.zip_with("embedding", "other", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return rounded(e.join(other, "vec_id").select("vec_id", (F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.size("embedding")).alias("distance")))


register("sc24", _vector_gaps, "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) / len(a.v), 6) AS distance FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
register(
    "sc25",
    lambda s, d: rounded(features(s, d).select("review_id", F.posexplode(F.slice(F.concat(F.array(F.col("rating").cast("double"), F.col("rating_norm")), F.array("log_word_len", "upper_ratio")), 2, 2)).alias("k", "value"))),
    _F + " SELECT review_id, 0 AS k, round(rating_norm, 6) AS value FROM f UNION ALL SELECT review_id, 1, round(log_word_len, 6) FROM f",
)
register("sc26", lambda s, d: rounded(features(s, d).select("review_id", bin_right(F.col("word_len"), [10, 50, 200]).alias("bin"))), _F + " SELECT review_id, CAST((word_len >= 10)::INT + (word_len >= 50)::INT + (word_len >= 200)::INT AS BIGINT) AS bin FROM f")
register("sc27", lambda s, d: table(s, d, "events").select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("json")), "SELECT event_id, '{\"k\":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '}' AS json FROM events")
register(
    "snk09",
    lambda s, d: _nodes(s, d).select("review_id", F.to_json(F.struct("review_id", F.nanvl(F.when(F.col("rating") == 1, float("nan")).otherwise(F.col("rating") / 2), F.lit(None).cast("double")).alias("half"))).alias("json")),
    _F + " SELECT review_id, CASE WHEN rating = 1 THEN '{\"review_id\":' || review_id || '}' ELSE '{\"review_id\":' || review_id || ',\"half\":' || CAST(rating / 2 AS DOUBLE) || '}' END AS json FROM r",
)

# Filters and projections.
register("flt01", lambda s, d: table(s, d, "documents").na.drop(subset=["text", "lang", "source"]).select("doc_id"), "SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
register("flt02", lambda s, d: units.product_week_units(features(s, d)).where("n_reviews >= 10 AND n_users >= 8").select("prod_id", "week"), _UNITS + " SELECT prod_id, week FROM u WHERE base_candidate")
register("flt07", lambda s, d: units.temporal_split(_sampled(s, d)).where((F.col("split") == "train") & (F.col("rating_direction") != 0)).select("review_id"), _SAMPLED + f" SELECT review_id FROM m WHERE {_SPLIT} = 'train' AND rating_direction <> 0")
register("prj06", lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.missing").try_cast("double"), F.lit(0.0)).alias("missing"), F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("k")), "SELECT event_id, CAST(0 AS DOUBLE) AS missing, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events")

# Joins.
register("jn01", lambda s, d: rounded(_nodes(s, d).join(texts(s, d).select("doc_id", "word_len"), "doc_id", "left").select("review_id", "word_len")), _F + " SELECT review_id, word_len FROM r LEFT JOIN t USING (doc_id)")
register("jn04", lambda s, d: _nodes(s, d).join(_nodes(s, d).where("rating = 1").select("user_id"), "user_id", "left_semi").select("review_id"), _F + " SELECT review_id FROM r WHERE user_id IN (SELECT user_id FROM r WHERE rating = 1)")
register("jn05", lambda s, d: _nodes(s, d).join(_pairs(s, d, 1), ["user_id", "prod_id"], "left_anti").select("review_id"), _F + " SELECT review_id FROM r WHERE (user_id, prod_id) NOT IN (SELECT (user_id, prod_id) FROM r WHERE rating = 1)")
register("jn06", lambda s, d: features(s, d).join(features(s, d).where("extreme_rating = 1 AND is_fake = 1").select("prod_id", "week"), ["prod_id", "week"], "left_semi").select("review_id"), _F + " SELECT review_id FROM f WHERE (prod_id, week) IN (SELECT (prod_id, week) FROM f WHERE extreme_rating = 1 AND is_fake = 1)")
register("jn07", lambda s, d: _nodes(s, d).select("review_id", F.count("*").over(Window.partitionBy("prod_id", "rating")).alias("bucket_size")), _F + " SELECT review_id, count(*) OVER (PARTITION BY prod_id, rating) AS bucket_size FROM r")
register(
    "jn09",
    lambda s, d: rounded(_renumbered(s, d)),
    _SAMPLED + ", k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) AS o FROM r) SELECT x.pos - 1 AS src, y.pos - 1 AS dst FROM k a JOIN k b ON a.user_id = b.user_id AND b.o - a.o BETWEEN 1 AND 5 JOIN m x ON x.review_id = a.review_id JOIN m y ON y.review_id = b.review_id",
)


def _renumbered(s, d):
    ids = history.dense_index(_sampled(s, d), "idx").select("review_id", "idx")
    e = edges.last_k(_nodes(s, d), "user_id", 5)
    e = e.join(ids.withColumnsRenamed({"review_id": "src", "idx": "a"}), "src").join(ids.withColumnsRenamed({"review_id": "dst", "idx": "b"}), "dst")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"))


register("jn10", lambda s, d: _nodes(s, d).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id", "left").select("review_id", "doc_id", "lang"), _F + " SELECT review_id, doc_id, lang FROM r LEFT JOIN documents USING (doc_id)")
register("jn11", lambda s, d: _nodes(s, d).select("review_id", F.count("*").over(Window.partitionBy("user_id")).alias("user_total"), F.count("*").over(Window.partitionBy("prod_id")).alias("product_total")), _F + " SELECT review_id, count(*) OVER (PARTITION BY user_id) AS user_total, count(*) OVER (PARTITION BY prod_id) AS product_total FROM r")
register(
    "jn12",
    lambda s, d: edges.band_self_join(edges.shock_candidates(features(s, d)), ["shock_direction", "rating_direction"], 3, ["review_id"]).where("a_review_id <> b_review_id").groupBy(F.col("a_review_id").alias("review_id")).agg(F.count("*").alias("near")),
    _F + _ABSOLUTE + " SELECT a.review_id, count(*) AS near FROM sd a JOIN sd b ON a.shock_direction = b.shock_direction AND a.rating_direction = b.rating_direction AND abs(a.date - b.date) <= 3 AND a.review_id <> b.review_id GROUP BY 1",
)


def _blocks(s, d):
    """Ordered pairs of a product week and direction, which need no more of a review than its own columns."""
    f = history.rating_features(standardize(reviews(s, d))).where("rating_direction <> 0")
    return edges.equal_pairs(f, ["prod_id", "week", "rating_direction"])


register("jn13", _blocks, _F + " SELECT a.review_id AS src, b.review_id AS dst FROM f a JOIN f b ON a.prod_id = b.prod_id AND a.week = b.week AND a.rating_direction = b.rating_direction AND a.rating_direction <> 0 AND a.review_id <> b.review_id")
register(
    "jn17",
    lambda s, d: features(s, d).select("review_id", F.col("week").cast("string").alias("w"), "prod_id").join(units.product_week_units(features(s, d)).where("n_reviews >= 2").select("prod_id", F.col("week").cast("string").alias("w"), "n_users"), ["prod_id", "w"], "left").select("review_id", F.coalesce("n_users", F.lit(1)).alias("n_users")),
    _F + ", u AS (SELECT prod_id, week, count(DISTINCT user_id) AS n_users FROM f GROUP BY ALL HAVING count(*) >= 2) SELECT review_id, coalesce(n_users, 1) AS n_users FROM f LEFT JOIN u USING (prod_id, week)",
)

# Windows.
def _weekly():
    return F.coalesce(F.sum("c").over(Window.partitionBy("prod_id").orderBy("no").rangeBetween(-4, -1)), F.lit(0))


register(
    "wn09",
    lambda s, d: features(s, d).groupBy("prod_id", "week").agg(F.count("*").alias("c")).withColumn("no", (F.datediff("week", F.lit("1970-01-05")) / 7).cast("long")).select("prod_id", "week", _weekly().alias("prior_4w")),
    _F + " SELECT prod_id, week, CAST(ptotal AS BIGINT) AS prior_4w FROM w3",
)
register("wn16", lambda s, d: anchors.placed(_nodes(s, d), "user_id").select("review_id", "pos"), _F + " SELECT review_id, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) - 1 AS pos FROM r")
register("wn19", lambda s, d: units.positions(_nodes(s, d)).select("review_id", "pos", "n"), _F + " SELECT review_id, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM r")

# Sorts and set operations.
register("so01", lambda s, d: _nodes(s, d).select("review_id", "user_id", "date").orderBy("user_id", F.desc("date"), "review_id"), _F + " SELECT review_id, user_id, date FROM r ORDER BY user_id, date DESC, review_id")
register("so06", lambda s, d: edges.last_k(_nodes(s, d), "user_id", 5).orderBy("src", "dst").limit(500), _LAST + " SELECT * FROM ed02 ORDER BY src, dst LIMIT 500")
register(
    "so08",
    lambda s, d: rounded(features(s, d).withColumn("k", F.row_number().over(Window.partitionBy("prod_id").orderBy(F.desc("rating_impact_abs"), "review_id"))).where("k <= 3").groupBy("prod_id").agg(F.avg("rating_impact_abs").alias("top3_mean"))),
    _F + ", k AS (SELECT prod_id, rating_impact_abs FROM f QUALIFY row_number() OVER (PARTITION BY prod_id ORDER BY rating_impact_abs DESC, review_id) <= 3) SELECT prod_id, round(avg(rating_impact_abs), 6) AS top3_mean FROM k GROUP BY prod_id",
)


def _three_kinds(s, d):
    f = features(s, d)
    kinds = (edges.last_k(f, "user_id", 5), edges.prior_context(f, 5))
    return reduce(lambda a, b: a.unionByName(b), [e.select("src", "dst", F.lit(i).cast("long").alias("edge_type")) for i, e in enumerate(kinds)])


_KINDS = _LAST + _PRIOR + ", k2 AS (SELECT *, CAST(0 AS BIGINT) AS edge_type FROM ed02 UNION ALL SELECT *, 1 FROM ed05)"
register("st01", _three_kinds, _KINDS + " SELECT * FROM k2")
_ROLES = ((2, "background", "rating = 3"), (1, "suspicious", "extreme_rating = 1 AND short_review_flag = 1"), (0, "normal", "rating >= 3"))


def _first_role(s, d):
    f = features(s, d)
    parts = reduce(lambda a, b: a.unionByName(b), [f.where(w).select("review_id", F.lit(n).alias("role"), F.lit(p).alias("p")) for p, n, w in _ROLES])
    return parts.groupBy("review_id").agg(F.max_by("role", "p").alias("role"))


register("st02", _first_role, _F + ", k AS (" + " UNION ALL ".join(f"SELECT review_id, '{n}' AS role, {p} AS p FROM f WHERE {w}" for p, n, w in _ROLES) + ") SELECT review_id, role FROM k QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY p DESC) = 1")
register("st03", lambda s, d: features(s, d).select("prod_id", "week").distinct(), _F + " SELECT DISTINCT prod_id, week FROM f")
register(
    "st04",
    lambda s, d: _pairs(s, d, 1).union(_pairs(s, d, 5)).distinct().join(_pairs(s, d, 3), ["user_id", "prod_id"], "left_anti"),
    _F + " (SELECT user_id, prod_id FROM r WHERE rating = 1 UNION SELECT user_id, prod_id FROM r WHERE rating = 5) EXCEPT SELECT user_id, prod_id FROM r WHERE rating = 3",
)
register("st05", lambda s, d: _three_kinds(s, d).select("src", "dst").where("src <> dst").distinct(), _KINDS + " SELECT DISTINCT src, dst FROM k2 WHERE src <> dst")
register("st07", lambda s, d: edges.prior_context(features(s, d), 5).join(edges.last_k(_nodes(s, d), "user_id", 5), ["src", "dst"], "left_anti"), _LAST + _PRIOR + " SELECT ed05.src, ed05.dst FROM ed05 ANTI JOIN ed02 ON ed05.src = ed02.src AND ed05.dst = ed02.dst")

# Units.
_FLAGS = list(units.RELATIVE)


def _prevalence(s, d):
    long = _flags(s, d).where("selected").select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("v")) for c in _FLAGS])).alias("x"))
    return rounded(long.groupBy("x.flag").agg(F.sum("x.v").alias("units"), F.avg("x.v").alias("share")))


register("ag24", _prevalence, _flag_sql(units.RELATIVE) + " " + " UNION ALL ".join(f"SELECT '{c}' AS flag, CAST(sum({c}) AS BIGINT) AS units, round(avg({c}), 6) AS share FROM v WHERE selected HAVING count(*) > 0" for c in _FLAGS))
register(
    "ag25",
    lambda s, d: rounded(features(s, d).agg(F.count("*").alias("reviews"), F.sum("is_fake").alias("fake"), F.count_distinct("user_id").alias("users"), F.count_distinct("prod_id").alias("products"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.percentile("word_len", 0.5).alias("median_words"))),
    _F + " SELECT count(*) AS reviews, CAST(sum(is_fake) AS BIGINT) AS fake, count(DISTINCT user_id) AS users, count(DISTINCT prod_id) AS products, min(date) AS first_date, max(date) AS last_date, round(median(word_len), 6) AS median_words FROM f",
)


_POINTS = (0.5, 0.75, 0.8, 0.85, 0.9, 0.95, 0.975, 0.99, 0.995)


def _sampling_summary(s, d):
    """The summary of a sampling as one nested document: input, quantiles of units, candidates, what was selected and how
    common each flag is there; written, read, and laid flat."""
    f = cut(features(s, d).drop("text_hash"))
    u = units.flagged(units.product_week_units(f), "relative")
    chosen = cut(units.sampled_nodes(f, u))
    people = [F.count_distinct("prod_id").alias("products"), F.count_distinct("user_id").alias("users")]
    given = f.agg(F.struct(F.count("*").alias("nodes"), *people).alias("input"))
    points = stats.quantiles(u, {f"{c}_{i}": (F.col(c), q) for c in ("n_reviews", "n_users") for i, q in enumerate(_POINTS)})
    points = points.select(F.struct(*[F.array(*[f"{c}_{i}" for i in range(len(_POINTS))]).alias(c) for c in ("n_reviews", "n_users")]).alias("quantiles"))
    base = u.agg(F.count("*").alias("units"), F.struct(F.count_if("base_candidate").alias("units"), F.coalesce(F.sum(F.when(F.col("base_candidate"), F.col("n_reviews"))), F.lit(0)).alias("nodes")).alias("base_candidates"), F.struct(*[F.coalesce(F.sum(F.when(F.col("selected"), F.col(c))), F.lit(0)).alias(c) for c in _FLAGS]).alias("flags"), F.count_if("selected").alias("selected_units"))
    got = chosen.agg(F.struct(F.count("*").alias("nodes"), *people, F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max"), F.sum("is_fake").alias("fake"), F.avg("is_fake").alias("fake_rate")).alias("selected"))
    path = scratch(s, "summary")
    whole = given.crossJoin(points).crossJoin(base).crossJoin(got)
    write_summary(whole, path)
    back = s.read.schema(whole.schema).json(path)
    flat = [*(f"input.{c}" for c in ("nodes", "products", "users")), "base_candidates.units", "base_candidates.nodes", *(f"selected.{c}" for c in ("nodes", "products", "users", "date_min", "date_max", "fake", "fake_rate")), *(f"flags.{c}" for c in _FLAGS)]
    return rounded(back.select("units", "selected_units", *[F.col(c).alias(c.replace(".", "_")) for c in flat], *[F.col(f"quantiles.{c}")[i].alias(f"{c}_q{i}") for c in ("n_reviews", "n_users") for i in range(len(_POINTS))]))


register(
    "ag25_sampling",
    _sampling_summary,
    _flag_sql(units.RELATIVE) + ", ns AS (SELECT f.* FROM f SEMI JOIN v ON v.prod_id = f.prod_id AND v.week = f.week AND v.selected) SELECT (SELECT count(*) FROM v) AS units, (SELECT count(*) FROM v WHERE selected) AS selected_units, "
    + ", ".join(f"(SELECT {x} FROM {t}) AS {n}_{c}" for n, t in (("input", "f"), ("selected", "ns")) for c, x in (("nodes", "count(*)"), ("products", "count(DISTINCT prod_id)"), ("users", "count(DISTINCT user_id)")))
    + ", (SELECT count(*) FROM v WHERE base_candidate) AS base_candidates_units, (SELECT CAST(coalesce(sum(n_reviews), 0) AS BIGINT) FROM v WHERE base_candidate) AS base_candidates_nodes, (SELECT CAST(min(date) AS VARCHAR) FROM ns) AS selected_date_min, (SELECT CAST(max(date) AS VARCHAR) FROM ns) AS selected_date_max, "
    "(SELECT CAST(sum(is_fake) AS BIGINT) FROM ns) AS selected_fake, (SELECT round(avg(is_fake), 6) FROM ns) AS selected_fake_rate, "
    + ", ".join(f"(SELECT CAST(coalesce(sum({c}), 0) AS BIGINT) FROM v WHERE selected) AS flags_{c}" for c in _FLAGS)
    + ", " + ", ".join(f"(SELECT round(quantile_cont({c}, {q}), 6) FROM v) AS {c}_q{i}" for c in ("n_reviews", "n_users") for i, q in enumerate(_POINTS)),
)


def _structure(s, d):
    c = _nodes(s, d).groupBy("prod_id", "rating").agg(F.count("*").alias("c"), F.sum("is_fake").alias("fake"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("prod_id"))
    n, m, q = F.sum("c"), F.sum(F.col("c") * F.col("rating")), F.sum(F.col("c") * F.col("rating") * F.col("rating"))
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - m * m / n) / (n - 1))))
    return c.withColumn("p", p).groupBy("prod_id").agg(n.alias("n"), spread.alias("std"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), (F.sum("fake") / n).alias("fake_rate")).where("n >= 5")


register(
    "ts09",
    lambda s, d: rounded(_structure(s, d).agg(F.count("*").alias("products"), F.corr("std", "fake_rate").alias("std_corr"), F.corr("entropy", "fake_rate").alias("entropy_corr"))),
    _F + ", g AS (SELECT prod_id, rating, count(*) AS c, sum(count(*)) OVER (PARTITION BY prod_id) AS n FROM r GROUP BY prod_id, rating), e AS (SELECT prod_id, -sum(c / n * log2(c / n)) AS entropy FROM g GROUP BY 1), k AS (SELECT prod_id, stddev_samp(rating) AS std, avg(is_fake) AS fake_rate FROM r GROUP BY 1 HAVING count(*) >= 5) "
    "SELECT count(*) AS products, round(corr(std, fake_rate), 6) AS std_corr, round(corr(entropy, fake_rate), 6) AS entropy_corr FROM k JOIN e USING (prod_id)",
)
register_columns("jn02", [*units.SHIFTS, "prior_user_avg_rating"])
register("ed14", lambda s, d: rounded(features(s, d).select("review_id", F.signum("rating_deviation_from_prior_product_mean").cast("long").alias("shock_direction"))), _F + " SELECT review_id, CAST(sign(rating_deviation_from_prior_product_mean) AS BIGINT) AS shock_direction FROM f")
register("ed15", lambda s, d: typed_edges(s, d).select("src", "dst").distinct(), _TYPED + " SELECT DISTINCT src, dst FROM te")
register("src08", lambda s, d: _nodes(s, d).join(units.temporal_split(_sampled(s, d)).select("review_id", (F.col("split") == "train").alias("t")), "review_id", "left").select("review_id", F.coalesce("t", F.lit(True)).alias("is_train")), _SAMPLED + f" SELECT review_id, pos IS NULL OR {_SPLIT} = 'train' AS is_train FROM r LEFT JOIN m USING (review_id)")

#: Lines of the inventory that an existing query answers in full.
ALSO = {"jn03": "sm04", "jn15": "ed11", "jn18": "prj05", "so03": "ed11", "so04": "ed10", "st06": "ed16", "wn18": "ed03", "ed19": "flt06", "sm10": "wn15"}


def also() -> None:
    for name, other in ALSO.items():
        register(name, QUERIES[other], SQL.get(other))  # an unknown target is an error


also()
