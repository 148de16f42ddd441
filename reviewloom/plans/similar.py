"""Queries of nearest vectors and the edges built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions import clip, dot, week_of
from reviewloom.operators import edges, similar
from reviewloom.plans.base import FEATURES_SQL, features, register, rounded
from reviewloom.plans.edges import _F
from reviewloom.sources import cut, reviews, standardize, table

#: Least cosine of ed08: the adapter's vectors are too far apart for the default to find any in a product week.
TEMPLATE = 0.2

#: Cosine of every two distinct vectors; all-zero vectors are similar to nothing.
_SIMS = ", ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), es AS (SELECT a.vec_id AS a, b.vec_id AS b, round(coalesce(least(1, greatest(-1, list_cosine_similarity(a.v, b.v))), 0), 9) AS sim FROM ev a, ev b)"


def _nearest(s, d):
    v = similar._vectors(table(s, d, "embeddings")).withColumn("part", F.lit("all"))
    found = similar.nearest(v.select("part", F.col("vec_id").alias("src"), "v"), v.select("part", F.col("vec_id").alias("dst"), "v", F.col("vec_id").alias("rank_as")), ["part"], 6)
    return rounded(found)


register("so07", _nearest, "WITH " + _SIMS[2:] + " SELECT a AS src, b AS dst, round(sim, 6) AS sim FROM es QUALIFY row_number() OVER (PARTITION BY a ORDER BY es.sim DESC, b) <= 6")
register(
    "ed08",
    lambda s, d: similar.template_similar(features(s, d), table(s, d, "embeddings"), TEMPLATE),
    _F + _SIMS + ", g AS (SELECT prod_id, week, review_id, vec_id FROM f QUALIFY count(*) OVER (PARTITION BY prod_id, week) <= 2500), "
    f"tk AS (SELECT x.review_id AS src, y.review_id AS dst FROM g x JOIN g y ON x.prod_id = y.prod_id AND x.week = y.week AND x.review_id <> y.review_id JOIN es ON es.a = x.vec_id AND es.b = y.vec_id WHERE sim >= {TEMPLATE} QUALIFY row_number() OVER (PARTITION BY x.review_id ORDER BY sim DESC, y.review_id) <= 3) "
    "SELECT src, dst FROM tk UNION SELECT dst, src FROM tk",
)
_RISK = ["review_id", "rating_direction", "vec_id", "prod_id", "week", "short_review_flag", "extreme_rating"]
register("ed09", lambda s, d: similar.risk_text(cut(features(s, d).select(*_RISK)), table(s, d, "embeddings")))  # choices one after the other have no SQL
register(
    "ed09_any",
    lambda s, d: similar.risk_text(cut(features(s, d).select(*_RISK)), table(s, d, "embeddings"), new_only=False),
    _F + _SIMS + ", rk AS (SELECT review_id, rating_direction, vec_id, prod_id, week FROM f WHERE short_review_flag = 1 OR extreme_rating = 1), "
    "rn AS (SELECT x.review_id AS src, y.review_id AS dst, x.prod_id = y.prod_id AND x.week = y.week AS own, row_number() OVER (PARTITION BY x.review_id ORDER BY sim DESC, y.review_id) AS n FROM rk x JOIN es ON es.a = x.vec_id JOIN rk y ON y.vec_id = es.b AND y.rating_direction = x.rating_direction WHERE sim >= 0.9), "
    "rt AS (SELECT src, dst FROM rn WHERE n <= 31 AND src <> dst AND NOT own QUALIFY row_number() OVER (PARTITION BY src ORDER BY n) <= 3) SELECT src, dst FROM rt UNION SELECT dst, src FROM rt",
)


def _dated(s, d):
    return standardize(reviews(s, d)).withColumn("week", week_of(F.col("date")))


def _pair_likeness(s, d):
    """Cosine of the texts' vectors at both ends of prior-context edges. A source is known by its product's week, so edges are
    thin rows until their vectors, with the length of each, are looked up by key."""
    n, v = _dated(s, d), table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    lengths = v.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    met = n.join(edges.context_sources(n, 6, "vec_id"), ["prod_id", "week"]).select(F.col("e.review_id").alias("src"), F.col("e.vec_id").alias("src_vec"), F.col("review_id").alias("dst"), F.col("vec_id").alias("dst_vec"))
    end = lambda p: lengths.select(*[F.col(c).alias(f"{p}_{x}") for c, x in (("vec_id", "vec"), ("v", "v"), ("norm", "norm"))])
    met = met.join(end("src"), "src_vec").join(end("dst"), "dst_vec")
    norm = F.col("src_norm") * F.col("dst_norm")
    score = F.when(norm > 0, clip(dot(F.col("src_v"), F.col("dst_v")) / norm, -1.0, 1.0)).otherwise(F.lit(0.0))
    return met.select("src", "dst", F.round(score, 9).alias("score"))


_LIKENESS = f"""WITH {FEATURES_SQL}, jc AS (SELECT a.review_id AS src, b.review_id AS dst, a.vec_id AS av, b.vec_id AS bv, b.date - a.date AS apart FROM a JOIN a b ON a.prod_id = b.prod_id AND a.week < b.week QUALIFY row_number() OVER (PARTITION BY b.review_id ORDER BY a.date DESC, a.review_id DESC) <= 6),
jl AS (SELECT src, dst, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS score, apart FROM jc JOIN embeddings x ON x.vec_id = av JOIN embeddings y ON y.vec_id = bv)"""
register("jn16", lambda s, d: rounded(_pair_likeness(s, d)), _LIKENESS + " SELECT src, dst, round(score, 6) AS score FROM jl")
register(
    "so05",
    lambda s, d: rounded(edges.likest_after(_dated(s, d), table(s, d, "embeddings"), 6, 2)),
    _LIKENESS + " SELECT src, dst, round(score, 6) AS score, CAST(apart AS BIGINT) AS days_apart FROM jl QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, apart, dst) <= 2",
)
