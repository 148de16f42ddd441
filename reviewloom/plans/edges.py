"""Queries of edges, graph aggregates and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from reviewloom.operators import edges
from reviewloom.plans.base import FEATURES_SQL, features, register, rounded
from reviewloom.sources import cut, reviews, standardize

_F = f"WITH {FEATURES_SQL}"
_LAST = _F + ", k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id) AS n FROM r), ed02 AS (SELECT a.review_id AS src, b.review_id AS dst FROM k a JOIN k b ON a.user_id = b.user_id AND b.n - a.n BETWEEN 1 AND 5)"


def _nodes(s, d):
    return standardize(reviews(s, d)).withColumn("week", F.date_trunc("week", "date").cast("date"))


_SHOCKED = ["review_id", "user_id", "prod_id", "date", "week", "rating_direction", "prior_product_review_count", "prior_product_rating_std", "rating_deviation_from_prior_product_mean"]


def once(s, d, columns=()):
    """Columns of the feature frame that edges need, written once for all uses in a plan."""
    return cut(features(s, d).select(*dict.fromkeys([*_SHOCKED, *columns])))


register("ed02", lambda s, d: edges.last_k(_nodes(s, d), "user_id", 5), _LAST + " SELECT * FROM ed02")
register("jn14", lambda s, d: edges.last_k(_nodes(s, d), "prod_id", 3), _F + ", k AS (SELECT *, row_number() OVER (PARTITION BY prod_id ORDER BY date, review_id) AS n FROM r) SELECT a.review_id AS src, b.review_id AS dst FROM k a JOIN k b ON a.prod_id = b.prod_id AND b.n - a.n BETWEEN 1 AND 3")
_PRIOR = ", ed05 AS (SELECT a.review_id AS src, b.review_id AS dst FROM a JOIN a b ON a.prod_id = b.prod_id AND a.week < b.week QUALIFY row_number() OVER (PARTITION BY b.review_id ORDER BY a.date DESC, a.review_id DESC) <= 5)"
register("ed05", lambda s, d: edges.prior_context(_nodes(s, d), 5), _F + _PRIOR + " SELECT * FROM ed05")

_SHOCK = """, sc AS (
  SELECT *, abs(rating_deviation_from_prior_product_mean) AS abs_dev, sign(rating_deviation_from_prior_product_mean) AS shock_direction,
    abs(rating_deviation_from_prior_product_mean) {scaled} AS shock_score FROM f
), sd AS (SELECT * FROM sc WHERE prior_product_review_count <= 30 AND shock_score >= {least} AND rating_direction <> 0)"""
_SCALED = "/ greatest(prior_product_rating_std, (SELECT greatest(quantile_cont(prior_product_rating_std, 0.25), 1e-6) FROM f WHERE prior_product_rating_std > 0))"
_PEERS = """, sp AS (
  SELECT a.review_id AS src, b.review_id AS dst FROM sd a JOIN sd b ON a.shock_direction = b.shock_direction AND a.rating_direction = b.rating_direction AND abs(a.date - b.date) <= 3
    AND a.review_id <> b.review_id AND a.user_id <> b.user_id AND NOT (a.prod_id = b.prod_id AND a.week = b.week)
  QUALIFY row_number() OVER (PARTITION BY a.review_id ORDER BY round(least(a.abuse_burst_behavior_score_4w, b.abuse_burst_behavior_score_4w), 9) DESC, round(abs(a.shock_score - b.shock_score), 9),
    round(abs(a.abs_dev - b.abs_dev), 9), abs(a.prior_product_review_count - b.prior_product_review_count), abs(a.date - b.date), b.review_id) <= 15
), ed11 AS (SELECT src, dst FROM sp UNION SELECT dst, src FROM sp)"""
_ABSOLUTE = _SHOCK.format(scaled="", least="1.0")
register("flt03", lambda s, d: rounded(edges.shock_candidates(features(s, d)).select("review_id", "shock_score", "shock_direction")), _F + _ABSOLUTE + " SELECT review_id, round(shock_score, 6) AS shock_score, CAST(shock_direction AS BIGINT) AS shock_direction FROM sd")
register("ed13", lambda s, d: rounded(edges.shock_candidates(once(s, d), min_dev=0.75, standardized=True).select("review_id", "shock_score")), _F + _SHOCK.format(scaled=_SCALED, least="0.75") + " SELECT review_id, round(shock_score, 6) AS shock_score FROM sd")
register("ed11", lambda s, d: edges.shock_peers(once(s, d, ["abuse_burst_behavior_score_4w"])), _F + _ABSOLUTE + _PEERS + " SELECT * FROM ed11")
_BASE = ", ed12 AS (SELECT e.review_id AS src, c.review_id AS dst FROM sd c JOIN f e ON c.prod_id = e.prod_id AND c.prior_product_review_count >= 1 AND (e.date < c.date OR (e.date = c.date AND e.review_id < c.review_id)) AND e.user_id <> c.user_id QUALIFY row_number() OVER (PARTITION BY c.review_id ORDER BY e.date DESC, e.review_id DESC) <= 5)"
register("ed12", lambda s, d: edges.shock_baseline(once(s, d)), _F + _ABSOLUTE + _BASE + " SELECT * FROM ed12")

_Z = ", ".join(f"({x} - (SELECT median({x}) FROM cc)) / (SELECT CASE WHEN stddev_pop({x}) < 1e-12 THEN 1 ELSE stddev_pop({x}) END FROM cc) AS z_{x}" for x in edges.BEHAVIOR)
_COLD = f""", cc AS (SELECT * FROM f WHERE (prior_user_review_count <= 1 OR is_new_user_at_review_time = 1) AND (short_review_flag = 1 OR extreme_rating = 1)), cz AS (SELECT *, {_Z} FROM cc), cp AS (
  SELECT a.review_id AS src, b.review_id AS dst FROM cz a JOIN cz b ON a.rating_direction = b.rating_direction AND a.rating_direction <> 0 AND abs(a.date - b.date) <= 3
    AND a.review_id <> b.review_id AND a.user_id <> b.user_id AND NOT (a.prod_id = b.prod_id AND a.week = b.week)
  QUALIFY row_number() OVER (PARTITION BY a.review_id ORDER BY abs(a.date - b.date), round(({' + '.join(f'abs(a.z_{x} - b.z_{x})' for x in edges.BEHAVIOR)}) / {len(edges.BEHAVIOR)}, 9), b.review_id) <= 5
), ed10 AS (SELECT src, dst FROM cp UNION SELECT dst, src FROM cp)"""
register("ed10", lambda s, d: edges.cold_start_cohort(once(s, d, edges.BEHAVIOR)), _F + _COLD + " SELECT * FROM ed10")
register(
    "ed10b",
    lambda s, d: rounded(edges.behavior_matrix(once(s, d, edges.BEHAVIOR).where("(prior_user_review_count <= 1 OR is_new_user_at_review_time = 1) AND (short_review_flag = 1 OR extreme_rating = 1)")).select("review_id", *[f"z_{x}" for x in edges.BEHAVIOR])),
    _F + _COLD + " SELECT review_id, " + ", ".join(f"round(z_{x}, 6) AS z_{x}" for x in edges.BEHAVIOR) + " FROM cz",
)
register(
    "flt05",
    lambda s, d: features(s, d).where("(prior_user_review_count <= 1 OR is_new_user_at_review_time = 1) AND (short_review_flag = 1 OR extreme_rating = 1)").select("review_id"),
    _F + _COLD + " SELECT review_id FROM cc",
)
register("flt04", lambda s, d: features(s, d).where("short_review_flag = 1 OR extreme_rating = 1").select("review_id"), _F + " SELECT review_id FROM f WHERE short_review_flag = 1 OR extreme_rating = 1")

_CAMPAIGN = f""", cl AS (SELECT *, {' + '.join(f'greatest({c}, 0)' for c in edges.CAMPAIGN_LIFTS)} AS lift FROM p1), cq AS (
  SELECT quantile_cont(lift, 0.6) AS cut, greatest(quantile_cont(lift, 0.9), quantile_cont(lift, 0.6), 1e-6) AS q90, greatest(quantile_cont(prior_product_rating_std, 0.25) FILTER (prior_product_rating_std > 0), 1e-6) AS std_floor FROM cl WHERE split = 'train'
), cg AS (SELECT *, count(*) OVER g AS size, avg(lift) OVER g AS mean FROM cl, cq WHERE rating_direction <> 0 WINDOW g AS (PARTITION BY prod_id, week, rating_direction)
), ck AS (SELECT cg.*, least(abs(rating_deviation_from_prior_product_mean) / greatest(prior_product_rating_std, std_floor), 3) / 3 AS dev, CAST(embedding AS DOUBLE[]) AS v FROM cg JOIN embeddings e USING (vec_id) WHERE size >= 3 AND round(mean, 9) >= round(cut, 9)
), cs AS (
  SELECT a.review_id AS src, b.review_id AS dst, abs(a.date - b.date) AS apart, round(0.35 * (least(1, greatest(-1, list_cosine_similarity(a.v, b.v))) + 1) / 2 + 0.16 * least(a.is_new_user_at_review_time, b.is_new_user_at_review_time)
    + 0.14 * least(a.short_review_flag, b.short_review_flag) + 0.20 * least(a.dev, b.dev) + 0.15 * greatest(0, least(1, least(a.lift, b.lift) / a.q90)), 9) AS score
  FROM ck a JOIN ck b ON a.prod_id = b.prod_id AND a.week = b.week AND a.rating_direction = b.rating_direction AND a.review_id <> b.review_id
), ed06 AS (SELECT src, dst, score FROM (SELECT cs.* FROM cs ANTI JOIN ed02 ON cs.src = ed02.src AND cs.dst = ed02.dst WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY cs.src ORDER BY score DESC, apart, cs.dst) <= 3) ORDER BY score DESC, src, dst LIMIT 6000)"""


def typed_edges(s, d, f=None):
    """User (0), prior context (1) and shock baseline (2) edges, one per pair; of ``once``'s rows if they are given."""
    f = once(s, d) if f is None else f
    kinds = (edges.last_k(f, "user_id", 5), edges.prior_context(f, 5), edges.shock_baseline(f))
    return edges.collapsed(reduce(lambda a, b: a.unionByName(b), [e.select("src", "dst", F.lit(i).alias("edge_type")) for i, e in enumerate(kinds)]))


_TYPED = _LAST + _PRIOR + _ABSOLUTE + _BASE + ", te AS (SELECT src, dst, max(edge_type) AS edge_type FROM (SELECT *, 0 AS edge_type FROM ed02 UNION ALL SELECT *, 1 FROM ed05 UNION ALL SELECT *, 2 FROM ed12) WHERE src <> dst GROUP BY src, dst)"
register("ed16", lambda s, d: rounded(typed_edges(s, d)), _TYPED + " SELECT src, dst, CAST(edge_type AS BIGINT) AS edge_type FROM te")
register("flt06", lambda s, d: rounded(typed_edges(s, d).where("edge_type IN (0, 2)")), _TYPED + " SELECT src, dst, CAST(edge_type AS BIGINT) AS edge_type FROM te WHERE edge_type IN (0, 2)")
register("ag23", lambda s, d: rounded(typed_edges(s, d).groupBy("edge_type").agg(F.count("*").alias("edges"))), _TYPED + " SELECT CAST(edge_type AS BIGINT) AS edge_type, count(*) AS edges FROM te GROUP BY 1")
register(
    "ag22",
    lambda s, d: rounded(edges.edge_statistics(typed_edges(s, d), _nodes(s, d))),
    _TYPED + " SELECT CAST(edge_type AS BIGINT) AS edge_type, count(*) AS directed_edges, count(DISTINCT (least(src, dst), greatest(src, dst))) AS undirected_edges, round(count(*) / (SELECT count(*) FROM r), 6) AS mean_degree, "
    "(SELECT count(*) FROM r) - (SELECT count(DISTINCT n) FROM (SELECT unnest([x.src, x.dst]) AS n FROM te x WHERE x.edge_type = te.edge_type)) AS isolated_nodes FROM te GROUP BY edge_type",
)
def _faulty_edges(s, d):
    """Typed edges with faults put in: repeats, loops of an unknown type, and ends that are no review. The edges are written
    once, as the four parts and each count read them."""
    e = cut(typed_edges(s, d).select("src", "dst", F.col("edge_type").cast("long").alias("edge_type")))
    loops = e.where("src % 7 = 3").select("src", F.col("src").alias("dst"), F.lit(9).cast("long").alias("edge_type"))
    lost = e.where("src % 11 = 2").select((-F.col("src") - 1).alias("src"), "dst", "edge_type")
    return e.unionByName(e.where("src % 5 = 0")).unionByName(loops).unionByName(lost)


register(
    "val04",
    lambda s, d: rounded(edges.edge_violations(_faulty_edges(s, d), _nodes(s, d))),
    _TYPED + ", vb AS (SELECT * FROM te UNION ALL SELECT * FROM te WHERE src % 5 = 0 UNION ALL SELECT src, src, 9 FROM te WHERE src % 7 = 3 UNION ALL SELECT -src - 1, dst, edge_type FROM te WHERE src % 11 = 2) SELECT count(*) FILTER (src = dst) AS self_loops, count(*) FILTER (edge_type NOT IN (0, 1, 2)) AS unknown_types, "
    "CAST((SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM vb GROUP BY src, dst, edge_type)) AS BIGINT) AS repeats, (SELECT count(*) FROM (SELECT unnest([src, dst]) AS e FROM vb) WHERE e NOT IN (SELECT review_id FROM r)) AS unknown_ends FROM vb",
)
register(
    "gn02",
    lambda s, d: rounded(edges.neighbour_means(typed_edges(s, d), features(s, d), ["rating_norm", "log_word_len"])),
    _TYPED + " SELECT dst AS review_id, CAST(edge_type AS BIGINT) AS edge_type, round(avg(rating_norm), 6) AS mean_rating_norm, round(avg(log_word_len), 6) AS mean_log_word_len FROM te JOIN f ON f.review_id = te.src GROUP BY ALL",
)
register("ed01", lambda s, d: edges.capped_clique(_nodes(s, d), ["user_id"], 5))
register("ed04", lambda s, d: edges.capped_clique(features(s, d), ["prod_id", "week", "rating_bucket"], 5))
register(
    "ed07",
    lambda s, d: edges.capped_clique(features(s, d), ["prod_id", "week", "text_hash"], 10),
)
