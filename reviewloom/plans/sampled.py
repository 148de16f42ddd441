"""Queries of budgeted samplings and of features with training cutoffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import profiles, sampling, units
from reviewloom.plans.base import FEATURES_SQL, QUERIES, SQL, features, register, rounded, written_features
from reviewloom.plans.models import _PARTS
from reviewloom.plans.reviews import _flag_sql, _sampled
from reviewloom.sources import cut, table

#: Budget of the samplings, and one small enough that the ladder and the skipping of units matter on small tables: each
#: sampling is registered with both.
BUDGET, SMALL_BUDGET = 50_000, 600


def _train():
    return F.col("split") == "train"


def _split(s, d):
    return units.temporal_split(features(s, d))


def _budget(legacy: bool, budget: int) -> str:
    """The budget; where the selected units come first, that much beside them."""
    return f"((SELECT count(*) FROM s2 WHERE old) + {budget})" if legacy else str(budget)


def _reach_sql(legacy: bool, budget: int) -> str:
    budget = _budget(legacy, budget)
    seed = "prior_product_review_count BETWEEN 1 AND 30 AND abs(rating_deviation_from_prior_product_mean) >= 1.0 AND rating_direction <> 0" + (" AND NOT old" if legacy else "")
    old = "(prod_id, week) IN (SELECT (prod_id, week) FROM v WHERE selected)" if legacy else "false"
    return f""", s0 AS (SELECT *, {old} AS old FROM f), s1 AS (SELECT *, CASE WHEN {seed} THEN round(rating_impact_abs, 12) END AS impact FROM s0),
s2 AS (SELECT *, greatest(impact, max(impact) OVER (PARTITION BY prod_id ORDER BY date, review_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), max(impact) OVER (PARTITION BY user_id ORDER BY date, review_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS reach FROM s1),
s4 AS ({' UNION ALL '.join(f'SELECT {q} AS q, quantile_cont(impact, {q}) AS cut FROM s2' for q in sampling.LADDER)}),
s5 AS (SELECT q, cut FROM s4 WHERE (SELECT count(*) FROM s2 WHERE old OR reach >= cut) <= {budget} ORDER BY q LIMIT 1),
s6 AS (SELECT review_id FROM s2 WHERE old OR (NOT EXISTS (FROM s5) AND review_id IN (SELECT review_id FROM s2 WHERE impact >= (SELECT max(cut) FROM s4) ORDER BY impact DESC, date, review_id LIMIT (SELECT {budget} - count(*) FROM s2 WHERE old))) OR reach >= (SELECT cut FROM s5))"""


def _fill_sql(legacy: bool, budget: int) -> str:
    return f""", h0 AS (SELECT median(rating_direction_concentration) AS dc, median(prior_product_review_count_median) AS hc FROM v WHERE base_candidate),
h1 AS (SELECT prod_id, week, n_reviews, n_users FROM v, h0 WHERE base_candidate AND rating_direction_concentration <= dc AND prior_product_review_count_median >= hc),
h2 AS (SELECT prod_id, week, count(*) AS added FROM f WHERE review_id NOT IN (FROM s6) GROUP BY ALL),
h3 AS (SELECT *, row_number() OVER (ORDER BY n_reviews DESC, n_users DESC, prod_id, week) AS i FROM h1 JOIN h2 USING (prod_id, week)),
h4(i, room, took) AS (SELECT CAST(0 AS BIGINT), CAST({_budget(legacy, budget)} - (SELECT count(*) FROM s6) AS BIGINT), false UNION ALL SELECT h3.i, CASE WHEN added <= room THEN room - added ELSE room END, added <= room FROM h4 JOIN h3 ON h3.i = h4.i + 1),
h5 AS (SELECT prod_id, week, added FROM h3 JOIN h4 USING (i) WHERE took)"""


_BASE = _flag_sql(units.RELATIVE).replace("WITH ", "WITH RECURSIVE ", 1)


def _whole(legacy: bool, budget: int) -> str:
    return _BASE + _reach_sql(legacy, budget) + _fill_sql(legacy, budget) + " SELECT review_id FROM s6 UNION SELECT review_id FROM f WHERE (prod_id, week) IN (SELECT (prod_id, week) FROM h5)"


def _rows(s, d):
    """What units and seeds take of the feature frame, written once."""
    return written_features(s, d, [*sampling.REACH, *units.UNIT])


def _flagged(f):
    return units.flagged(units.product_week_units(f), "relative")


def _shock_sample(s, d, budget):
    f = _rows(s, d)
    return sampling.with_hard_negatives(f, _flagged(f), sampling.shock_context(f, budget), budget)


def _legacy_sample(s, d, room):
    """Reviews of the selected units first; they are written once, and their units' flags serve the negatives too."""
    f = _rows(s, d)
    v = _flagged(f)
    old = cut(units.sampled_nodes(f, v).select("review_id"))
    budget = old.count() + room
    return sampling.with_hard_negatives(f, v, sampling.shock_context(f, budget, old), budget)


def _hard_negatives(s, d, budget):
    f = _rows(s, d)
    return sampling.hard_negative_units(f, _flagged(f), sampling.shock_context(f, budget), budget)


for _suffix, _n in (("", BUDGET), ("_small", SMALL_BUDGET)):
    register(f"so12{_suffix}", lambda s, d, n=_n: sampling.shock_context(features(s, d), n), _BASE + _reach_sql(False, _n) + " SELECT review_id FROM s6")
    register(f"sm05{_suffix}", lambda s, d, n=_n: _shock_sample(s, d, n), _whole(False, _n))
    register(f"sm06{_suffix}", lambda s, d, n=_n: _legacy_sample(s, d, n), _whole(True, _n))
    register(f"sm09{_suffix}", lambda s, d, n=_n: _hard_negatives(s, d, n), _BASE + _reach_sql(False, _n) + _fill_sql(False, _n) + " SELECT prod_id, week, added FROM h5")
register("so11", QUERIES["sm09_small"], SQL["sm09_small"])
_TAKE = ", qc AS (SELECT rating, is_fake, count(*) AS c FROM r GROUP BY ALL), q AS (SELECT *, round(c / sum(c) OVER () * 300, 9) AS raw, sum(c) OVER () AS n FROM qc), q1 AS (SELECT *, CASE WHEN n <= 300 THEN c ELSE floor(raw) + CASE WHEN row_number() OVER (ORDER BY floor(raw) - raw, c DESC, rating, is_fake) <= 300 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END END AS quota FROM q)"
register(
    "so09",
    lambda s, d: sampling.stratified_take(features(s, d).select("review_id", "date", "rating", "is_fake"), 300, ["rating", "is_fake"], [F.col("date"), F.col("review_id")]).select("review_id"),
    f"WITH {FEATURES_SQL}{_TAKE} SELECT review_id FROM r JOIN q1 USING (rating, is_fake) QUALIFY row_number() OVER (PARTITION BY rating, is_fake ORDER BY date, review_id) <= quota",
)


def _fill_like(s, d):
    f = features(s, d).select("review_id", "date", "rating", "is_fake", "prior_product_review_count")
    return sampling.stratified_fill(f.where("is_fake = 0"), 300, f.where("is_fake = 1 AND rating <= 2"), ["rating"], [F.col("date"), F.col("review_id")]).select("review_id")


register(
    "so10",
    _fill_like,
    f"WITH {FEATURES_SQL}, qc AS (SELECT rating, count(*) AS c FROM r WHERE is_fake = 0 GROUP BY 1), l AS (SELECT rating, count(*) AS l FROM r WHERE is_fake = 1 AND rating <= 2 GROUP BY 1), q AS (SELECT rating, c, coalesce(l, 0) AS l, sum(coalesce(l, 0)) OVER () AS t, sum(c) OVER () AS n FROM qc LEFT JOIN l USING (rating)), "
    "q1 AS (SELECT rating, least(c, floor(round(CASE WHEN t > 0 THEN l / t * 300 ELSE c / n * 300 END, 9))) AS quota FROM q), k AS (SELECT review_id FROM r JOIN q1 USING (rating) WHERE is_fake = 0 QUALIFY row_number() OVER (PARTITION BY rating ORDER BY date, review_id) <= quota) "
    "SELECT * FROM k UNION ALL (SELECT review_id FROM r WHERE is_fake = 0 AND review_id NOT IN (FROM k) ORDER BY date, review_id LIMIT (SELECT greatest(0, 300 - count(*)) FROM k))",
)

_FE01 = ["word_len_minus_train_rating_history_median", "word_len_ratio_to_train_rating_history_median", "is_short_by_train_rating_history_q25", "extreme_rating_and_short_by_train_rating_history_q25"]
_HISTORY = """, cu AS (SELECT list_distinct(quantile_cont(prior_product_review_count, [0.25, 0.5, 0.75])) AS cuts FROM p1 WHERE split = 'train'), b AS (SELECT p1.*, len(list_filter(cuts, lambda c: c <= prior_product_review_count)) AS bin FROM p1, cu),
sg AS (SELECT rating_bucket, bin, quantile_cont(word_len, 0.25) AS a, median(word_len) AS m FROM b WHERE split = 'train' GROUP BY ALL), sb AS (SELECT rating_bucket, quantile_cont(word_len, 0.25) AS a, median(word_len) AS m FROM b WHERE split = 'train' GROUP BY ALL),
sa AS (SELECT quantile_cont(word_len, 0.25) AS a, median(word_len) AS m FROM b WHERE split = 'train'), j AS (SELECT b.review_id, word_len, extreme_rating, coalesce(sg.a, sb.a, sa.a) AS a, coalesce(sg.m, sb.m, sa.m) AS m FROM b LEFT JOIN sg USING (rating_bucket, bin) LEFT JOIN sb USING (rating_bucket) CROSS JOIN sa)"""
_HISTORY = _HISTORY.replace(" b AS (", " bb AS (").replace("FROM b ", "FROM bb ")
register(
    "fe01",
    lambda s, d: rounded(profiles.text_sufficiency(_split(s, d), _train()).select("review_id", *_FE01)),
    _PARTS + _HISTORY.replace("b.review_id", "bb.review_id") + f" SELECT review_id, round(word_len - m, 6) AS {_FE01[0]}, round(word_len / greatest(m, 1), 6) AS {_FE01[1]}, CAST(word_len <= a AS BIGINT) AS {_FE01[2]}, CAST(word_len <= a AS BIGINT) * CAST(extreme_rating AS BIGINT) AS {_FE01[3]} FROM j",
)
register("jn08", lambda s, d: rounded(profiles.text_sufficiency(_split(s, d), _train()).select("review_id", _FE01[0])), _PARTS + _HISTORY.replace("b.review_id", "bb.review_id") + f" SELECT review_id, round(word_len - m, 6) AS {_FE01[0]} FROM j")
_FE02 = ["standardized_rating_deviation_from_prior_product_mean", "abs_standardized_rating_deviation_from_prior_product_mean", "product_reviews_last_7d_share_of_prior_count", "product_reviews_last_30d_share_of_prior_count", "low_product_history_by_train_q25"]
register(
    "fe02",
    lambda s, d: rounded(profiles.product_prior_context(_split(s, d), _train()).select("review_id", *_FE02)),
    _PARTS + ", o AS (SELECT greatest(coalesce(quantile_cont(prior_product_rating_std, 0.25) FILTER (prior_product_rating_std > 0), 1), 1e-6) AS fl, quantile_cont(prior_product_review_count, 0.25) AS low FROM p1 WHERE split = 'train'), z AS (SELECT *, rating_deviation_from_prior_product_mean / greatest(prior_product_rating_std, fl) AS dev, greatest(prior_product_review_count, 1) AS h FROM p1, o) "
    f"SELECT review_id, round(dev, 6) AS {_FE02[0]}, round(abs(dev), 6) AS {_FE02[1]}, round(product_reviews_last_7d / h, 6) AS {_FE02[2]}, round(product_reviews_last_30d / h, 6) AS {_FE02[3]}, CAST(prior_product_review_count <= low AS BIGINT) AS {_FE02[4]} FROM z",
)
_FE03 = units.SHIFTS[:6]
register("fe03", lambda s, d: rounded(features(s, d).select("review_id", *_FE03)), f"WITH {FEATURES_SQL} SELECT review_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FE03) + " FROM f")
_FE04 = ["log1p_product_week_n_users", "micro_volume", "direction_bucket_size"]
register(
    "fe04",
    lambda s, d: rounded(profiles.campaign_quality(features(s, d)).select("review_id", *units.SHIFTS[2:6], units.SHIFTS[0], *_FE04)),
    f"WITH {FEATURES_SQL}, u AS (SELECT prod_id, week, count(DISTINCT user_id) AS users FROM f GROUP BY ALL) SELECT review_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*units.SHIFTS[2:6], units.SHIFTS[0]]) + ", round(ln(1 + users), 6) AS log1p_product_week_n_users, round(ln(1 + product_day_review_count), 6) AS micro_volume, round(ln(1 + product_week_rating_bucket_size), 6) AS direction_bucket_size FROM f JOIN u USING (prod_id, week)",
)


def _week_rows(s, d):
    """What likeness inside product weeks takes of the split rows, written once for its several uses."""
    return cut(units.temporal_split(features(s, d).select("review_id", "date", "prod_id", "week", "vec_id")))


register(
    "fe05",
    lambda s, d: rounded(profiles.template_similarity(_week_rows(s, d), table(s, d, "embeddings"), _train()).select("review_id", "max_sim", "top3_sim", "high_sim")),
    _PARTS + ", e AS (SELECT p1.*, CAST(embedding AS DOUBLE[]) AS v FROM p1 JOIN embeddings USING (vec_id)), x AS (SELECT a.review_id, a.split, CASE WHEN a.review_id = b.review_id THEN 0 ELSE least(1, greatest(-1, list_cosine_similarity(a.v, b.v))) END AS sim FROM e a JOIN e b ON a.prod_id = b.prod_id AND a.week = b.week), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY sim DESC) AS k, count(*) OVER (PARTITION BY review_id) AS n FROM x), z AS (SELECT review_id, split, max(sim) AS max_sim, avg(sim) AS top3_sim FROM y WHERE k <= least(3, greatest(n - 1, 1)) GROUP BY ALL) "
    "SELECT review_id, round(max_sim, 6) AS max_sim, round(top3_sim, 6) AS top3_sim, CAST(round(max_sim, 9) >= (SELECT round(quantile_cont(max_sim, 0.9), 9) FROM z WHERE split = 'train') AS BIGINT) AS high_sim FROM z",
)
