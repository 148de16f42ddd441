"""Queries of the samplings by the role of a product week."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import roles, units
from reviewloom.plans.base import features, register, rounded
from reviewloom.plans.reviews import _flag_sql
from reviewloom.plans.sampled import SMALL_BUDGET as BUDGET
from reviewloom.sources import cut

#: Seeds of each role in the contrast, few enough that strata are cut at the test scales; and its node budget.
PER_ROLE, MAX_NODES = 40, 50000
_INPUTS = ["review_id", "user_id", "prod_id", "date", "week", "rating", "rating_direction", "prior_product_review_count"]


def _parts(s, d, mode="relative"):
    """The reviews and the units with their roles, both written first: each is read for several cutoffs."""
    f = cut(features(s, d).select(*dict.fromkeys([*_INPUTS, *units.UNIT])))
    u = cut(roles.burst_roles(cut(units.flagged(units.product_week_units(f), mode))))
    return f.select(*_INPUTS), u


def _contrast(s, d):
    f, u = _parts(s, d)
    seeds = cut(roles.contrast_seeds(roles.role_nodes(f, u), PER_ROLE))
    return seeds, roles.contrast_edges(f, seeds)


_DELTAS = ", ".join(f"round(abs({c} - (SELECT median({c}) FROM ra WHERE burst_growth_gate)), 9) AS d_{c}" for c in roles.CHANGES)
_CHANGED = " + ".join(f"(d_{c} > (SELECT round(quantile_cont(d_{c}, 0.75), 9) FROM rb WHERE burst_growth_gate))::INT" for c in roles.CHANGES)
_SHIFT = "(SELECT round(quantile_cont(standardized_rating_shift, {}), 9) FROM rb WHERE burst_growth_gate)"
_ROLES = _flag_sql(units.RELATIVE) + f""", r1 AS (SELECT quantile_cont(growth_ratio_30d, 0.75) AS growth, greatest(coalesce(quantile_cont(prior_product_rating_std_median, 0.25) FILTER (prior_product_rating_std_median > 0), 1), 1e-6) AS fl FROM v WHERE base_candidate
), ra AS (SELECT v.*, coalesce(base_candidate AND round(growth_ratio_30d, 9) >= round(growth, 9), false) AS burst_growth_gate, round(coalesce(mean_abs_rating_dev, 0) / greatest(coalesce(prior_product_rating_std_median, fl), fl), 9) AS standardized_rating_shift FROM v, r1
), rb AS (SELECT ra.*, {_DELTAS} FROM ra), rc AS (SELECT rb.*, coalesce({_CHANGED}, 0) AS changes FROM rb
), rd AS (SELECT rc.*, coalesce(burst_growth_gate AND standardized_rating_shift >= {_SHIFT.format(0.75)}, false) AS suspicious, coalesce(burst_growth_gate AND standardized_rating_shift >= {_SHIFT.format(0.9)}, false) AS strong,
    coalesce(burst_growth_gate AND standardized_rating_shift <= {_SHIFT.format(0.5)} AND prior_product_review_count_median >= (SELECT median(prior_product_review_count_median) FROM rb WHERE burst_growth_gate) AND changes <= 1, false) AS normal FROM rc
), ru AS (SELECT *, base_candidate AND NOT suspicious AND NOT normal AS background FROM rd
), hk AS (SELECT *, row_number() OVER (ORDER BY prior_product_review_count, date, review_id) AS hp, count(*) OVER () AS hn FROM f
), rn AS (SELECT hk.review_id, hk.user_id, hk.prod_id, hk.date, hk.week, hk.rating, hk.rating_direction, year(hk.date) AS year, CASE WHEN hp <= 1 + (hn - 1) * 0.25 THEN 0 WHEN hp <= 1 + (hn - 1) * 0.5 THEN 1 WHEN hp <= 1 + (hn - 1) * 0.75 THEN 2 ELSE 3 END AS history_bin,
    base_candidate, selected, standardized_rating_shift AS shift, changes, suspicious, strong, normal, background FROM hk JOIN ru USING (prod_id, week))"""
register(
    "sm07_units",
    lambda s, d: rounded(_parts(s, d)[1].select("prod_id", "week", "standardized_rating_shift", "other_review_property_change_count", "suspicious_burst_unit", "strong_suspicious_burst_unit", "normal_burst_unit", "background_burst_unit")),
    _ROLES + " SELECT prod_id, week, round(standardized_rating_shift, 6) AS standardized_rating_shift, CAST(changes AS BIGINT) AS other_review_property_change_count, suspicious AS suspicious_burst_unit, strong AS strong_suspicious_burst_unit, normal AS normal_burst_unit, background AS background_burst_unit FROM ru",
)


def _take_sql(role: str, column: str, order: str) -> str:
    """A stratified take of ns reviews: floors, then the rest to the largest fractions, then counts, then strata."""
    return f"""q{role} AS (SELECT year, rating_direction, history_bin, count(*) AS c, sum(count(*)) OVER () AS n, round(count(*) / sum(count(*)) OVER () * (SELECT n FROM ns), 9) AS raw FROM rn WHERE {column} GROUP BY ALL
), t{role} AS (SELECT year, rating_direction, history_bin, CASE WHEN n <= (SELECT n FROM ns) THEN c ELSE floor(raw) + (row_number() OVER (ORDER BY floor(raw) - raw, c DESC, year, rating_direction, history_bin) <= (SELECT n FROM ns) - sum(floor(raw)) OVER ())::INT END AS quota FROM q{role}
), k{role} AS (SELECT review_id, strong FROM rn JOIN t{role} USING (year, rating_direction, history_bin) WHERE {column} QUALIFY row_number() OVER (PARTITION BY year, rating_direction, history_bin ORDER BY {order}date, review_id) <= any_value(quota) OVER (PARTITION BY year, rating_direction, history_bin))"""


def _triple_sql(name: str, key: str, apart: str) -> str:
    """The triple of each seed among the reviews of the key on earlier days or weeks."""
    return f"""{name}p AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date, review_id) - 1 AS pos FROM rn), {name}s AS (SELECT a.*, (SELECT count(*) FROM {name}p b WHERE b.{key} = a.{key} AND b.{apart} < a.{apart}) AS n FROM {name}p a SEMI JOIN sd ON sd.review_id = a.review_id
), {name}m AS (SELECT a.review_id, avg(b.rating) AS mean FROM {name}s a JOIN {name}p b ON a.{key} = b.{key} AND b.pos < a.n GROUP BY 1
), {name} AS (SELECT a.review_id, 'recent' AS stage, b.review_id AS chosen FROM {name}s a JOIN {name}p b ON a.{key} = b.{key} AND b.pos = a.n - 1
  UNION ALL SELECT a.review_id, 'mid', b.review_id FROM {name}s a JOIN {name}p b ON a.{key} = b.{key} AND a.n >= 2 AND b.pos = (a.n - 1) // 2
  UNION ALL SELECT review_id, 'baseline', chosen FROM (SELECT a.review_id, b.review_id AS chosen FROM {name}s a JOIN {name}m USING (review_id) JOIN {name}p b ON a.{key} = b.{key} AND a.n >= 2 AND b.pos < greatest(1, a.n // 2) AND b.pos NOT IN (a.n - 1, (a.n - 1) // 2)
    QUALIFY row_number() OVER (PARTITION BY a.review_id ORDER BY round(abs(b.rating - mean), 9), b.pos) = 1))"""


_CONTRAST = f"""{_ROLES}, ns AS (SELECT least({PER_ROLE}, count(*) FILTER (background), count(*) FILTER (suspicious), count(*) FILTER (normal)) AS n FROM rn), {_take_sql("b", "background", "")}, {_take_sql("s", "suspicious", "strong DESC, shift DESC, ")}, {_take_sql("n", "normal", "changes, shift, ")},
sd AS (SELECT review_id, min_by(role, place) AS sample_role, min_by(strong, place) AS strong FROM (SELECT review_id, 0 AS place, 'background_seed' AS role, false AS strong FROM kb UNION ALL SELECT review_id, 1, 'suspicious_seed', strong FROM ks UNION ALL SELECT review_id, 2, 'normal_burst_seed', false FROM kn) GROUP BY review_id),
{_triple_sql("tu", "user_id", "date")}, {_triple_sql("tp", "prod_id", "week")},
ce AS (SELECT chosen AS src, review_id AS dst, 0 AS relation_type, 'user' AS context_kind, stage AS context_stage FROM tu UNION ALL SELECT chosen, review_id, 1, 'product', stage FROM tp UNION ALL SELECT chosen, review_id, 2, 'product_baseline_shock', stage FROM tp JOIN sd USING (review_id) WHERE strong AND stage = 'baseline')"""
register("sm07_edges", lambda s, d: rounded(_contrast(s, d)[1]), _CONTRAST + " SELECT src, dst, CAST(relation_type AS BIGINT) AS relation_type, context_kind, context_stage, sample_role AS seed_role FROM ce JOIN sd ON sd.review_id = ce.dst")


def _contrast_sample(s, d):
    seeds, edges = _contrast(s, d)
    return roles.contrast_sample(seeds, cut(edges), MAX_NODES)


register(
    "sm07",
    _contrast_sample,
    _CONTRAST + ", cx AS (SELECT src AS review_id, bool_or(relation_type = 0) AS u, bool_or(relation_type > 0) AS p FROM ce GROUP BY 1), ca AS (SELECT review_id, coalesce(sample_role, 'context_only') AS sample_role, coalesce(strong, false) AS is_strong_suspicious_seed, coalesce(u, false) AS is_user_context_node, coalesce(p, false) AS is_product_context_node FROM sd FULL JOIN cx USING (review_id)) "
    "SELECT review_id, sample_role, sample_role <> 'context_only' AS is_target_node, sample_role = 'background_seed' AS is_background_seed, sample_role = 'suspicious_seed' AS is_suspicious_seed, sample_role = 'normal_burst_seed' AS is_normal_burst_seed, is_strong_suspicious_seed, is_user_context_node, is_product_context_node, is_user_context_node OR is_product_context_node AS is_context_node FROM ca",
)


def _preserved(s, d):
    f, u = _parts(s, d)
    nodes = cut(roles.role_nodes(f, u))
    return roles.preserved_sample(nodes, f.join(u.where("selected"), ["prod_id", "week"], "left_semi"), room=BUDGET)


register(
    "sm08",
    _preserved,
    _ROLES + f""", pc AS (SELECT *, selected OR suspicious OR normal AS core FROM rn), pr AS (SELECT year, rating_direction, history_bin, count(*) AS c FROM pc WHERE base_candidate AND NOT core GROUP BY ALL), pl AS (SELECT year, rating_direction, history_bin, count(*) AS l FROM pc WHERE core GROUP BY ALL
), pq AS (SELECT pr.*, coalesce(l, 0) AS l, sum(coalesce(l, 0)) OVER () AS t, sum(c) OVER () AS n FROM pr LEFT JOIN pl USING (year, rating_direction, history_bin)), pt AS (SELECT year, rating_direction, history_bin, least(c, floor(round(CASE WHEN t > 0 THEN l / t * {BUDGET} ELSE c / n * {BUDGET} END, 9))) AS quota FROM pq
), pk AS (SELECT review_id FROM (SELECT pc.review_id, quota, row_number() OVER (PARTITION BY year, rating_direction, history_bin ORDER BY date, review_id) AS k FROM pc JOIN pt USING (year, rating_direction, history_bin) WHERE base_candidate AND NOT core) WHERE k <= quota
), pf AS (SELECT review_id FROM pk UNION ALL (SELECT review_id FROM pc WHERE base_candidate AND NOT core AND review_id NOT IN (FROM pk) ORDER BY date, review_id LIMIT (SELECT greatest(0, {BUDGET} - count(*)) FROM pk)))
SELECT review_id, CASE WHEN suspicious THEN 'suspicious_seed' WHEN normal THEN 'normal_burst_seed' WHEN selected THEN 'legacy_core' ELSE 'distribution_fill' END AS sample_role, true AS is_target_node, selected AS is_legacy_core, suspicious AS is_suspicious_seed, normal AS is_normal_burst_seed, strong AS is_strong_suspicious_seed
FROM pc WHERE core OR review_id IN (FROM pf)""",
)
