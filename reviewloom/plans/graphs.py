"""Queries of message passing, fitted scores and latent text vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reviewloom.operators import edges, latent, matrix, models, network, saved, stats, units
from reviewloom.plans.base import SQL, features, register, rounded
from reviewloom.plans.edges import _CAMPAIGN, _F, _LAST, _TYPED, _nodes, once, typed_edges
from reviewloom.plans.models import _PARTS, train_documents
from reviewloom.plans.scores import _SCORE
from reviewloom.sources import cut, scratch, table

COLUMNS = ["rating_norm", "log_word_len"]
INPUTS = ["rating_norm", "log_word_len", "prior_user_review_count", "prior_product_rating_std", "rating_impact_abs", "upper_ratio"]


def _train():
    return F.col("split") == "train"


def _split(s, d):
    return units.temporal_split(features(s, d))


def _cut_split(s, d, columns):
    """Some columns of the split rows; the features are written first, as the split reads them twice and its users again."""
    return units.temporal_split(cut(features(s, d).select(*dict.fromkeys(["review_id", "date", *columns]))))


def _hop_sql(weight: str) -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in COLUMNS)
    out = ", ".join(f"round(coalesce(sum(w * {c}) / any_value(whole), 0), 6) AS {c}" for c in COLUMNS)
    return _TYPED + f", gw AS (SELECT edge_type, {weight} AS w FROM te GROUP BY edge_type), gm AS (SELECT dst, edge_type, {means} FROM te JOIN f ON f.review_id = te.src GROUP BY ALL), gs AS (SELECT gm.*, w, (SELECT sum(w) FROM gw) AS whole FROM gm JOIN gw USING (edge_type)) SELECT f.review_id, {out.replace('sum(w * ', 'sum(w * gs.')} FROM f LEFT JOIN gs ON gs.dst = f.review_id GROUP BY 1"


register("gn06", lambda s, d: rounded(models.relation_mean(typed_edges(s, d), features(s, d), COLUMNS)), _hop_sql("1"))
register("gn05", lambda s, d: rounded(models.relation_mean(typed_edges(s, d), features(s, d), COLUMNS, {0: 1.0, 1: 0.5, 2: 2.0})), _hop_sql("CASE edge_type WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END"))
register(
    "gn02_gcn",
    lambda s, d: rounded(models.degree_normalised_sum(typed_edges(s, d), features(s, d), COLUMNS)),
    _TYPED + ", gl AS (SELECT src, dst FROM te UNION ALL SELECT review_id, review_id FROM f), gd AS (SELECT dst AS id, count(*) AS d FROM gl GROUP BY 1) SELECT gl.dst AS review_id, " + ", ".join(f"round(sum({c} / sqrt(a.d * b.d)), 6) AS {c}" for c in COLUMNS) + " FROM gl JOIN f ON f.review_id = gl.src JOIN gd a ON a.id = gl.src JOIN gd b ON b.id = gl.dst GROUP BY 1",
)
register(
    "gn04",
    lambda s, d: rounded(models.attention_mean(typed_edges(s, d), features(s, d), COLUMNS)),
    _TYPED + ", ge AS (SELECT te.dst, a.rating_norm, a.log_word_len, a.rating_norm * b.rating_norm + a.log_word_len * b.log_word_len AS e FROM te JOIN f a ON a.review_id = te.src JOIN f b ON b.review_id = te.dst), gp AS (SELECT *, exp(greatest(e, 0.2 * e) - max(greatest(e, 0.2 * e)) OVER (PARTITION BY dst)) AS p FROM ge) SELECT dst AS review_id, " + ", ".join(f"round(sum(p * {c}) / sum(p), 6) AS {c}" for c in COLUMNS) + " FROM gp GROUP BY 1",
)


def _network(s, d):
    return models.network_scores(_cut_split(s, d, ["is_fake", *INPUTS]), INPUTS, "is_fake", _train())


# Fitted models have no SQL.
register("gn01", lambda s, d: rounded(_network(s, d).select("review_id", "split", "is_fake", "score")))
register("tx02", lambda s, d: _vectors(*_texts(s, d)))


def _texts(s, d):
    return table(s, d, "documents").select("doc_id", "text"), train_documents(s, d)


def _vectors(docs, train):
    return latent.learned(docs, train)[0].select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def _campaign(s, d):
    """Cutoffs of training rows; pairs that the user's own edges have are passed over."""
    f = _cut_split(s, d, ["prod_id", "week", "rating_direction", "vec_id", "is_new_user_at_review_time", "short_review_flag", "prior_product_rating_std", "rating_deviation_from_prior_product_mean", *edges.CAMPAIGN_LIFTS])
    return rounded(edges.campaign_pairs(f, table(s, d, "embeddings"), _train(), edges.last_k(_nodes(s, d), "user_id", 5)))


register("ed06", _campaign, _PARTS + _LAST.removeprefix(_F) + _CAMPAIGN + " SELECT src, dst, round(score, 6) AS score FROM ed06")
register(
    "gn03",
    lambda s, d: rounded(models.own_and_mean(typed_edges(s, d), features(s, d), COLUMNS)),
    _TYPED + " SELECT b.review_id, " + ", ".join(f"round(any_value(b.{c}), 6) AS {c}, round(coalesce(avg(a.{c}), 0), 6) AS mean_{c}" for c in COLUMNS) + " FROM f b LEFT JOIN te ON te.dst = b.review_id LEFT JOIN f a ON a.review_id = te.src GROUP BY 1",
)


def _evaluated(s, d):
    """A fixed score at the threshold that is best on validation rows, over test rows."""
    f = _cut_split(s, d, ["is_fake", "rating_norm", "prior_product_review_count"]).withColumn("score", (F.abs("rating_norm") * 37 + F.col("prior_product_review_count") % 61) / 100)
    return rounded(stats.evaluated(f, "score", "is_fake"))


_F1 = "(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2"
register(
    "gn15",
    _evaluated,
    _PARTS + f""", ev AS (SELECT split, is_fake, round({_SCORE}, 9) AS score FROM p1 WHERE split <> 'train'), eg AS (SELECT (t + 4) / 100 AS t FROM range(1, 92) x(t)),
em AS (SELECT split, t, count(*) FILTER (score >= t AND is_fake = 1) AS tp, count(*) FILTER (score >= t AND is_fake = 0) AS fp, count(*) FILTER (score < t AND is_fake = 1) AS fn, count(*) FILTER (score < t AND is_fake = 0) AS tn FROM ev, eg GROUP BY ALL),
et AS (SELECT t FROM em WHERE split = 'valid' ORDER BY round({_F1}, 12) DESC, t LIMIT 1),
eq AS (SELECT score, sum(is_fake) AS p, count(*) AS c FROM ev WHERE split = 'test' GROUP BY score), ez AS (SELECT p, c, sum(p) OVER (ORDER BY score DESC) AS a, sum(c) OVER (ORDER BY score DESC) AS n, sum(c - p) OVER (ORDER BY score) - (c - p) / 2 AS below FROM eq)
SELECT t AS threshold, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS macro_f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
(SELECT round(CASE WHEN sum(p) > 0 AND sum(c - p) > 0 THEN sum(p * a / n) / sum(p) END, 6) FROM ez) AS average_precision, (SELECT round(CASE WHEN sum(p) > 0 AND sum(c - p) > 0 THEN sum(p * below) / (sum(p) * sum(c - p)) END, 6) FROM ez) AS roc_auc FROM em JOIN et USING (t) WHERE split = 'test'""",
)


#: What each session has made of a folder's tables, the graph and a fit on it: the queries of one share it.
_GRAPHS: dict[tuple[str, str], tuple] = {}
_FITS: dict[tuple[str, str], tuple] = {}


def graph(s, d):
    """(nodes, edges) that networks are fitted on: scaled inputs and typed edges."""
    key = s.sparkContext.applicationId, d
    if key not in _GRAPHS:
        x = matrix.scaled(_cut_split(s, d, ["user_id", "is_fake", *INPUTS]), INPUTS, _train()).withColumn("x", F.array(*INPUTS))
        _GRAPHS[key] = cut(network.with_shares(x, "is_fake").select("review_id", F.col("user_id").alias("home"), "split", "is_fake", "y", "share", "x")), cut(typed_edges(s, d))
    return _GRAPHS[key]


def fitted(s, d):
    """(scores, log, model, weights, nodes, edges) of a relation network on the typed edges."""
    key = s.sparkContext.applicationId, d
    if key not in _FITS:
        nodes, links = graph(s, d)
        model = network.RelationNetwork(len(INPUTS), 3, hidden=16, layers=2)
        weights, log = network.fit(model, nodes, links, epochs=12, patience=5)
        _FITS[key] = model.scores(weights), log, model, weights, nodes, links
    return _FITS[key]


LOG = "epoch long, train_loss double, valid_average_precision double, is_best boolean"
register("gn07", lambda s, d: rounded(fitted(s, d)[0].select("review_id", "split", F.col("y").cast("long").alias("is_fake"), "score")))
register("gn11", lambda s, d: rounded(s.createDataFrame(fitted(s, d)[1], LOG)))


def _summary(s, d):
    scored, log, *_ = fitted(s, d)
    best = next((epoch for epoch, *_, is_best in log if is_best), None)
    return rounded(stats.evaluated(scored.withColumnRenamed("y", "is_fake"), "score", "is_fake").select(F.lit("relation_network").alias("experiment"), F.lit("completed").alias("status"), F.lit(best).cast("long").alias("best_epoch"), "*"))


register("gn14", _summary)


def _training_tables(s, d):
    """The log, predictions, metrics and weights of a fit, written and read again: the log with the metrics of its best epoch."""
    scored, log, model, weights, *_ = fitted(s, d)
    path = scratch(s, "training")
    s.createDataFrame(log, LOG).coalesce(1).write.csv(f"{path}/log", header=True)
    scored.write.partitionBy("split").parquet(f"{path}/predictions")
    stats.evaluated(s.read.parquet(f"{path}/predictions").withColumnRenamed("y", "is_fake"), "score", "is_fake").write.json(f"{path}/metrics")
    saved.NetworkModel(weights, model).write().save(f"{path}/weights")
    metrics = s.read.json(f"{path}/metrics").select("threshold", "tn", "fp", "fn", "tp", "average_precision")
    return rounded(s.read.schema(LOG).csv(f"{path}/log", header=True).join(F.broadcast(metrics), F.col("is_best"), "left"))


register("snk08", _training_tables)


def _scored_again(s, d):
    """Saved weights, loaded, score the nodes as the fit did: scores of both, which agree."""
    scored, _, model, weights, nodes, links = fitted(s, d)
    path = scratch(s, "network")
    saved.NetworkModel(weights, model).write().save(path)
    again = saved.NetworkModel.load(path).over(links).transform(nodes)
    return rounded(scored.select("review_id", "score").join(again.select("review_id", F.col("score").alias("loaded_score")), "review_id"))


register("snk08_weights", _scored_again)

_SCALED = ["prior_user_review_count", "word_len", "rating_impact_abs"]


def _saved_scale(s, d):
    """A scale learned on training rows, saved, loaded and applied."""
    f = _split(s, d).select("review_id", _train().alias("train"), *_SCALED)
    path = scratch(s, "scale")
    saved.Scale(_SCALED, "train").fit(f).write().save(path)
    return rounded(saved.ScaleModel.load(path).transform(f).select("review_id", *_SCALED))


register(
    "snk07",
    _saved_scale,
    _PARTS + ", z AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _SCALED) + " FROM p1 WHERE split = 'train') SELECT review_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED) + " FROM p1, z",
)


def _saved_vectors(s, d):
    """A text model of a few dimensions, saved and loaded: its weights per term, and that its vectors are as long as they say."""
    docs, train = _texts(s, d)
    _, basis = latent.learned(docs, train, 8)
    path = scratch(s, "vectors")
    saved.TextVectorsModel(basis).write().save(path)
    return rounded(saved.TextVectorsModel.load(path).weights(docs))


register("snk15", _saved_vectors, SQL["tx01"])

# Forward passes with given weights.
_GIVEN = lambda n, m, salt: [[((7 * i + 3 * j + salt) % 11 - 5) / 10 for j in range(m)] for i in range(n)]
_HEADS, _EACH = 4, 2


def _given_nodes(f):
    return f.select("review_id", F.col("user_id").alias("home"), F.lit("train").alias("split"), F.lit(0.0).alias("y"), F.lit(0.0).alias("share"), F.array(*COLUMNS).alias("x"))


def _heads(s, d):
    """One layer of four heads with given weights: each node's output."""
    model = network.AttentionNetwork(len(COLUMNS), hidden=_HEADS * _EACH, layers=2, heads=_HEADS)
    f = once(s, d, COLUMNS)
    model.prepare(_given_nodes(f), typed_edges(s, d, f))
    w = {"map0": np.array(_GIVEN(2, _HEADS * _EACH, 1)), "src0": np.array(_GIVEN(_HEADS, _EACH, 2)), "dst0": np.array(_GIVEN(_HEADS, _EACH, 5))}
    return rounded(model.attended(w).select("review_id", *[F.col("o")[k * _EACH + c].alias(f"o{k}{c}") for k in range(_HEADS) for c in range(_EACH)]))


def _dot(columns, weights):
    return "(" + " + ".join(f"{c} * ({w})" for c, w in zip(columns, weights, strict=True)) + ")"


def _heads_sql():
    m, a, b = _GIVEN(2, _HEADS * _EACH, 1), _GIVEN(_HEADS, _EACH, 2), _GIVEN(_HEADS, _EACH, 5)
    t = [f"{_dot(COLUMNS, [m[0][i], m[1][i]])} AS t{i}" for i in range(_HEADS * _EACH)]
    own = lambda k: [f"t{k * _EACH + c}" for c in range(_EACH)]
    ends = [f"{_dot(own(k), w[k])} AS {n}{k}" for k in range(_HEADS) for n, w in (("s", a), ("d", b))]
    power = [f"exp(CASE WHEN x.s{k} + y.d{k} > 0 THEN x.s{k} + y.d{k} ELSE 0.2 * (x.s{k} + y.d{k}) END) AS p{k}" for k in range(_HEADS)]
    out = [f"round(sum(p{k} * t{k * _EACH + c}) / sum(p{k}), 6) AS o{k}{c}" for k in range(_HEADS) for c in range(_EACH)]
    return f"""{_TYPED}, ga AS (SELECT review_id, {", ".join(t)} FROM f), gb AS (SELECT *, {", ".join(ends)} FROM ga), ge AS (SELECT src, dst FROM te UNION ALL SELECT review_id, review_id FROM f),
gc AS (SELECT dst, x.*, {", ".join(power)} FROM ge JOIN gb x ON x.review_id = ge.src JOIN gb y ON y.review_id = ge.dst) SELECT dst AS review_id, {", ".join(out)} FROM gc GROUP BY 1"""


register("gn04_heads", _heads, _heads_sql())


def _relations(s, d):
    """One layer of relation maps with given weights, before and after the rectifier."""
    model = network.RelationNetwork(len(COLUMNS), 3, hidden=3, layers=1, own_branch=False)
    f = once(s, d, COLUMNS)
    model.prepare(_given_nodes(f), typed_edges(s, d, f))
    w = {"self0": np.array(_GIVEN(2, 3, 4)), "bias0": np.array(_GIVEN(1, 3, 2)[0]), "rel0": np.array([_GIVEN(2, 3, r) for r in range(3)]), "relb0": np.array(_GIVEN(3, 3, 6)), "out": np.eye(3, 2), "outb": np.zeros(2)}
    return rounded(model.outputs(w).select("review_id", *[F.col("h")[i].alias(f"h{i}") for i in range(3)]))


def _relations_sql():
    own, rel, relb, bias = _GIVEN(2, 3, 4), [_GIVEN(2, 3, r) for r in range(3)], _GIVEN(3, 3, 6), _GIVEN(1, 3, 2)[0]
    column = lambda m, i: [m[0][i], m[1][i]]
    means = ", ".join(f"coalesce(avg(a.{c}) FILTER (edge_type = {r}), 0) AS {c}{r}" for c in COLUMNS for r in range(3))
    part = lambda r, i: f"CASE WHEN {r} IN (SELECT edge_type FROM te) THEN {_dot([f'{c}{r}' for c in COLUMNS], column(rel[r], i))} + ({relb[r][i]}) ELSE 0 END"
    out = [f"round(greatest(0, {_dot([f'f.{c}' for c in COLUMNS], column(own, i))} + ({bias[i]}) + ({' + '.join(part(r, i) for r in range(3))}) / (SELECT count(DISTINCT edge_type) FROM te)), 6) AS h{i}" for i in range(3)]
    return f"{_TYPED}, gm AS (SELECT f.review_id, {means} FROM f LEFT JOIN te ON te.dst = f.review_id LEFT JOIN f a ON a.review_id = te.src GROUP BY 1) SELECT f.review_id, {', '.join(out)} FROM f JOIN gm USING (review_id)"


register("gn06_layer", _relations, _relations_sql())


def _attention(s, d):
    """Scores of a fitted attention network with four heads."""
    nodes, links = graph(s, d)
    model = network.AttentionNetwork(len(INPUTS), hidden=16, layers=2, heads=4)
    weights, _ = network.fit(model, nodes, links, epochs=6, patience=3)
    return rounded(model.scores(weights).select("review_id", "split", F.col("y").cast("long").alias("is_fake"), "score"))


register("gn04_fit", _attention)
