"""Gradients beside finite differences, forward passes beside plain loops, and fits on planted labels."""

import numpy as np
import pytest

from reviewloom.operators import network, stats

RNG = np.random.default_rng(11)


def graph(spark, n, seed, inputs=3, planted=False):
    """(nodes, edges, x, y, typed edges): three relations, of which one may lack edges; some nodes have none."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, inputs))
    pairs = {(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, n, 4 * n), rng.integers(0, n - 2, 4 * n), rng.integers(0, 2, 4 * n), strict=True) if a != b}
    if planted:  # the label is the sign of what the in-neighbours of relation 1 have in their first column
        mean = np.array([np.mean([x[a, 0] for a, b, t in pairs if b == i and t == 1] or [0.0]) for i in range(n)])
        y = (mean > 0).astype(int)
    else:
        y = rng.integers(0, 2, n)
    split = np.array(["train", "train", "train", "valid", "test"])[np.arange(n) % 5]
    rows = [(i, str(split[i]), int(y[i]), x[i].tolist()) for i in range(n)]
    nodes = spark.createDataFrame(rows, "review_id long, split string, is_fake long, x array<double>")
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long, edge_type int")
    return network.with_shares(nodes, "is_fake"), edges, x, y, sorted(pairs), split


MODELS = {
    "relations": lambda d: network.RelationNetwork(3, 3, hidden=4, layers=2, dropout=d, relation_dropout=d),
    "learned mix, three layers": lambda d: network.RelationNetwork(3, 3, hidden=4, layers=3, dropout=d, relation_dropout=0.0, learned_mix=True),
    "one layer, no own branch": lambda d: network.RelationNetwork(3, 3, hidden=4, layers=1, dropout=d, own_branch=False),
    "attention": lambda d: network.AttentionNetwork(3, hidden=4, layers=2, heads=2, dropout=d),
}


@pytest.mark.parametrize("name, dropout", [("relations", 0.4), ("learned mix, three layers", 0.0), ("one layer, no own branch", 0.0), ("attention", 0.0), ("attention", 0.4)])
def test_gradients_are_those_of_finite_differences(spark, name, dropout):
    nodes, edges, *_ = graph(spark, 20, 1)
    model = MODELS[name](dropout)
    model.prepare(nodes, edges)
    w = {k: v + 0.1 * RNG.normal(size=v.shape) for k, v in model.initial(3).items()}
    salt = 5 if dropout else None
    at = lambda w: model.gradients(w, np.random.default_rng(8) if dropout else None, salt)
    _, g = at(w)
    assert all(np.abs(v).max() > 0 for k, v in g.items())
    for i in range(2):
        step = {k: np.random.default_rng(i).normal(size=v.shape) for k, v in w.items()}
        e = 1e-5
        up, down = at({k: v + e * step[k] for k, v in w.items()})[0], at({k: v - e * step[k] for k, v in w.items()})[0]
        assert (up - down) / (2 * e) == pytest.approx(sum((g[k] * step[k]).sum() for k in w), rel=1e-4, abs=1e-7)
    model.release()


def test_relation_scores_are_those_of_a_plain_pass(spark):
    nodes, edges, x, y, pairs, _ = graph(spark, 20, 2)
    model = network.RelationNetwork(3, 3, hidden=4, layers=2, learned_mix=True)
    model.prepare(nodes, edges)
    w = {k: v + 0.1 * RNG.normal(size=v.shape) for k, v in model.initial(4).items()}
    h = x
    for l in range(2):
        mix = np.exp(w[f"mix{l}"][:2]) / np.exp(w[f"mix{l}"][:2]).sum()  # the third relation has no edge
        z = h @ w[f"self{l}"] + w[f"bias{l}"]
        for r in range(2):
            for i in range(20):
                near = [h[a] for a, b, t in pairs if b == i and t == r]
                z[i] += mix[r] * ((np.mean(near, axis=0) if near else np.zeros(h.shape[1])) @ w[f"rel{l}"][r] + w[f"relb{l}"][r])
        h = np.maximum(z, 0)
    own = np.maximum(np.maximum(x @ w["own1"] + w["own1b"], 0) @ w["own2"] + w["own2b"], 0)
    logits = np.concatenate([own, h], axis=1) @ w["out"] + w["outb"]
    p = np.exp(logits[:, 1]) / np.exp(logits).sum(1)
    assert np.allclose([r.score for r in model.scores(w).orderBy("review_id").collect()], p)
    assert sum(a for l, _, a in model.relation_weights(w) if l == 0) == pytest.approx(1.0)
    model.release()


def test_attention_scores_are_those_of_a_plain_pass(spark):
    nodes, edges, x, y, pairs, _ = graph(spark, 20, 2)
    model = network.AttentionNetwork(3, hidden=8, layers=2, heads=4)
    model.prepare(nodes, edges)
    w = {k: v + 0.1 * RNG.normal(size=v.shape) for k, v in model.initial(4).items()}
    h = x
    for l, (_, k, c) in enumerate(model.shapes):
        t = (h @ w[f"map{l}"]).reshape(20, k, c)
        out = np.zeros((20, k, c))
        for i in range(20):
            near = [a for a, b, _ in pairs if b == i] + [i]
            for j in range(k):
                e = np.array([(t[a, j] * w[f"src{l}"][j]).sum() + (t[i, j] * w[f"dst{l}"][j]).sum() for a in near])
                e = np.exp(np.where(e > 0, e, 0.2 * e))
                out[i, j] = (e / e.sum()) @ t[near, j]
        h = out.reshape(20, -1) + w[f"bias{l}"]
        h = np.where(h > 0, h, np.expm1(np.minimum(h, 0))) if l == 0 else h
    p = np.exp(h[:, 1]) / np.exp(h).sum(1)
    assert np.allclose([r.score for r in model.scores(w).orderBy("review_id").collect()], p)
    model.release()


def test_fit_learns_what_a_relation_tells_and_repeats(spark):
    """Labels follow the neighbours' columns, which own columns cannot tell."""
    nodes, edges, *_ = graph(spark, 240, 6, planted=True)
    model = network.RelationNetwork(3, 3, hidden=8, layers=1, dropout=0.1, relation_dropout=0.0)
    w, log = network.fit(model, nodes, edges, epochs=24, patience=24, rate=0.05, seed=3)
    scores = model.scores(w).collect()
    again = network.RelationNetwork(3, 3, hidden=8, layers=1, dropout=0.1, relation_dropout=0.0)
    assert np.allclose([x[:3] for x in network.fit(again, nodes, edges, epochs=2, rate=0.05, seed=3)[1]], [x[:3] for x in log[:2]], atol=1e-9)
    assert log[0][1] > log[-1][1] and sum(best for *_, best in log) == 1
    test = spark.createDataFrame([r for r in scores if r.split == "test"])
    assert stats.average_precision(test, "score", "y").first()[0] > test.agg({"y": "avg"}).first()[0] + 0.2
    reached = stats.roc_auc(test, "score", "y").first()[0]
    assert reached > 0.8
    own = network.RelationNetwork(3, 3, hidden=8, layers=1, dropout=0.1)
    none, _ = network.fit(own, nodes, edges.limit(0), epochs=6, rate=0.05, seed=3)
    blind = spark.createDataFrame([r for r in own.scores(none).collect() if r.split == "test"])
    assert stats.roc_auc(blind, "score", "y").first()[0] < reached - 0.1
    for m in (model, again, own):
        m.release()


def test_fit_stops_when_validation_no_longer_rises(spark):
    nodes, edges, *_ = graph(spark, 30, 7)
    model = network.AttentionNetwork(3, hidden=4, layers=2, heads=2)
    w, log = network.fit(model, nodes, edges, epochs=6, patience=1, rate=0.0, seed=3)
    assert len(log) == 2 and log[0][3] and not log[1][3]
    model.release()


def test_dropout_depends_on_the_id_alone():
    a, b = network.kept(np.arange(2000), 8, 3, 0.25), network.kept(np.arange(2000)[::-1], 8, 3, 0.25)
    assert (a == b[::-1]).all() and set(np.unique(a)) == {0.0, 1 / 0.75}
    assert abs((a > 0).mean() - 0.75) < 0.02
    assert (network.kept(np.arange(50), 8, 4, 0.25) != a[:50]).any()
