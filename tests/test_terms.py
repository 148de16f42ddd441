"""Term counts inside rows: weights beside plain ones, repeated ids, and a plan that deals no term out by document."""

import math
import re
from collections import Counter

import pytest

from reviewloom.operators import matrix

TEXTS = [(1, "Red red fox"), (2, "a b"), (3, None), (4, "red fox red fox"), (5, "fox den"), (5, "den red")]


@pytest.mark.parametrize("rows", [TEXTS[:5], TEXTS])
def test_weights_beside_plain_ones(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {}
    for i, text in rows:
        w = re.findall(r"\w{2,}", (text or "").lower())
        counts.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    n, df = len(counts), Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items() if 2 <= k <= 0.95 * n}
    want = {}
    for i, c in counts.items():
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items() if t in idf))
        want |= {(i, t): k * idf[t] / norm for t, k in c.items() if t in idf}
    got = {(r.doc_id, r.term): r.weight for r in matrix.tfidf(docs, docs).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_no_term_is_dealt_out_by_document(spark):
    docs = spark.createDataFrame(TEXTS[:5], "doc_id long, text string")
    plan = matrix.weighted(docs, ["fox", "red"], [1.0, 2.0])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
