"""Every registered query that has SQL gives the rows of its SQL; the others give rows of which something is known."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences
from tests.conftest import SMALL

LLM = entry._llm()[0]
NAMES = [n for n in entry.queries() if n not in LLM]
REVIEWS = 1000


def scored(rows):
    assert len({r.review_id for r in rows}) == len(rows) == REVIEWS
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows}) > 10
    assert {r.split for r in rows} == {"train", "valid", "test"}


def mutual(rows):
    pairs = {(r.src, r.dst) for r in rows}
    assert len(pairs) == len(rows) and all(a != b and (b, a) in pairs for a, b in pairs)


def logged(rows):
    assert sorted(r.epoch for r in rows) == list(range(1, len(rows) + 1))
    best = max(rows, key=lambda r: (r.valid_average_precision, -r.epoch))
    assert [r.epoch for r in rows if r.is_best] == [best.epoch]


def measured(rows):
    (r,) = rows
    assert r.tn + r.fp + r.fn + r.tp == REVIEWS // 5 and 0 <= r.roc_auc <= 1 and r.best_epoch >= 1


def projected(rows):
    assert len({len(r.vector) for r in rows}) == 1 and all(sum(x * x for x in r.vector) <= 1 + 1e-4 for r in rows)


def agreed(rows):
    assert len(rows) == REVIEWS and all(abs(r.score - r.loaded_score) < 1e-5 for r in rows)


def chance(rows):
    (r,) = rows
    assert 0 <= r.ks_statistic <= 1 and 0 <= r.p_value <= 1


#: What holds of the rows of queries that have no SQL.
KNOWN = {"ed01": mutual, "ed04": mutual, "ed07": mutual, "ed09": mutual, "gn01": scored, "gn04_fit": scored, "gn07": scored, "gn11": logged, "gn14": measured, "snk08": logged, "snk08_weights": agreed, "ts08_exact": chance, "tx02": projected}


def test_entry_runs(spark):
    assert entry.entry(spark).columns


def test_every_query_is_held_against_something():
    assert {n for n in NAMES if n not in entry.oracle_sql()} == set(KNOWN)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, SMALL)
    if name in KNOWN:
        KNOWN[name](df.collect())
    else:
        assert not differences(df, entry.oracle_sql()[name], SMALL)
