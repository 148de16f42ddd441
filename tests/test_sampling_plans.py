"""What samplings read several times is written once, and units take no median per user."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from reviewloom.operators import sampling, units
from reviewloom.plans.base import features
from tests.conftest import SMALL


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_units_count_users_without_medians_per_user(spark):
    f = features(spark, SMALL).select(*units.UNIT).localCheckpoint()
    found = units.product_week_units(f)
    assert not any("Aggregate(keys=" in line and "user_id" in line.split("functions=")[0] for line in plan(found).split("\n"))
    wanted = f.groupBy("prod_id", "week").agg(F.count_distinct("user_id").alias("n_users"))
    assert sorted(found.select("prod_id", "week", "n_users").collect()) == sorted(wanted.collect())
    nobody = units.product_week_units(f.withColumn("user_id", F.lit(None).cast("long")))
    assert {r[0] for r in nobody.select("n_users").distinct().collect()} == {0}


def test_choice_reads_what_was_reached_from_a_table(spark):
    f = features(spark, SMALL).select(*sampling.REACH)
    assert "Window" not in plan(sampling.shock_context(f, 600))


def test_samplings_read_events_once(spark, monkeypatch):
    """The histories' passes start at tables: before, one plan read and parsed events four times."""
    from reviewloom.plans import base, sampled

    seen, cut = [], base.cut
    monkeypatch.setattr(base, "cut", lambda df: seen.append(plan(df)) or cut(df))
    made = sampled._rows(spark, SMALL)
    assert sum(p.count("events.parquet") for p in [*seen, plan(made)]) == 1
    same = features(spark, SMALL).select(*made.columns)
    assert made.exceptAll(same).isEmpty() and same.exceptAll(made).isEmpty()


def test_dates_are_not_parsed_again(spark):
    from reviewloom.sources import reviews, standardize

    dates = standardize(reviews(spark, SMALL))
    assert "timestamp(" not in plan(dates).replace("to_timestamp", "timestamp").replace("gettimestamp", "timestamp") and dates.schema["date"].dataType.simpleString() == "date"


def test_days_before_are_counted_once_a_day(spark):
    """Reviews of the 7 and 30 days before, on days of many weeks with gaps, and no pass over a list of days for each review."""
    import datetime as dt
    import random

    from reviewloom.operators import history

    rng, first = random.Random(5), dt.date(2023, 12, 1)
    rows = [(i, rng.randint(1, 9), rng.randint(1, 3), first + dt.timedelta(days=rng.choice([0, 1, 2, 6, 7, 8, 29, 30, 31, 32, 60, 400])), rng.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "review_id long, user_id long, prod_id long, date date, rating long")
    found = history.product_history(history.rating_features(df)).select("review_id", "product_reviews_last_7d", "product_reviews_last_30d")
    assert "lambdafunction" not in plan(found)
    last = lambda r, n: sum(1 for x in rows if x[2] == r[2] and 1 <= (r[3] - x[3]).days <= n)
    assert {tuple(x) for x in found.collect()} == {(r[0], last(r, 7), last(r, 30)) for r in rows}
