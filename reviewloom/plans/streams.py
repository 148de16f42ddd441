"""Queries that feed the reviews to streams, in three parts by date."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom import streaming
from reviewloom.operators import history, units
from reviewloom.plans import models  # noqa: F401  (has the SQL of ag05)
from reviewloom.plans.base import FEATURES_SQL, SQL, register, rounded, sql_columns, texts
from reviewloom.sources import cut, reviews, scratch, standardize

SCHEMA = "review_id long, user_id long, prod_id long, date date, rating long, rating_direction long, extreme_rating long, short_review_flag long, word_len long"
COLUMNS = ["prior_user_review_count", "prior_user_avg_rating", "prior_user_rating_std", "prior_user_extreme_ratio", "is_new_user_at_review_time", "days_since_user_last_review"]


def _fed(s, d) -> str:
    """The folder of a history that was streamed in three runs, each a part of the reviews by date: as many files as there
    are tasks, taken in one batch."""
    path = scratch(s, "stream")
    f = history.rating_features(standardize(reviews(s, d))).join(texts(s, d).select("doc_id", "short_review_flag", "word_len"), "doc_id")
    parts = cut(units.temporal_split(f).select(*[x.split()[0] for x in SCHEMA.split(", ")], "split"))
    for part in ("train", "valid", "test"):
        parts.where(F.col("split") == part).drop("split").write.mode("append").parquet(f"{path}/reviews")
        streaming.start_history(s, f"{path}/reviews", SCHEMA, f"{path}/history", f"{path}/checkpoint-history", None).awaitTermination()
    return path


def _weeks(s, d):
    path = _fed(s, d)
    streaming.start_weekly(s, f"{path}/history", f"{path}/weeks", f"{path}/checkpoint-weeks", "36500 days", None).awaitTermination()
    return rounded(streaming.latest_weeks(s, f"{path}/weeks"))


register("stream_history", lambda s, d: rounded(s.read.parquet(f"{_fed(s, d)}/history").select("review_id", *COLUMNS, F.col("late").cast("long").alias("late"))), f"WITH {FEATURES_SQL} SELECT {sql_columns(['review_id', *COLUMNS])}, CAST(0 AS BIGINT) AS late FROM f")
register("stream_weeks", _weeks, SQL["ag05"])
