"""Reviews as a stream: prior history with state per user, weekly roll-up with a watermark. An extension of our own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: Keeps state on disk beside memory, with snapshots in the checkpoint folder.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HISTORY = "review_id long, user_id long, prod_id long, date date, rating_direction long, short_review_flag long, word_len long, prior_user_review_count long, prior_user_avg_rating double, prior_user_rating_std double, prior_user_extreme_ratio double, is_new_user_at_review_time long, days_since_user_last_review long, late boolean"
_STATE = "n long, sum double, square double, extreme long, last_day long, last_id long"


class PriorHistory(StatefulProcessor):
    """What a user has written before each of their reviews: six numbers of state a user.

    Rows of a batch are taken in (date, review_id) order. A row that comes before one that an earlier batch held is late:
    its history is what has been seen so far, and it is marked.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        new = parts[0] if len(parts) == 1 else pd.concat(parts)
        day, ids = new["date"].to_numpy().astype("datetime64[D]").astype(np.int64), new["review_id"].to_numpy()
        order = np.lexsort((ids, day))
        taken = {c: new[c].to_numpy()[order] for c in ("review_id", "user_id", "prod_id", "date", "rating_direction", "short_review_flag", "word_len", "rating", "extreme_rating")}
        n0, sum0, square0, extreme0, last_day, last_id = self.state.get() or (0, 0.0, 0.0, 0, None, None)
        day, ids = day[order], taken["review_id"]
        rating, extreme = taken.pop("rating").astype(float), taken.pop("extreme_rating").astype(np.int64)
        before = lambda x, start: start + x.cumsum() - x
        n, total, square, ends = n0 + np.arange(len(ids)), before(rating, sum0), before(rating * rating, square0), before(extreme, extreme0)
        least = np.maximum(n, 1)
        late = np.zeros(len(ids), bool) if last_day is None else (day < last_day) | ((day == last_day) & (ids < last_id))
        latest = np.maximum.accumulate(np.append(-(10**9) if last_day is None else last_day, day))  # the last day seen before each row
        # One frame from arrays: steps on a frame cost more than all else of a user with few rows.
        taken.update(
            prior_user_review_count=n,
            prior_user_avg_rating=total / least,
            prior_user_rating_std=np.sqrt(np.maximum(n * square - total * total, 0)) / least,
            prior_user_extreme_ratio=ends / least,
            is_new_user_at_review_time=(n == 0).astype(np.int64),
            days_since_user_last_review=np.where(n > 0, day - latest[:-1], -1),
            late=late,
        )
        at = (int(day[-1]), int(ids[-1]))
        at = at if last_day is None else max(at, (last_day, last_id))
        self.state.update((int(n[-1]) + 1, float(total[-1] + rating[-1]), float(square[-1] + rating[-1] ** 2), int(ends[-1] + extreme[-1]), *at))
        yield pd.DataFrame(taken)

    def close(self) -> None:
        pass


def with_history(stream: DataFrame) -> DataFrame:
    """HISTORY of a stream of review_id, user_id, prod_id, date, rating, rating_direction, extreme_rating, short_review_flag, word_len."""
    return stream.groupBy("user_id").transformWithStateInPandas(PriorHistory(), HISTORY, "Append", "None")


def weekly(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """Counts per product, direction and week from Monday on, of a stream of HISTORY; weeks ``delay`` behind the newest
    review are forgotten."""
    timed = stream.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", delay)
    week = F.window("ts", "7 days", "7 days", "4 days")  # windows are counted from a Thursday, 1970-01-01
    made = timed.groupBy("prod_id", "rating_direction", week).agg(F.count("*").alias("n"), F.sum("is_new_user_at_review_time").alias("new_users"), F.sum("short_review_flag").alias("short"), F.sum("word_len").alias("words"))
    return made.select("prod_id", "rating_direction", F.to_date("window.start").alias("week"), "n", "new_users", "short", "words")


def _read(spark: SparkSession, schema: str, folder: str, files: int | None) -> DataFrame:
    stream = spark.readStream.schema(schema)
    return (stream if files is None else stream.option("maxFilesPerTrigger", files)).parquet(folder)


def start_history(spark: SparkSession, folder: str, schema: str, to: str, checkpoint: str, files: int | None = 1) -> StreamingQuery:
    """Take the files of a folder that are new since the checkpoint, oldest first, ``files`` a batch or all at once, and
    append their history."""
    spark.conf.set(*STATE_STORE)
    read = _read(spark, schema, folder, files)
    return with_history(read).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_weekly(spark: SparkSession, history: str, to: str, checkpoint: str, delay: str = "60 days", files: int | None = 8) -> StreamingQuery:
    """Roll up the history as it is appended. Each batch writes the weeks that it has changed to a folder of its own number,
    so a batch that is run again replaces what it wrote."""
    spark.conf.set(*STATE_STORE)
    read = _read(spark, HISTORY, history, files)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{to}/part={batch}")

    return weekly(read, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Each week as its last batch left it."""
    names = ["n", "new_users", "short", "words"]
    last = spark.read.parquet(folder).groupBy("prod_id", "rating_direction", "week").agg(F.max_by(F.struct(*names), "batch").alias("x"))
    return last.select("prod_id", "rating_direction", "week", *[F.col(f"x.{n}").alias(n) for n in names])
