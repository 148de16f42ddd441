"""A stream of reviews that stops, starts again, and gets late rows."""

from pyspark.sql import functions as F

from reviewloom import streaming
from reviewloom.operators import history
from reviewloom.plans.streams import COLUMNS, SCHEMA
from tests.test_fixtures import nodes


def rows(spark, data):
    f = history.rating_features(nodes(spark, data)).withColumns({"short_review_flag": F.lit(0).cast("long"), "word_len": F.lit(3).cast("long")})
    return f.select(*[x.split()[0] for x in SCHEMA.split(", ")]).withColumn("rating", F.col("rating").cast("long")).coalesce(1)


def run(spark, path):
    streaming.start_history(spark, f"{path}/in", SCHEMA, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return {r.review_id: r for r in spark.read.parquet(f"{path}/out").collect()}


def test_restart_repeats_nothing_and_goes_on_where_it_stopped(spark, tmp_path):
    path = f"file://{tmp_path}"
    first = [(1, 7, 3, "2024-03-04", 5), (2, 7, 3, "2024-03-06", 1), (3, 7, 4, "2024-03-06", 3), (4, 8, 3, "2024-03-06", 2)]
    second = [(5, 7, 3, "2024-03-20", 4), (6, 8, 3, "2024-03-06", 2)]
    rows(spark, first).write.mode("append").parquet(f"{path}/in")
    run(spark, path)
    assert len(run(spark, path)) == spark.read.parquet(f"{path}/out").count() == 4
    rows(spark, second).write.mode("append").parquet(f"{path}/in")
    got = run(spark, path)
    assert spark.read.parquet(f"{path}/out").count() == 6
    whole = history.user_history(history.rating_features(nodes(spark, first + second))).collect()
    for r in whole:
        assert all(abs(r[c] - got[r.review_id][c]) < 1e-9 for c in COLUMNS), r.review_id
        assert not got[r.review_id].late


def test_late_rows_are_marked_and_keep_the_newest_day(spark, tmp_path):
    path = f"file://{tmp_path}"
    for part in ([(5, 7, 3, "2024-03-20", 5)], [(2, 7, 3, "2024-03-06", 1)], [(9, 7, 3, "2024-03-21", 3)]):
        rows(spark, part).write.mode("append").parquet(f"{path}/in")
        got = run(spark, path)
    assert [got[i].late for i in (5, 2, 9)] == [False, True, False]
    assert got[9].prior_user_review_count == 2 and got[9].days_since_user_last_review == 1


def test_weeks_begin_on_monday_and_a_batch_run_again_replaces_its_own(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows(spark, [(1, 7, 3, "2024-01-07", 5), (2, 8, 3, "2024-01-08", 5), (3, 9, 3, "2024-01-14", 5)]).write.parquet(f"{path}/in")
    run(spark, path)
    for _ in range(2):
        streaming.start_weekly(spark, f"{path}/out", f"{path}/weeks", f"{path}/checkpoint-weeks").awaitTermination()
    got = {str(r.week): (r.n, r.new_users, r.words) for r in streaming.latest_weeks(spark, f"{path}/weeks").collect()}
    assert got == {"2024-01-01": (1, 1, 3), "2024-01-08": (2, 2, 6)}


def test_weeks_of_many_files_are_one_batch(spark, tmp_path):
    """A history of as many files as there are tasks is no series of small batches."""
    from reviewloom import streaming

    rows = spark.range(60).selectExpr("id AS review_id", "id % 7 AS user_id", "id % 3 AS prod_id", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS date", "1L AS rating_direction", "0L AS short_review_flag", "5L AS word_len", "0L AS prior_user_review_count", "0D AS prior_user_avg_rating", "0D AS prior_user_rating_std", "0D AS prior_user_extreme_ratio", "1L AS is_new_user_at_review_time", "-1L AS days_since_user_last_review", "false AS late")
    rows.repartition(20).write.parquet(f"{tmp_path}/history")
    streaming.start_weekly(spark, f"{tmp_path}/history", f"{tmp_path}/weeks", f"{tmp_path}/checkpoint", "36500 days", None).awaitTermination()
    assert len(list((tmp_path / "weeks").glob("part=*"))) == 1
    assert streaming.latest_weeks(spark, f"{tmp_path}/weeks").groupBy().sum("n").first()[0] == 60
