"""Pairs of a hot key: all of them, in many tasks of few rows."""

from collections import Counter

from pyspark.sql import functions as F

from reviewloom.operators import edges


def test_pairs_of_a_hot_key_are_all_there_in_many_tasks(spark):
    rows = [(1, i) for i in range(300)] + [(2, 1000), (2, 1001), (3, 2000), (None, 3000), (None, 3001)]
    df = spark.createDataFrame(rows, "k long, review_id long")
    made = edges.equal_pairs(df, ["k"], block=40).withColumn("task", F.spark_partition_id()).collect()
    got = [(r.src, r.dst) for r in made]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for k, a in rows for j, b in rows if k is not None and k == j and a != b}
    tasks = Counter(r.task for r in made if r.src < 300)
    assert len(tasks) == 8 and max(tasks.values()) < 300 * 299 / 3
