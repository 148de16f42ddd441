"""Texts that CSV may change: empty, blank, with blanks or line breaks at their ends, quotes, and none at all."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewloom.sources import RAW_SCHEMA, read_reviews, write_csv
from tests.compare import differences
from tests.conftest import SMALL

ODD = ["", " ", "\t", "\n", " lead", "trail ", "\n both \r\n", 'q"q', '"', '""', "\\", '\\"', 'a\\"b,c', ",", "a\rb", "\x00a", "\x01", "﻿x", "#c", None]


def test_texts_come_back_as_they_were(spark, tmp_path):
    rows = [(i, 1, 1, 1.0, 1, "2024-01-01", text, 'tag "4", x') for i, text in enumerate(ODD)]
    write_csv(spark.createDataFrame(rows, RAW_SCHEMA), f"file://{tmp_path}/csv")
    assert sorted(tuple(r) for r in read_reviews(spark, f"file://{tmp_path}/csv").collect()) == rows


def test_a_cell_without_quotes_is_null(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('review_id,user_id,prod_id,rating,label,date,text,tag\n1,1,1,4,1,2024-01-01,,""\n2,1,1,,1,2024-01-01,x,\n')
    got = read_reviews(spark, f"file://{tmp_path}/raw.csv").select("review_id", "rating", "text", "tag").collect()
    assert sorted(tuple(r) for r in got) == [(1, 4.0, None, ""), (2, None, "x", None)]


@pytest.mark.parametrize("name", ["src02", "snk01", "snk10"])
def test_queries_keep_odd_texts(spark, tmp_path, name):
    for f in os.listdir(SMALL):
        if f != "documents.parquet":
            os.symlink(f"{SMALL}/{f}", tmp_path / f)
    odd = F.get(F.array(*[F.lit(t).cast("string") for t in ODD]), (F.col("doc_id") % len(ODD)).cast("int"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.withColumn("text", F.when(F.col("doc_id") < 3 * len(ODD), odd).otherwise(F.col("text"))).toPandas().to_parquet(tmp_path / "documents.parquet")
    assert not differences(entry.queries()[name](spark, str(tmp_path)), entry.oracle_sql()[name], str(tmp_path))
