"""Checks of inputs and artifacts, and small governance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each role may do; fixed values.
ROLES = [("viewer", True, False, False), ("reviewer", True, True, False), ("admin", True, True, True)]
ROLE_SCHEMA = "role string, may_read boolean, may_export boolean, may_change boolean"


def ratio_checks(parts: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Adds ok: train, valid and test are positive and sum to one."""
    whole = F.col("train") + F.col("valid") + F.col("test")
    return parts.withColumn("ok", (F.least("train", "valid", "test") > 0) & (F.abs(whole - 1) <= tolerance))


def input_violations(nodes: DataFrame, required: list[str], expected_rows: int) -> DataFrame:
    """One row: required columns that are missing, null dates, and rows that are missing."""
    missing = len([c for c in required if c not in nodes.columns])
    return nodes.agg(F.lit(missing).cast("long").alias("missing_columns"), F.count_if(F.col("date").isNull()).alias("null_dates"), (F.lit(expected_rows) - F.count("*")).alias("rows_short"))


def graph_violations(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes (review_id, x, label) without a feature or a label of 0 or 1, and edges whose end is no node."""
    own = nodes.agg(F.count_if(F.col("x").isNull()).alias("null_features"), F.count_if(~F.col("label").isin(0, 1)).alias("bad_labels"))
    loose = links.join(nodes.select(F.col("review_id").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("unknown_ends"))
    return own.crossJoin(loose)  # one row each


def compared(expected: DataFrame, actual: DataFrame, tolerance: float) -> DataFrame:
    """Expected values (name, expected) beside measured ones (name, actual); ok where they agree."""
    ok = F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tolerance, F.lit(False))
    return expected.join(actual, "name", "left").select("name", "expected", "actual", ok.alias("ok"))


def registered(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Artifacts (name, ...) beside the files there are (name, size_bytes, sha256): whether each exists, its size and digest."""
    return expected.join(found, "name", "left").withColumn("exists", F.col("sha256").isNotNull())


def rehashed(registry: DataFrame, found: DataFrame) -> DataFrame:
    """(name, unchanged): whether each registered file still has its digest."""
    now = found.select("name", F.col("sha256").alias("_now"))
    return registry.where("exists").join(now, "name", "left").select("name", F.coalesce(F.col("_now") == F.col("sha256"), F.lit(False)).alias("unchanged"))
