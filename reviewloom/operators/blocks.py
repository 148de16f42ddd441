"""Rows of two tables that meet in blocks inside a key, so that a task holds two blocks and hands on few rows a source."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources of a block that are compared at once, and targets of which one largest similarity is taken.
ROWS, GROUP = 256, 64


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; an all-zero vector stays as it is."""
    m = np.array(vectors.to_list(), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def at_least_kth(values: np.ndarray, k: int, slack: float, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the values that may be among their row's ``k`` largest, or within ``slack`` of them, and that reach
    ``least`` less the slack.

    The k-th largest of the maxima of k groups or more is a value that k of the row reach, so nothing below it is wanted:
    two passes over the values, and none is sorted.
    """
    n = values.shape[1]
    bound = np.full(len(values), least)
    if n > k:
        step = min(GROUP, n // k)
        most = values[:, : n // step * step].reshape(len(values), step, n // step).max(axis=1)
        bound = np.maximum(bound, np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k])
    return np.nonzero(values >= (bound - slack)[:, None].astype(values.dtype))


def first_of_each(rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows that are in order, places of the first ``k`` of each."""
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])[: len(rows)])
    return np.flatnonzero(np.arange(len(rows)) - np.repeat(begins, np.diff(np.append(begins, len(rows)))) < k)


def in_blocks(sources: DataFrame, targets: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int) -> DataFrame:
    """What ``kernel`` makes of each block of ``sources`` (keys, src, ...) and each block of ``targets`` (keys, dst, ...) of
    the same keys, of about ``block`` rows each."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sizes = counted(sources, "_q").join(counted(targets, "_t"), keys)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    a = sources.join(sizes, keys).withColumn("_qb", spot("src", "_q")).withColumn("_tb", every("_t")).drop("_q", "_t")
    b = targets.join(sizes, keys).withColumn("_tb", spot("dst", "_t")).withColumn("_qb", every("_q")).drop("_q", "_t")
    by = [*keys, "_qb", "_tb"]
    b = b.select(*[F.col(c).alias(f"_to{c}") for c in by], *[F.col(c).alias(c) for c in b.columns if c not in by])
    return a.groupBy(*by).cogroup(b.groupBy(*[f"_to{c}" for c in by])).applyInPandas(kernel, schema)


def gathered(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else [] for i, n in enumerate(names)})


def pieces(rows: np.ndarray, cols: np.ndarray, most: int = 1_000_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidates in stretches, as equal values can make very many."""
    return [(rows[i : i + most], cols[i : i + most]) for i in range(0, len(rows), most)]
