"""Message passing over typed edges with fixed weights, and a classifier on own columns."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators import edges as E
from reviewloom.operators import matrix
from reviewloom.sources import cut


def relation_mean(edges: DataFrame, values: DataFrame, columns: list[str], weights: dict[int, float] | None = None) -> DataFrame:
    """One hop: per node the weighted mean over edge types of its in-neighbours' mean, under the columns' own names.

    A type that no edge has does not count; a type that only this node lacks counts as 0. Weights default to equal ones.
    """
    weight = reduce(lambda e, t: e.when(F.col("edge_type") == t, weights[t]), weights, F.when(F.lit(False), 0.0)).otherwise(0.0) if weights else F.lit(1.0)
    active = edges.select("edge_type").distinct().agg(F.sum(weight).alias("_whole"))
    means = E.neighbour_means(edges, values, columns).withColumn("_w", weight).crossJoin(F.broadcast(active))
    summed = means.groupBy("review_id").agg(*[(F.sum(F.col(f"mean_{c}") * F.col("_w") / F.col("_whole"))).alias(c) for c in columns])
    return values.select("review_id").join(summed, "review_id", "left").fillna(0.0, columns)


def degree_normalised_sum(edges: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """One hop with self-loops: sum of in-neighbours over the root of both ends' in-degrees, the loop included."""
    ends = edges.select("src", "dst").unionByName(values.select(F.col("review_id").alias("src"), F.col("review_id").alias("dst")))
    degree = ends.groupBy("dst").agg(F.count("*").cast("double").alias("d"))
    sent = values.join(degree.withColumnRenamed("dst", "review_id"), "review_id").select(F.col("review_id").alias("src"), F.col("d").alias("ds"), *columns)
    met = ends.join(sent, "src").join(degree, "dst")
    return met.groupBy(F.col("dst").alias("review_id")).agg(*[F.sum(F.col(c) / F.sqrt(F.col("ds") * F.col("d"))).alias(c) for c in columns])


def attention_mean(edges: DataFrame, values: DataFrame, columns: list[str], slope: float = 0.2) -> DataFrame:
    """One hop: in-neighbours weighed by the softmax, over the node's incoming edges, of a leaky dot product of both ends."""
    end = lambda p: values.select(F.col("review_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    raw = reduce(lambda a, b: a + b, [F.col(f"src_{c}") * F.col(f"dst_{c}") for c in columns])
    met = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").withColumn("_e", F.greatest(raw, raw * slope))
    met = met.withColumn("_p", F.exp(F.col("_e") - F.max("_e").over(Window.partitionBy("dst"))))
    return met.groupBy(F.col("dst").alias("review_id")).agg(*[(F.sum(F.col("_p") * F.col(f"src_{c}")) / F.sum("_p")).alias(c) for c in columns])


def network_scores(df: DataFrame, columns: list[str], label: str, train: Column, hidden: int = 16, iterations: int = 60, seed: int = 42) -> DataFrame:
    """Adds score: the probability of label 1 by a network with one hidden layer, fitted on training rows. The scaled rows are
    written once, as the fit and the scores both read them.

    Spark's network takes no row weights; unequal classes are met by choosing the threshold on validation rows.
    """
    ready = VectorAssembler(inputCols=columns, outputCol="_x").transform(cut(matrix.scaled(df, columns, train)))
    model = MultilayerPerceptronClassifier(layers=[len(columns), hidden, 2], featuresCol="_x", labelCol=label, probabilityCol="_p", maxIter=iterations, seed=seed).fit(ready.where(train))
    return model.transform(ready).withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")


def own_and_mean(edges: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Per node its own columns beside mean_<c> over all in-neighbours, of whatever type; 0 without any."""
    sent = edges.join(values.select(F.col("review_id").alias("src"), *columns), "src")
    means = sent.groupBy(F.col("dst").alias("review_id")).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    return values.select("review_id", *columns).join(means, "review_id", "left").fillna(0.0, [f"mean_{c}" for c in columns])
