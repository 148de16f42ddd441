"""Fitted transformers that Spark ML's persistence writes and reads: scales, text vectors, relation networks."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import finite
from reviewloom.operators import latent, matrix, network


class _Writer(MLWriter):
    """Parameters as Spark ML's metadata, and the fitted values as one Parquet table beside them."""

    def __init__(self, instance: _Fitted) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        self.instance.values(spark).coalesce(1).write.parquet(f"{path}/data")  # as large as a vocabulary or a set of weights


class _Reader(MLReader):
    def __init__(self, kind: type[_Fitted]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _Fitted:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        found = self.kind.of_values(spark.read.parquet(f"{path}/data"))
        found._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(found, metadata)
        return found


class _Fitted(Model, MLReadable, MLWritable):
    """A model whose fitted values are a small table: ``values`` gives it, ``of_values`` makes the model of it."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _ScaleParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale in place", TypeConverters.toListString)
    trainCol = Param(Params._dummy(), "trainCol", "boolean column that marks the rows to learn on", TypeConverters.toString)


class Scale(Estimator, _ScaleParams):
    """Learns mean and population deviation of columns on training rows; a deviation under 1e-12 counts as 1."""

    def __init__(self, columns: list[str], train: str) -> None:
        super().__init__()
        self._set(inputCols=columns, trainCol=train)

    def _fit(self, df: DataFrame) -> ScaleModel:
        columns, train = self.getOrDefault("inputCols"), F.col(self.getOrDefault("trainCol"))
        clean = {c: F.when(train, finite(F.col(c).cast("double"))) for c in columns}
        one = df.agg(*[F.avg(x).alias(f"m_{c}") for c, x in clean.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in clean.items()]).first()
        none = lambda x, other: other if x is None else x
        model = ScaleModel({c: (none(one[f"m_{c}"], 0.0), 1.0 if none(one[f"s_{c}"], 0.0) < 1e-12 else one[f"s_{c}"]) for c in columns})
        return self._copyValues(model)


class ScaleModel(_Fitted, _ScaleParams):
    def __init__(self, scales: dict[str, tuple[float, float]] | None = None) -> None:
        super().__init__()
        self.scales = scales or {}

    def values(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, c, float(m), float(s)) for i, (c, (m, s)) in enumerate(self.scales.items())], "pos int, column string, mean double, std double")

    @classmethod
    def of_values(cls, values: DataFrame) -> ScaleModel:
        return cls({r["column"]: (r["mean"], r["std"]) for r in values.orderBy("pos").collect()})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: finite((finite(F.col(c).cast("double")) - m) / s) for c, (m, s) in self.scales.items()})


class _TextParams(Params):
    idCol = Param(Params._dummy(), "idCol", "column that identifies a text", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "column of texts", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "dimensions", TypeConverters.toInt)
    share = Param(Params._dummy(), "share", "part of the training sum of squares that the dimensions hold", TypeConverters.toFloat)


class TextVectorsModel(_Fitted, _TextParams):
    """TF-IDF weights on a learned vocabulary, turned into coordinates on the learned dimensions: (id, vector)."""

    def __init__(self, basis: latent.Basis | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        super().__init__()
        self.basis = basis
        self._setDefault(idCol="doc_id", textCol="text", k=0, share=0.0)
        self._set(idCol=id_col, textCol=text_col)
        if basis is not None:
            self._set(k=len(basis.values), share=basis.share)

    def values(self, spark: SparkSession) -> DataFrame:
        b = self.basis
        rows = [(i, t, float(b.idf[i]), b.vectors[i].tolist()) for i, t in enumerate(b.terms)] + [(-1, None, None, b.values.tolist())]
        return spark.createDataFrame(rows, "at int, term string, idf double, vector array<double>")

    @classmethod
    def of_values(cls, values: DataFrame) -> TextVectorsModel:
        rows = values.orderBy("at").collect()
        terms = [r for r in rows if r["at"] >= 0]
        return cls(latent.Basis([r["term"] for r in terms], np.array([r["idf"] for r in terms]), np.array(rows[0]["vector"]), np.array([r["vector"] for r in terms]), 0.0))

    def weights(self, df: DataFrame) -> DataFrame:
        """(id, term, weight)."""
        return matrix.weighted(df, self.basis.terms, self.basis.idf, self.getOrDefault("idCol"), self.getOrDefault("textCol"))

    def _transform(self, df: DataFrame) -> DataFrame:
        id_col = self.getOrDefault("idCol")
        return latent.projected(matrix.weight_rows(df, self.basis.terms, self.basis.idf, id_col, self.getOrDefault("textCol")), self.basis.vectors, id_col)


class _NetworkParams(Params):
    sizes = Param(Params._dummy(), "sizes", "inputs, relations, hidden units, layers", TypeConverters.toListInt)
    mix = Param(Params._dummy(), "mix", "whether the weights of relations are learned", TypeConverters.toBoolean)
    own = Param(Params._dummy(), "own", "whether there is a branch on own columns", TypeConverters.toBoolean)


class NetworkModel(_Fitted, _NetworkParams):
    """The best weights of a fit. ``transform`` scores nodes (review_id, split, y, share, x) by the edges it is given."""

    def __init__(self, weights: network.Weights | None = None, of: network.RelationNetwork | None = None) -> None:
        super().__init__()
        self.weights = weights or {}
        self.edges: DataFrame | None = None
        if of is not None:
            self._set(sizes=[of.inputs, of.relations, of.hidden, of.layers], mix=of.learned_mix, own=of.own_branch)

    def values(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, list(v.shape), np.ravel(v).tolist()) for k, v in self.weights.items()], "name string, shape array<int>, numbers array<double>")

    @classmethod
    def of_values(cls, values: DataFrame) -> NetworkModel:
        return cls({r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in values.collect()})

    def over(self, edges: DataFrame) -> NetworkModel:
        self.edges = edges
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        inputs, relations, hidden, layers = self.getOrDefault("sizes")
        model = network.RelationNetwork(inputs, relations, hidden, layers, learned_mix=self.getOrDefault("mix"), own_branch=self.getOrDefault("own"))
        model.prepare(df, self.edges)
        return model.scores(self.weights)
