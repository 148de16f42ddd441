"""Model inputs: cutoffs and scales learned on training rows only, class weights, TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions import finite

#: Words of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def scaled(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less the training mean, over the training population deviation (1 where that is under 1e-12)."""
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in columns})
    of = [g(F.when(train, F.col(c))).alias(f"_{n}_{c}") for c in columns for n, g in (("m", F.avg), ("s", F.stddev_pop))]
    one = clean.agg(*of)  # one row, whatever the input
    spread = lambda c: F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))
    z = {c: finite((F.col(c) - F.col(f"_m_{c}")) / spread(c)) for c in columns}
    return clean.crossJoin(F.broadcast(one)).withColumns(z).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def class_weights(df: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """Per class: n, inverse frequency n_all / (2 n), and (1 - beta) / (1 - beta ** n) over its mean."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over one row per class
    raw = counts.withColumn("_w", (1 - beta) / F.greatest(1 - F.pow(F.lit(beta), F.col("n")), F.lit(1e-12)))
    return raw.select("label", "n", (F.sum("n").over(whole) / (2 * F.col("n"))).alias("inverse_weight"), (F.col("_w") / F.avg("_w").over(whole)).alias("balanced_weight"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf): the one- and two-word terms of each text and their counts, as two arrays; a text without one has no row.

    A text's terms are sorted and counted inside its row, so nothing is dealt out. Only where an id has several rows are
    terms brought together by id.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN), 0)
    tokens = docs.select(F.col(id_col), F.explode(F.array(words)).alias("w")).where(F.size("w") > 0)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    # As the output of a generator an array is made once, not once for each element of a lambda.
    ordered = tokens.select(id_col, F.explode(F.array(F.sort_array(F.concat("w", pairs)))).alias("s"))
    ends = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == F.size("s")) | (F.get("s", i - 1) != F.get("s", i)))
    ended = ordered.select(id_col, "s", F.explode(F.array(ends)).alias("e"))
    own = ended.select(id_col, F.transform("e", lambda i: F.get("s", i - 1)).alias("term"), F.transform("e", lambda i, j: (i - F.when(j > 0, F.get("e", j - 1)).otherwise(0)).cast("long")).alias("tf"))
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return own
    each = own.select(id_col, F.explode(F.arrays_zip("term", "tf")).alias("x")).groupBy(id_col, "x.term").agg(F.sum("x.tf").alias("tf"))
    return each.groupBy(id_col).agg(F.collect_list(F.struct("term", "tf")).alias("x")).select(id_col, "x.term", "x.tf")


def vocabulary(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 2, max_df: float = 0.95, max_features: int = 50_000) -> DataFrame:
    """(term, idf): terms in ``min_df`` training documents at least and a share of ``max_df`` at most, the
    ``max_features`` most frequent, then by code point; idf is ln((1 + n) / (1 + df)) + 1. The bound makes it safe to broadcast."""
    return known_terms(docs.join(train.select(id_col).distinct(), id_col, "left_semi"), id_col, text_col, min_df, max_df, max_features)


def known_terms(fit: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 2, max_df: float = 0.95, max_features: int = 50_000) -> DataFrame:
    """``vocabulary`` of the training documents themselves."""
    n = fit.agg(F.count_distinct(id_col).alias("_n"))
    each = counted(fit, id_col, text_col).select(F.explode(F.arrays_zip("term", "tf")).alias("x")).select("x.term", "x.tf")
    known = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n))
    known = known.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_n"))).orderBy(F.desc("total"), "term").limit(max_features)
    return known.select("term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weight_rows(docs: DataFrame, known: list[str], idf: Iterable[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, weight): each document's terms by their place in a vocabulary learned before, in order, and their weights
    at length 1, as arrays. Documents without a known term have no row. The vocabulary, which is bounded, goes to the
    texts, so nothing is dealt out."""
    shared = docs.sparkSession.sparkContext.broadcast((list(known), np.array(list(idf), float)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rise = pa.array(shared.value[0], pa.string()), shared.value[1]
        for b in batches:
            at = pc.fill_null(pc.index_in(b.column("term").flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            row, there = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("term")).to_numpy()), at >= 0
            at, row, tf = at[there], row[there], b.column("tf").flatten().to_numpy()[there]
            w = tf * rise[at]
            order, sizes = np.lexsort((at, row)), np.bincount(row, minlength=b.num_rows)
            w = (w / np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))[row])[order]
            ends = pa.array(np.append(0, sizes[sizes > 0].cumsum()), pa.int32())
            columns = [b.column(id_col).filter(pa.array(sizes > 0)), pa.ListArray.from_arrays(ends, pa.array(at[order], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "at", "weight"])

    return counted(docs, id_col, text_col).mapInArrow(look, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, at array<int>, weight array<double>")


def weighted(docs: DataFrame, known: list[str], idf: Iterable[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, weight) with a vocabulary learned before."""
    places = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(known)], "at int, term string")
    each = weight_rows(docs, known, idf, id_col, text_col).select(id_col, F.explode(F.arrays_zip("at", "weight")).alias("x")).select(id_col, "x.at", "x.weight")
    return each.join(F.broadcast(places), "at").select(id_col, "term", "weight")


def tfidf(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 2, max_df: float = 0.95, max_features: int = 50_000) -> DataFrame:
    """(id, term, weight): term counts times the idf of ``vocabulary``, each document at length 1."""
    known = vocabulary(docs, train, id_col, text_col, min_df, max_df, max_features).collect()
    return weighted(docs, [r["term"] for r in known], [r["idf"] for r in known], id_col, text_col)
