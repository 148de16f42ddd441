"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import line_dedup, minhash, mixing, packing, quality
from reviewloom.llm.common import discard, stored, table
from reviewloom.llm.queries import vocabulary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stood before in the corpus go; their documents stay."""
    return line_dedup.line_chunk_dedup(docs).drop("_n_lines", "_n_removed")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.distinct_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken as often as the mix of sources has it."""
    return mixing.mixed_documents(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality rules", rules), ("line dedup", lines), ("near dedup", near), ("mix", mix), ("pack", windows)]

#: A forest and a tokenizer stand in the way of SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i + 1}")
            if before is not None:
                discard(before)
            before = docs
    return docs
