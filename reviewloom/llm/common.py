"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that one Arrow batch may hold; keeps a batch of long documents small.
ARROW_ROWS = 1000
#: ASCII white space, U+0020 and U+0009 to U+000D, as a Java and RE2 character class for words.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    conf = spark.sparkContext.getConf()
    if there := conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not hasattr(shared_dir, "own"):
            shared_dir.own = tempfile.mkdtemp(prefix="reviewloom-")
        return f"file://{shared_dir.own}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread, never a recomputation with other partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that reads them has itself been stored."""
    for df in tables:
        if files := df.inputFiles():
            remove_folder(df.sparkSession, files[0].rpartition("/")[0])


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder if it lies in the shared one."""
    path, top = spark._jvm.org.apache.hadoop.fs.Path(folder), shared_dir(spark)
    if folder.split(":", 1)[-1].lstrip("/").startswith(top.split(":", 1)[-1].lstrip("/")):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
