"""Sources and sinks: reviews over the driver's tables, files of reviews, and the tables each stage writes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw reviews as a file has them.
RAW_SCHEMA = T.StructType([T.StructField("review_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("prod_id", T.LongType()), T.StructField("rating", T.DoubleType()), T.StructField("label", T.IntegerType()), T.StructField("date", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tag", T.StringType())])
REQUIRED = ["review_id", "user_id", "prod_id", "rating", "label", "date"]
#: How texts are read from CSV: quoted line breaks, quotes doubled. By default Spark takes a quoted empty text for a null, since
#: both equal its mark of nulls; with a mark that no text is (a noncharacter of Unicode) only a cell without quotes is one.
CSV = {"multiLine": True, "escape": '"', "nullValue": "\ufdd0"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of a CSV file or folder, plain or gzip; a fixed schema, quoted line breaks, no inference."""
    return spark.read.schema(RAW_SCHEMA).csv(path, header=True, **CSV)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as reviews: one row per event, with doc_id and vec_id of its text and vector.

    The two counts come from file footers; they are the only values fetched before the plan is made.
    """
    docs, vectors = table(spark, sf_dir, "documents").count(), table(spark, sf_dir, "embeddings").count()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("review_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("prod_id"),
        F.to_date("ts").alias("date"),
        (1 + F.round(F.col("value") * 100).cast("long") % 5).cast("long").alias("rating"),
        F.when(F.col("event_type") == "error", -1).otherwise(1).alias("label"),
        (F.col("event_id") % docs).alias("doc_id"),
        (F.col("event_id") % vectors).alias("vec_id"),
    )


def standardize(raw: DataFrame) -> DataFrame:
    """Typed reviews: label -1 is fake, 1 real, else null; unparsable dates and rows without a required field go."""
    # A date is not written out and parsed again, which took most of a scan's time.
    date = F.col("date") if isinstance(raw.schema["date"].dataType, T.DateType) else F.try_to_timestamp(F.col("date").cast("string")).cast("date")
    typed = raw.withColumn("date", date).dropna(subset=REQUIRED)
    return typed.withColumn("is_fake", F.when(F.col("label") == -1, 1).when(F.col("label") == 1, 0).cast("long")).drop("label")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the session's checkpoint folder: for frames that a plan would otherwise hold many times.

    They are a Parquet table, which is some times smaller than Spark's own checkpoint of rows and is read by column. The folder is the one ``spark.checkpoint.dir`` names. Where it is unset, a local session gets its own; a cluster has
    no folder that all of its machines share, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local one only where the session is local and names none."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if there is None and spark.sparkContext.master.startswith("local"):
        there = f"file://{tempfile.gettempdir()}"
    return f"{there or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


class Workspace:
    """Tables written once in the shared folder and read back, for steps that build on one another: a plan that starts at
    a file neither grows with the steps before nor is computed again when an executor is lost. ``clear`` deletes them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.tables = spark, scratch(spark, name), 0
        self.named: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_buckets(self, df: DataFrame, buckets: int, column: str) -> DataFrame:
        """A table whose rows stay where ``repartition(buckets, column)`` deals others out to, so a grouping beside these moves
        none of it."""
        self.named.append(f"kept_{uuid.uuid4().hex}")
        df.write.bucketBy(buckets, column).option("path", f"{self.path}/{self.named[-1]}").saveAsTable(self.named[-1], format="parquet")
        return self.spark.table(self.named[-1])

    def clear(self) -> None:
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.named = []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer referred to. It does so when the driver collects
    garbage, which may not happen for many rounds of a loop whose rows are on executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Blanks and line breaks at the ends of texts, which Spark's writer drops by default, stay."""
    df.write.mode("overwrite").csv(path, header=True, compression=compression, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row nested summary as JSON."""
    df.write.mode("overwrite").json(path)


def replace_summary(df: DataFrame, path: str) -> None:
    """Put a new summary in the place of the one at ``path``, of which it may be made: the new one is written whole beside
    it, and then two renames exchange them, so a reader finds either the old or the new one."""
    spark = df.sparkSession
    write_summary(df, f"{path}.new")
    of = lambda end: spark._jvm.org.apache.hadoop.fs.Path(path + end)
    files = of("").getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(of(".old"), True)
    for start, end in (("", ".old"), (".new", "")):
        if not files.rename(of(start), of(end)):
            raise OSError(f"{path}{start} could not be moved")
    files.delete(of(".old"), True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file under a path; contents stay on the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
