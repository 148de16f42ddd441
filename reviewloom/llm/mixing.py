"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import stored, word_count

#: Source weights, repeated over the sources in code point order.
WEIGHTS = (5, 2, 1)
#: No source's target and no document's copies exceed this many times their size.
MOST = 3
#: Rows of a source and size class that one task numbers.
BLOCK_ROWS = 50_000
SEED = "mix-1"


def md5_fraction(text: Column) -> Column:
    """A number in [0, 1) from 32 bits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def size_class(size: Column) -> Column:
    """Sixteen classes per doubling of the size, so that every stretch of the order holds documents of like size."""
    up = size + 1
    bits = F.length(F.bin(up))
    return (bits * 16 + F.call_function("shiftright", up * 32, bits) % 16).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): target and expected copies (rate) of each source.

    Targets share the whole size by weight; a source whose share passes MOST times its size stops there and the rest
    is shared again. The level at which that ends is found in closed form: with sources in order of the level at
    which they stop, a source is stopped when the level left to it, after all before it were stopped, is above its own.
    One row per source; the window over them holds no documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (kind + 1).cast("int"))
    caps = sizes.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * MOST).cast("double").alias("cap"))
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    steps = caps.select(
        "*",
        (F.sum("cap").over(whole) / MOST - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left_size"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left_weight"),
    ).withColumn("level", F.col("left_size") / F.col("left_weight"))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(whole)["level"]
    target = F.when(free, level * F.col("weight")).otherwise(F.col("cap"))
    return steps.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _name(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))  # a null source gets a name of its own


def _row_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.md5(text), F.lit(""))


def systematic_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Take each document 0 to 3 times so that every source's words come near its target.

    Within a source, documents stand in order of size class, then block, then id; the expected copies are summed along
    that order, one random offset per source (from ``seed``) is added, and a document is taken once for each whole
    number that its own share crosses. Returns doc_id, row_key, print (a hash of the text), size,
    source_size, target, copies, taken.

    A null source is a source of its own; null or wordless texts have size 0 and take no words; a source without words
    has target 0 and no copies. Repeated rows count one by one. The texts are read once and never shuffled. The prefix
    sum is distributed: counts per source, size class and block are summed, and rows are numbered inside their block
    only, so no source sits in one task.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), _row_key(F.col(id_col), text).alias("row_key"), F.xxhash64(text).alias("print"))
    lean = stored(rows.select("doc_id", "row_key", "print", "source", "size", size_class(F.col("size")).alias("class")), "mix")
    classes = lean.groupBy("source", "class").agg(F.count("*").alias("class_rows"), F.sum("size").alias("class_size"))
    blocks = max(1, math.ceil((classes.agg(F.max("class_rows")).first()[0] or 0) / BLOCK_ROWS))
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")))
    placed = lean.select("doc_id", "row_key", "print", "size", "class", _name(F.col("source")).alias("name"), F.floor(md5_fraction(F.col("row_key")) * blocks).cast("long").alias("block"))
    counts = placed.groupBy("name", "class", "block").agg(F.count("*").alias("rows_here"))
    before = F.sum("rows_here").over(Window.partitionBy("name").orderBy("class", "block")) - F.col("rows_here")
    targets = targets.select(_name(F.col("source")).alias("name"), "source_size", "target", "rate")
    first = counts.select("name", "class", "block", before.alias("before")).join(targets, "name")
    offset = md5_fraction(F.concat(F.lit(f"{seed}|"), F.col("name")))
    rank = F.row_number().over(Window.partitionBy("name", "class", "block").orderBy("row_key", "size", "print"))
    upto = lambda r: F.floor(r * F.col("rate") + offset).cast("long")
    copies = upto(F.col("before") + F.col("rank")) - upto(F.col("before") + F.col("rank") - 1)
    return (
        placed.withColumn("rank", rank)
        .join(first, ["name", "class", "block"])
        .select("doc_id", "row_key", "print", "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix, all input columns, each row as often as ``systematic_mix`` takes it.

    Null and wordless texts add nothing to any source and are left out. Rows that share an id and a text (or, without an
    id, a text) share their copies out one by one. One shuffle of the texts, by id and text hash.
    """
    taken = systematic_mix(docs, id_col, text_col, source_col, seed).where("taken > 0").groupBy("row_key", "print", "copies").agg(F.count("*").alias("rows"))
    # Copies are 0 to MOST, so a key has a few entries however many rows share it.
    taken = taken.groupBy("row_key", "print").agg(F.sort_array(F.collect_list(F.struct("copies", "rows")), False).alias("shares"))
    keyed = docs.select(F.struct("*").alias("row"), _row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.xxhash64(F.col(text_col)).alias("print"))
    nth = F.row_number().over(Window.partitionBy("row_key", "print").orderBy(F.xxhash64("row")))
    joined = keyed.join(taken, ["row_key", "print"]).withColumn("nth", nth)
    # The rows before an entry's own are those of the entries with more copies.
    step = lambda s, x: F.struct((s["left"] - x["rows"]).alias("left"), F.when((s["left"] > 0) & (s["left"] <= x["rows"]), x["copies"]).otherwise(s["copies"]).alias("copies"))
    start = F.struct(F.col("nth").cast("long").alias("left"), F.lit(0).cast("long").alias("copies"))
    joined = joined.withColumn("copies", F.aggregate("shares", start, step)["copies"])
    return joined.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
