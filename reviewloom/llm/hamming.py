"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import stored

TOP_K = 10
BITS = 64


def sign_code(vector: Column) -> Column:
    """One bit per number of a vector of at most 64: set where it is above zero."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments_for(codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: about log2(codes) bits wide, as the expected bucket then holds one code."""
    n = max(1, min(bits, math.ceil(bits / max(8.0, math.log2(max(2, codes))))))
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segment(code: Column, first: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, F.lit(first)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def balanced(code: str, ones: list[float], parts: int) -> Column:
    """The code of a column with its bits in another order: the most evenly split ones are dealt to the segments in turn.

    ``ones`` is the share of codes that have each bit set. Distances stay as they are; segment values spread wider.
    """
    even = sorted(range(len(ones)), key=lambda i: (abs(ones[i] - 0.5), i))
    to = [i for part in range(parts) for i in even[part::parts]]
    return F.expr(" | ".join(f"shiftleft(shiftrightunsigned({code}, {i}) & 1L, {at})" for at, i in enumerate(to)))


def hamming_top_k(rows: DataFrame, queries: DataFrame, k: int = TOP_K, bits: int = BITS) -> DataFrame:
    """For each query the ``k`` rows of smallest Hamming distance, ties by id; a row is no neighbour of its own id.

    ``rows`` and ``queries`` have id and code (long). Returns query_id, rank, neighbor_id, distance. A null code takes no
    part. With fewer than k other rows all of them are returned. Repeated rows of one id count once.

    Equal codes are searched as one: the index holds each distinct code with its k + 1 smallest ids, so neither a code
    that a third of all rows share nor many equal queries pile up. Each round looks up, in every segment, the values at
    one bit more from the query's; a code is met in one canonical segment only, so candidates need no distinct, and it
    leaves the join only if it is as near as the k-th found so far. A query is done when its k-th distance is below what
    all segments have covered: codes at segment distance above r everywhere differ in at least segments * (r + 1) bits.
    Probes and index are dealt out by segment and value; nothing is broadcast.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = rows.where(F.col("code").isNotNull() & F.col("id").isNotNull()).select("id", "code").distinct()
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = stored(one.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    total, *ones = codes.agg(F.count("*"), *[F.expr(f"avg(shiftrightunsigned(code, {i}) & 1L)") for i in range(bits)]).first()
    parts = segments_for(total, bits)
    spread = lambda c: balanced(c, [x or 0.0 for x in ones], len(parts))
    wanted = queries.where(F.col("code").isNotNull() & F.col("id").isNotNull()).select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    todo = stored(wanted.select(spread("query").alias("query")).distinct().withColumn("bound", F.lit(bits)), "todo")
    split = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), segment(c, a, w).alias("value")) for i, (a, w) in enumerate(parts)]))
    codes = stored(codes.select(spread("code").alias("code"), "ids"), "codes")
    index = codes.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("n"), split(F.col("code")).alias("s")).select("code", "least", "n", "s.seg", "s.value")
    index = stored(index.repartition(tasks, "seg", "value"), "index").repartition(tasks, "seg", "value")
    widths = F.array(*[F.lit(w) for _, w in parts])
    best, done = None, None
    for radius in range(max(w for _, w in parts) + 1):
        probes = todo.select("query", "bound", split(F.col("query")).alias("s")).select("query", "bound", "s.seg", "s.value", F.lit(-1).alias("bit"))
        for _ in range(radius):  # one more bit flipped, of higher place than the last
            up = F.sequence(F.col("bit") + 1, F.get(widths, F.col("seg")) - 1)
            probes = probes.where(F.col("bit") + 1 < F.get(widths, F.col("seg"))).select("query", "bound", "seg", "value", F.explode(up).alias("bit"))
            probes = probes.select("query", "bound", "seg", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("value"), "bit")
        apart = F.col("query").bitwiseXOR(F.col("code"))
        near = F.array(*[F.bit_count(segment(apart, a, w)) for a, w in parts])
        canonical = (F.array_min(near) == radius) & (F.array_position(near, F.array_min(near)) - 1 == F.col("p.seg"))
        dealt = probes.repartition(tasks, "seg", "value").alias("p")
        same = (F.col("p.seg") == F.col("i.seg")) & (F.col("p.value") == F.col("i.value"))
        met = dealt.join(index.alias("i").hint("merge"), same & (F.bit_count(apart) <= F.col("bound")) & canonical).select("query", "code", "least", "n", F.bit_count(apart).cast("int").alias("distance"))
        if best is not None:
            met = met.unionByName(best.join(todo, "query", "left_semi"))
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "least"))
        best = stored(met.withColumn("nth", place).where(F.col("nth") <= k + 1).drop("nth"), "best")
        # Of the ids of the codes met, the query's own may be one: the k + 1-th id gives the bound.
        within = F.sum("n").over(Window.partitionBy("query").orderBy("distance"))
        bounds = best.withColumn("within", within).where(F.col("within") >= k + 1).groupBy("query").agg(F.min("distance").alias("found"))
        covered = len(parts) * (radius + 1) - 1
        todo = stored(todo.join(bounds, "query", "left").select("query", F.coalesce("found", "bound").alias("bound")), "todo")
        over = todo.where(F.col("bound") <= covered) if covered < bits else todo
        got = best.join(over, "query", "left_semi")
        done = got if done is None else done.unionByName(got)
        todo = todo.where(F.col("bound") > covered)
        if covered >= bits or todo.isEmpty():
            break
    each = done.select("query", "distance", "code").join(codes, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))).where(F.col("nth") <= k + 1).drop("nth")
    per = wanted.withColumn("query", spread("query")).join(each, "query").where(F.col("query_id") != F.col("neighbor_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return per.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
