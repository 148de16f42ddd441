"""Queries of sources, sinks, checks of inputs and governance tables: each writes what it reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.operators import checks, edges, units
from reviewloom.plans.base import FEATURES_SQL, features, register, rounded, texts
from reviewloom.plans.edges import _LAST, _PRIOR, _TYPED, typed_edges
from reviewloom.plans.reviews import _SAMPLED, _SPLIT, _sampled
from reviewloom.sources import CSV, read_json, read_reviews, replace_summary, reviews, scratch, standardize, table, write_csv, write_summary, write_table

_F = f"WITH {FEATURES_SQL}"


def _raw(s, d):
    """Reviews as a raw file has them, with texts of several lines and quotes."""
    r = reviews(s, d).join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return r.select("review_id", "user_id", "prod_id", F.col("rating").cast("double").alias("rating"), F.col("label").cast("int").alias("label"), F.col("date").cast("string").alias("date"), "text", F.concat(F.lit('tag "'), F.col("rating"), F.lit('", x')).alias("tag"))


def _csv(s, d) -> DataFrame:
    path = scratch(s, "reviews")
    write_csv(_raw(s, d), path)
    return read_reviews(s, path)


def _kept(s, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    path = scratch(s, name)
    write_table(df, path, by)
    return s.read.parquet(path)


def _rows(parts: dict[str, DataFrame]) -> DataFrame:
    """How many rows each written table gives back."""
    out = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in parts.items()]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def _nodes(s, d):
    return standardize(reviews(s, d))


_RAW_SQL = _F + ", w AS (SELECT r.*, documents.text AS txt FROM r JOIN documents USING (doc_id))"

# Sources.
register("src01", lambda s, d: rounded(_csv(s, d).select("review_id", "user_id", "prod_id", "rating")), _RAW_SQL + " SELECT review_id, user_id, prod_id, CAST(rating AS DOUBLE) AS rating FROM w")
register("src02", lambda s, d: _csv(s, d).select("review_id", F.length("text").cast("long").alias("char_len"), "tag"), _RAW_SQL + " SELECT review_id, length(txt) AS char_len, 'tag \"' || rating || '\", x' AS tag FROM w")


def _header(s, d):
    path = scratch(s, "header")
    write_csv(table(s, d, "documents"), path)
    return s.createDataFrame([(c,) for c in s.read.csv(path, header=True).columns], "column_name string")


register("src03", _header, "SELECT column_name FROM (DESCRIBE documents)")
register("src04", lambda s, d: standardize(_csv(s, d)).select("review_id", "date", "is_fake"), _RAW_SQL + " SELECT review_id, date, CAST(is_fake AS BIGINT) AS is_fake FROM w")


def _aligned(s, d):
    nodes, own = _kept(s, reviews(s, d).select("review_id", "doc_id"), "mapping"), _kept(s, table(s, d, "documents").select("doc_id", "text"), "texts")
    return nodes.join(own, "doc_id", "left").agg(F.count("*").alias("rows"), F.count_if(F.col("text").isNull()).alias("without_text"))


register("src05", _aligned, _F + " SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS without_text FROM r LEFT JOIN documents USING (doc_id)")
register(
    "src06",
    lambda s, d: rounded(_kept(s, table(s, d, "embeddings"), "vectors").select("vec_id", F.size("embedding").alias("width"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("square"))),
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS square FROM embeddings",
)


def _inputs(s, d):
    """Nodes with text features, split and number of outgoing edges, from four written tables."""
    nodes = _kept(s, _nodes(s, d).select("review_id", "doc_id"), "nodes")
    words = _kept(s, texts(s, d).select("doc_id", "word_len"), "words")
    split = _kept(s, units.temporal_split(_nodes(s, d)).select("review_id", "split"), "split")
    out = _kept(s, edges.last_k(_nodes(s, d), "user_id", 5), "edges").groupBy(F.col("src").alias("review_id")).agg(F.count("*").alias("out_degree"))
    return rounded(nodes.join(words, "doc_id").join(split, "review_id").join(out, "review_id", "left").select("review_id", "word_len", "split", F.coalesce("out_degree", F.lit(0)).alias("out_degree")))


_CUTS = ", pm AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM r)"
register("src07", _inputs, _LAST + _CUTS + f" SELECT pm.review_id, word_len, {_SPLIT} AS split, (SELECT count(*) FROM ed02 WHERE src = pm.review_id) AS out_degree FROM pm JOIN t USING (doc_id)")


def _planned(s, d):
    parts = edges.prior_context(features(s, d), 5)
    return _kept(s, parts.unionByName(parts), "plan").distinct()


register("src09", _planned, _F + _PRIOR + " SELECT DISTINCT src, dst FROM ed05")
_SUMMARY_SQL = " SELECT count(*) AS reviews, CAST(sum(is_fake) AS BIGINT) AS fake, CAST(max(date) AS VARCHAR) AS last_date FROM r"


def _summary(s, d):
    path = scratch(s, "summary")
    write_summary(_nodes(s, d).agg(F.struct(F.count("*").alias("reviews"), F.sum("is_fake").alias("fake"), F.max("date").cast("string").alias("last_date")).alias("data")), path)
    return read_json(s, path).select("data.reviews", "data.fake", "data.last_date")


register("src10", _summary, _F + _SUMMARY_SQL)
register("snk16", lambda s, d: _summary(s, d).select("reviews", "last_date"), _F + " SELECT reviews, last_date FROM (" + _SUMMARY_SQL + ")")


def _graph(s, d):
    nodes, links = _kept(s, _nodes(s, d).select("review_id"), "nodes"), _kept(s, typed_edges(s, d), "edges", ["edge_type"])
    ends = links.select(F.explode(F.array("src", "dst")).alias("review_id")).join(nodes, "review_id", "left_anti")
    return _rows({"nodes": nodes, "edges": links, "unknown_ends": ends})


_GRAPH_SQL = _TYPED + " SELECT 'nodes' AS name, count(*) AS rows FROM r UNION ALL SELECT 'edges', count(*) FROM te"
register("src11", _graph, _GRAPH_SQL + " UNION ALL SELECT 'unknown_ends', count(*) FROM (SELECT unnest([src, dst]) AS e FROM te) WHERE e NOT IN (SELECT review_id FROM r)")


def _predictions(s, d):
    path = scratch(s, "predictions")
    write_csv(_nodes(s, d).select("review_id", (F.col("rating") / 10).alias("score"), F.col("is_fake").alias("label")), path)
    return s.read.schema("review_id long, score double, label long").csv(path, header=True).where("score >= 0.3")


register("src12", _predictions, _F + " SELECT review_id, rating / 10 AS score, CAST(is_fake AS BIGINT) AS label FROM r WHERE rating / 10 >= 0.3")


def _masks(s, d):
    split = _kept(s, units.temporal_split(_nodes(s, d)).select("review_id", "split"), "split")
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("review_id").alias("reviews"))


_MASKS_SQL = _F + _CUTS + f" SELECT {_SPLIT} AS split, count(*) AS rows, count(DISTINCT review_id) AS reviews FROM pm GROUP BY 1"
register("src13", _masks, _MASKS_SQL)

# Sinks.
register("snk01", lambda s, d: rounded(_csv(s, d).select("review_id", "rating", "label", "date", F.md5("text").alias("text_md5"))), _RAW_SQL + " SELECT review_id, CAST(rating AS DOUBLE) AS rating, CAST(CASE WHEN is_fake = 1 THEN -1 ELSE 1 END AS BIGINT) AS label, CAST(date AS VARCHAR) AS date, md5(txt) AS text_md5 FROM w")


def _sampled_tables(s, d):
    """Three tables of a sampling, written and read together: each node with its unit's and text's rows found again."""
    f = _kept(s, _sampled(s, d).select("review_id", "user_id", "prod_id", "week", "doc_id"), "sampled")
    parts = _kept(s, f.groupBy("prod_id", "week").agg(F.count("*").alias("unit_rows")), "units"), _kept(s, texts(s, d).join(f.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text_hash"), "texts")
    return f.join(parts[0], ["prod_id", "week"], "left").join(parts[1], "doc_id", "left").select("review_id", "prod_id", "week", "unit_rows", "text_hash")


register("snk02", _sampled_tables, _SAMPLED + " SELECT review_id, prod_id, week, count(*) OVER (PARTITION BY prod_id, week) AS unit_rows, text_hash FROM n")
register(
    "snk03",
    lambda s, d: _kept(s, table(s, d, "embeddings").join(_sampled(s, d).select("vec_id"), "vec_id", "left_semi").select("vec_id", "label"), "vectors"),
    _SAMPLED + " SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM n)",
)
register("snk04", lambda s, d: _kept(s, typed_edges(s, d), "edges", ["edge_type"]).where("edge_type = 1").select("src", "dst"), _TYPED + " SELECT src, dst FROM te WHERE edge_type = 1")


def _no_edges(s, d):
    """An edge table without a row keeps its columns: joined to the nodes read back, it gives each a degree of 0."""
    empty = s.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in ("src", "dst", "edge_type")]))
    nodes, links = _kept(s, _nodes(s, d).select("review_id", "is_fake"), "nodes"), _kept(s, empty, "edges")
    degree = links.groupBy(F.col("dst").alias("review_id")).agg(F.count("edge_type").alias("degree"))
    return nodes.join(degree, "review_id", "left").select("review_id", "is_fake", F.coalesce("degree", F.lit(0)).alias("degree"))


register("snk05", _no_edges, _F + " SELECT review_id, CAST(is_fake AS BIGINT) AS is_fake, CAST(0 AS BIGINT) AS degree FROM r")


def _graph_tables(s, d):
    f = features(s, d).select("review_id", "rating_norm", "log_word_len")
    scaler = f.agg(F.avg("rating_norm").alias("mean"), F.stddev_pop("rating_norm").alias("std"))
    return rounded(_kept(s, f, "nodes").crossJoin(F.broadcast(_kept(s, scaler, "scaler"))).select("review_id", ((F.col("rating_norm") - F.col("mean")) / F.col("std")).alias("scaled")))


register("snk06", _graph_tables, _F + " SELECT review_id, round((rating_norm - (SELECT avg(rating_norm) FROM f)) / (SELECT stddev_pop(rating_norm) FROM f), 6) AS scaled FROM f")


def _texts_csv(s, d):
    path = scratch(s, "texts")
    write_csv(table(s, d, "documents").where("text <> ''").select("doc_id", "text", "source"), path, "none")
    return s.read.schema("doc_id long, text string, source string").csv(path, header=True, **CSV).select("doc_id", F.md5("text").alias("text_md5"), "source")


register("snk10", _texts_csv, "SELECT doc_id, md5(text) AS text_md5, source FROM documents WHERE text <> ''")
register("snk14", lambda s, d: _kept(s, units.temporal_split(_nodes(s, d)).select("review_id", "split"), "split"), _F + _CUTS + f" SELECT review_id, {_SPLIT} AS split FROM pm")


def _updated(s, d):
    """The one row of a summary with a new figure, in the place of the old one."""
    path = scratch(s, "active")
    write_summary(_nodes(s, d).agg(F.count("*").alias("reviews"), F.lit(0.5).alias("threshold"), F.avg("is_fake").alias("fake_rate")), path)
    replace_summary(s.read.json(path).withColumn("threshold", F.lit(0.794)), path)
    return rounded(s.read.json(path))


register("snk18", _updated, _F + " SELECT count(*) AS reviews, CAST(0.794 AS DOUBLE) AS threshold, round(avg(is_fake), 6) AS fake_rate FROM r")

# Checks of inputs.
register("val02", lambda s, d: checks.input_violations(_broken_nodes(s, d), ["review_id", "user_id", "date", "missing"], _nodes(s, d).count()), _F + ", vb AS (SELECT review_id, CASE WHEN review_id % 9 <> 4 THEN date END AS date FROM r WHERE review_id % 11 <> 0) SELECT CAST(1 AS BIGINT) AS missing_columns, count(*) FILTER (date IS NULL) AS null_dates, (SELECT count(*) FROM r) - count(*) AS rows_short FROM vb")


def _broken_nodes(s, d):
    return _nodes(s, d).where("review_id % 11 <> 0").withColumn("date", F.when(F.col("review_id") % 9 != 4, F.col("date")))


register(
    "val05",
    lambda s, d: checks.graph_violations(features(s, d).select("review_id", F.when(F.col("review_id") % 6 != 1, F.col("rating_norm")).alias("x"), F.when(F.col("rating") > 1, F.col("is_fake")).otherwise(F.lit(5)).alias("label")), edges.last_k(_nodes(s, d), "user_id", 5).withColumn("dst", F.when(F.col("dst") % 8 == 0, -F.col("dst")).otherwise(F.col("dst")))),
    _LAST + " SELECT count(*) FILTER (review_id % 6 = 1) AS null_features, count(*) FILTER (rating = 1) AS bad_labels, (SELECT count(*) FROM ed02 WHERE dst % 8 = 0 AND -dst NOT IN (SELECT review_id FROM r)) AS unknown_ends FROM r",
)
# Governance.
register("gv09", lambda s, d: rounded(checks.compared(_expected(s, d), _measured(s, d), 1e-6)), _F + ", m AS (SELECT 'fake_rate_' || rating AS name, avg(is_fake) AS actual, rating FROM f GROUP BY ALL), e AS (SELECT 'fake_rate_' || rating AS name, sum(is_fake) / count(*) + CASE WHEN rating = 2 THEN 0.1 ELSE 0 END AS expected FROM r GROUP BY rating UNION ALL SELECT 'absent', 1.0) SELECT name, round(expected, 6) AS expected, round(actual, 6) AS actual, coalesce(abs(expected - actual) <= 1e-6, false) AS ok FROM e LEFT JOIN m USING (name)")


def _measured(s, d):
    return features(s, d).groupBy(F.concat(F.lit("fake_rate_"), F.col("rating").cast("string")).alias("name")).agg(F.avg("is_fake").alias("actual"))


def _expected(s, d):
    """Rates of the raw rows, one of them wrong and one name that nothing measures."""
    raw = _nodes(s, d).groupBy("rating").agg((F.sum("is_fake") / F.count("*")).alias("rate"))
    raw = raw.select(F.concat(F.lit("fake_rate_"), F.col("rating").cast("string")).alias("name"), (F.col("rate") + F.when(F.col("rating") == 2, 0.1).otherwise(0.0)).alias("expected"))
    return raw.unionByName(s.createDataFrame([("absent", 1.0)], "name string, expected double"))
