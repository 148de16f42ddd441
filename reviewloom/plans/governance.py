"""Queries of governance: registry and re-check of written files, model card, manifest, policies and logs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import checks, edges, stats, units
from reviewloom.plans.base import register, rounded
from reviewloom.plans.edges import _F, _TYPED, typed_edges
from reviewloom.plans.models import _PARTS
from reviewloom.plans.reviews import _SPLIT
from reviewloom.plans.scores import _S, _SCORE, _scored
from reviewloom.sources import cut, file_digests, reviews, scratch, standardize, table, write_csv, write_summary

THRESHOLD = 0.794


def _nodes(s, d):
    return standardize(reviews(s, d)).withColumn("week", F.date_trunc("week", "date").cast("date"))


_WEEK_NO = "CAST((CAST(date_trunc('week', date) AS DATE) - DATE '1970-01-05') // 7 AS BIGINT)"


def _no():
    return F.floor(F.datediff("week", F.lit("1970-01-05")) / 7)


def _weekly_files(rows, path: str) -> None:
    """A text file per week with a line per review; a week's rows lie in one file, in the order of their ids."""
    line = F.concat_ws(",", "review_id", "user_id", "rating").alias("value")
    rows.repartition("week").sortWithinPartitions("week", "review_id").select("week", line).write.mode("overwrite").partitionBy("week").text(path)


def _digests(s, path: str):
    return file_digests(s, path).withColumn("name", F.regexp_extract("path", "week=([0-9-]+)/", 1)).drop("path")


_FILES = _F + f", ln AS (SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS name, {_WEEK_NO} AS no, review_id, review_id || ',' || user_id || ',' || rating || chr(10) AS line FROM r), fl AS (SELECT name, any_value(no) AS no, string_agg(line, '' ORDER BY review_id) AS content FROM ln GROUP BY name)"


def _hashed(s, d):
    path = scratch(s, "weeks")
    _weekly_files(_nodes(s, d), path)
    return _digests(s, path).select("name", "size_bytes", "sha256")


register("sc28", _hashed, _FILES + " SELECT name, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM fl")


def _registry(s, d, path: str):
    """Every week is expected; each fifth one is not written. The last week may still change."""
    n = _nodes(s, d)
    _weekly_files(n.where(_no() % 5 != 0), path)
    expected = n.select(F.col("week").cast("string").alias("name"), "week").distinct()
    newest = n.agg(F.max("week").alias("_newest"))
    expected = expected.crossJoin(F.broadcast(newest)).select("name", F.lit("reviews").alias("category"), (F.col("week") == F.col("_newest")).alias("mutable"))
    return cut(checks.registered(expected, _digests(s, path)))


register(
    "gv04",
    lambda s, d: _registry(s, d, scratch(s, "registry")),
    _FILES + " SELECT name, 'reviews' AS category, name = (SELECT max(name) FROM fl) AS mutable, no % 5 <> 0 AS exists, CASE WHEN no % 5 <> 0 THEN CAST(strlen(content) AS BIGINT) END AS size_bytes, CASE WHEN no % 5 <> 0 THEN sha256(content) END AS sha256 FROM fl",
)


def _checked_again(s, d):
    """Digests taken again after each seventh week has got other ratings."""
    path = scratch(s, "registry")
    before = _registry(s, d, path)
    _weekly_files(_nodes(s, d).where(_no() % 5 != 0).withColumn("rating", F.when(_no() % 7 == 3, F.col("rating") + 1).otherwise(F.col("rating"))), path)
    return checks.rehashed(before, _digests(s, path))


register("gv08", _checked_again, _FILES + " SELECT name, no % 7 <> 3 AS unchanged FROM fl WHERE no % 5 <> 0")


def _card(s, d):
    """The model card as one nested document: training rows, graph, performance, controls; written, read and laid flat."""
    scored = cut(units.temporal_split(_scored(s, d)))
    links, n = cut(typed_edges(s, d)), _nodes(s, d)
    parts = scored.agg(F.struct(*[F.count_if(F.col("split") == p).alias(p) for p in ("train", "valid", "test")]).alias("training"))
    relations = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("edge_type").cast("string"), "directed_edges"))))
    graph = edges.edge_statistics(links, n).agg(relations.alias("relation_edge_counts"), F.sum("directed_edges").alias("total_directed_edges"))
    lonely = n.join(links.select(F.explode(F.array("src", "dst")).alias("review_id")).distinct(), "review_id", "left_anti").agg(F.count("*").alias("isolated_nodes"))
    graph = graph.crossJoin(lonely).crossJoin(n.agg(F.count("*").alias("n_nodes"))).select(F.struct("n_nodes", "total_directed_edges", "isolated_nodes", "relation_edge_counts").alias("graph"))
    measured = stats.confusion(scored.where("split <> 'train'"), "score", "is_fake", THRESHOLD, ["split"])
    performance = measured.agg(*[F.max(F.when(F.col("split") == p, F.struct("tn", "fp", "fn", "tp", "precision", "recall", "macro_f1"))).alias(p) for p in ("valid", "test")]).select(F.struct("valid", "test").alias("performance"))
    controls = F.array(F.lit("labels are no inputs"), F.lit("scales are learned on training rows"), F.lit("cutoffs are learned on training rows"), F.lit("test rows are for reporting only"))
    card = parts.crossJoin(graph).crossJoin(performance).select(F.lit("review graph").alias("model_id"), F.lit(THRESHOLD).alias("operating_threshold"), "training", "graph", "performance", controls.alias("leakage_controls"))
    path = scratch(s, "card")
    write_summary(card, path)
    back = s.read.schema(card.schema).json(path)
    flat = ["training.train", "training.valid", "training.test", "graph.n_nodes", "graph.total_directed_edges", "graph.isolated_nodes"]
    return rounded(back.select("model_id", "operating_threshold", *[F.col(c).alias(c.replace(".", "_")) for c in flat], *[F.col("graph.relation_edge_counts")[str(i)].alias(f"edges_{i}") for i in range(3)], *[F.col(f"performance.{p}.{x}").alias(f"{p}_{x}") for p in ("valid", "test") for x in ("tp", "fp", "precision", "macro_f1")], F.size("leakage_controls").alias("controls")))


_CELLS = "count(*) FILTER (score >= 0.794 AND is_fake = 1) AS tp, count(*) FILTER (score >= 0.794 AND is_fake = 0) AS fp, count(*) FILTER (score < 0.794 AND is_fake = 1) AS fn, count(*) FILTER (score < 0.794 AND is_fake = 0) AS tn"
_F1 = "(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2"
_OF = lambda p: f"(SELECT tp FROM cm WHERE split = '{p}') AS {p}_tp, (SELECT fp FROM cm WHERE split = '{p}') AS {p}_fp, (SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) FROM cm WHERE split = '{p}') AS {p}_precision, (SELECT round({_F1}, 6) FROM cm WHERE split = '{p}') AS {p}_macro_f1"
register(
    "gv01",
    _card,
    _TYPED + f""", g0 AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS pos, count(*) OVER () AS n FROM f), g1 AS (SELECT *, {_SPLIT} AS split, {_SCORE} AS score FROM g0), cm AS (SELECT split, {_CELLS} FROM g1 GROUP BY split)
SELECT 'review graph' AS model_id, CAST(0.794 AS DOUBLE) AS operating_threshold, {", ".join(f"(SELECT count(*) FROM g1 WHERE split = '{p}') AS training_{p}" for p in ("train", "valid", "test"))}, (SELECT count(*) FROM r) AS graph_n_nodes, (SELECT count(*) FROM te) AS graph_total_directed_edges,
(SELECT count(*) FROM r WHERE review_id NOT IN (SELECT unnest([src, dst]) FROM te)) AS graph_isolated_nodes, {", ".join(f"(SELECT count(*) FROM te WHERE edge_type = {i}) AS edges_{i}" for i in range(3))}, {_OF("valid")}, {_OF("test")}, CAST(4 AS BIGINT) AS controls""",
)


def _manifest(s, d):
    """The manifest as one nested document: files with rows and a version key, and what a dashboard may read and change;
    written, read, and one row a file, role or table."""
    tables = {"nodes": _nodes(s, d), "split": units.temporal_split(_nodes(s, d)), "predictions": _scored(s, d)}
    rows = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        rows = one if rows is None else rows.unionByName(one)
    keyed = rows.withColumn("version_key", F.md5(F.concat_ws(":", "name", F.col("rows").cast("string"))))
    names = F.array(*map(F.lit, tables))
    contract = F.struct(names.alias("read_only_files"), F.array(F.lit("threshold_change_log")).alias("mutable_tables"), F.lit("viewer").alias("default_role"), F.lit("admin").alias("admin_role"))
    whole = keyed.agg(F.sort_array(F.collect_list(F.struct("name", "rows", "version_key"))).alias("files")).select("files", contract.alias("dashboard_contract"), F.md5(F.array_join("files.version_key", ",")).alias("layer_version"))
    path = scratch(s, "manifest")
    write_summary(whole, path)
    back = s.read.schema(whole.schema).json(path)
    files = back.select(F.explode("files").alias("f"), "layer_version").select(F.lit("file").alias("section"), "f.name", "f.rows", "f.version_key", "layer_version")
    c = F.col("dashboard_contract")
    others = back.select(F.explode(F.concat(F.transform(c["read_only_files"], lambda x: F.struct(F.lit("read_only").alias("section"), x.alias("name"))), F.transform(c["mutable_tables"], lambda x: F.struct(F.lit("mutable").alias("section"), x.alias("name"))), F.array(F.struct(F.lit("default_role").alias("section"), c["default_role"].alias("name")), F.struct(F.lit("admin_role").alias("section"), c["admin_role"].alias("name"))))).alias("x"), "layer_version")
    return files.unionByName(others.select("x.section", "x.name", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("string").alias("version_key"), "layer_version"))


register(
    "gv05",
    _manifest,
    _F + """, k AS (SELECT name, (SELECT count(*) FROM r) AS rows FROM (VALUES ('nodes'), ('predictions'), ('split')) v(name)), kk AS (SELECT *, md5(name || ':' || rows) AS version_key FROM k),
lv AS (SELECT md5(string_agg(version_key, ',' ORDER BY name)) AS layer_version FROM kk) SELECT 'file' AS section, name, rows, version_key, layer_version FROM kk, lv
UNION ALL SELECT section, name, NULL, NULL, layer_version FROM (VALUES ('read_only', 'nodes'), ('read_only', 'split'), ('read_only', 'predictions'), ('mutable', 'threshold_change_log'), ('default_role', 'viewer'), ('admin_role', 'admin')) v(section, name), lv""",
)


def _policy(s, d):
    """The threshold in use beside the one that validation rows choose, and what each flags among test rows."""
    f = cut(units.temporal_split(_scored(s, d)).select("split", "is_fake", "score"))
    chosen = stats.best_threshold(f.where("split = 'valid'"), "score", "is_fake").select(F.lit("validation_selected").alias("policy_item"), F.col("threshold").alias("value"))
    items = chosen.unionByName(s.range(1).select(F.lit("operating").alias("policy_item"), F.lit(THRESHOLD).alias("value")))
    met = f.where("split = 'test'").crossJoin(F.broadcast(items))
    return rounded(met.groupBy("policy_item", "value").agg(F.count_if(F.round("score", 9) >= F.col("value")).alias("flagged"), F.count_if((F.round("score", 9) >= F.col("value")) & (F.col("is_fake") == 1)).alias("right")))


register(
    "gv03",
    _policy,
    _PARTS + f""", ev AS (SELECT split, is_fake, round({_SCORE}, 9) AS score FROM p1), eg AS (SELECT (t + 4) / 100 AS t FROM range(1, 92) x(t)),
em AS (SELECT t, count(*) FILTER (score >= t AND is_fake = 1) AS tp, count(*) FILTER (score >= t AND is_fake = 0) AS fp, count(*) FILTER (score < t AND is_fake = 1) AS fn, count(*) FILTER (score < t AND is_fake = 0) AS tn FROM ev, eg WHERE split = 'valid' GROUP BY t),
it AS (SELECT 'validation_selected' AS policy_item, t AS value FROM (SELECT t FROM em ORDER BY round({_F1}, 12) DESC, t LIMIT 1) UNION ALL SELECT 'operating', 0.794)
SELECT policy_item, round(CAST(value AS DOUBLE), 6) AS value, count(*) FILTER (score >= value) AS flagged, count(*) FILTER (score >= value AND is_fake = 1) AS right FROM ev, it WHERE split = 'test' GROUP BY ALL""",
)



def _role():
    return F.when(F.col("c_custkey") % 10 == 0, "admin").when(F.col("c_custkey") % 3 == 0, "reviewer").otherwise("viewer")


_ROLES_SQL = "(VALUES " + ", ".join(str(r) for r in checks.ROLES) + ") AS a(" + ", ".join(x.split()[0] for x in checks.ROLE_SCHEMA.split(", ")) + ")"


def _permitted(s, d):
    """Each customer's account looked up in the role table: how many of a segment may read, export and change."""
    roles = s.createDataFrame(checks.ROLES, checks.ROLE_SCHEMA)
    met = table(s, d, "customer").select("c_mktsegment", _role().alias("role")).join(F.broadcast(roles), "role")
    return met.groupBy("c_mktsegment").agg(*[F.count_if(c).alias(c) for c in ("may_read", "may_export", "may_change")])


register("gv06", _permitted, f"SELECT c_mktsegment, count(*) FILTER (may_read) AS may_read, count(*) FILTER (may_export) AS may_export, count(*) FILTER (may_change) AS may_change FROM customer JOIN {_ROLES_SQL} ON a.role = CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'reviewer' ELSE 'viewer' END GROUP BY 1")


def _changes(s, d):
    """A log of threshold changes, one a product and week, appended in two parts; each product's last one holds."""
    path = scratch(s, "changes")
    made = _nodes(s, d).groupBy("prod_id", "week").agg(F.avg("is_fake").alias("threshold")).withColumn("seq", _no().cast("long"))
    for odd in (0, 1):
        made.where(F.col("seq") % 2 == odd).select("seq", "prod_id", "threshold").write.mode("append").parquet(path)
    return rounded(s.read.parquet(path).groupBy("prod_id").agg(F.max_by("threshold", "seq").alias("threshold"), F.count("*").alias("changes")))


register("gv07", _changes, _F + f", lg AS (SELECT prod_id, {_WEEK_NO} AS seq, avg(is_fake) AS threshold FROM r GROUP BY 1, 2) SELECT prod_id, round(arg_max(threshold, seq), 6) AS threshold, count(*) AS changes FROM lg GROUP BY 1")


def _dict_rows(s, d):
    """Rows made of dictionaries, one a nation, written as CSV and read again."""
    counted = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    rows = [r.asDict() for r in counted.collect()]  # as many as there are nations
    path = scratch(s, "rows")
    write_csv(s.createDataFrame(rows, "nation long, customers long"), path, "none")
    return s.read.schema("nation long, customers long").csv(path, header=True)


register("snk17", _dict_rows, "SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS customers FROM customer GROUP BY 1")


def _ratios(s, d):
    """Shares of the split among the reviews of each rating, and whether they are such as a split may have."""
    split = units.temporal_split(_nodes(s, d))
    shares = split.groupBy("prod_id").agg(*[(F.count_if(F.col("split") == p) / F.count("*")).alias(p) for p in ("train", "valid", "test")])
    return rounded(checks.ratio_checks(shares))


register("val06", _ratios, _PARTS + ", g AS (SELECT prod_id, " + ", ".join(f"count(*) FILTER (split = '{p}') / count(*) AS {p}" for p in ("train", "valid", "test")) + " FROM p1 GROUP BY 1) SELECT prod_id, " + ", ".join(f"round({p}, 6) AS {p}" for p in ("train", "valid", "test")) + ", least(train, valid, test) > 0 AND abs(train + valid + test - 1) <= 1e-8 AS ok FROM g")
