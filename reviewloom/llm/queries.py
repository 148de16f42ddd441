"""The registered queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import alignment, chunk_bpe, hamming, langid, line_dedup, middle, minhash, mixing, packing, pii, quality, secrets, sharding
from reviewloom.llm.common import table


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.jump_shards(table(spark, sf_dir, "documents"), 24).drop("key")


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.line_chunk_dedup(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").cast("long").alias("chars_left"), F.md5("text").alias("text_md5"))


def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_forest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts: list[Column] = [count(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.personal_data(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op5_lang_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_codes(table(spark, sf_dir, "documents"))


def op6_fss_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.secret_spans(table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op9_online_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer or vocabulary())


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file, by default that of the packing query; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.hamming_top_k(rows, rows.where("id % 50 = 0"))


def op11_fim_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.alignments(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return alignment.with_pair_counts(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", groups, "keys", "links"))


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk_bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return made.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_jump_shards, op2_line_chunks, op3_quality_forest, op4_pii_boost, op5_lang_ecoc, op6_fss_neardup, op7_systematic_mix, op8_zstd_secrets, op9_online_pack, op10_multi_index, op11_fim_select, op12_token_alignment, op13_chunk_bpe)}

_WORD = r"[^\x20\x09-\x0D]+"

OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
), c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept FROM s JOIN c ON c.x = s.doc_id
"""

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, '=' || doc_id AS k FROM documents
), z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
    CAST(3 * source_size AS DOUBLE) AS cap FROM z
), l AS (
  SELECT *, (sum(cap) OVER () / 3 - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, CASE WHEN level * weight <= cap THEN (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight ELSE cap END AS target FROM l
), n AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    coalesce('=' || d.source, '') AS name, length(bin(size + 1)) * 16 + (((size + 1) * 32) >> length(bin(size + 1))) % 16 AS class
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, CAST(floor(CAST('0x' || substr(md5(k), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
    * greatest(1, ceil((SELECT max(c) FROM (SELECT count(*) AS c FROM n GROUP BY name, class)) / 50000.0))) AS BIGINT) AS block FROM n
), o AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY class, block, k) AS i, CAST('0x' || substr(md5('mix-1|' || name), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM b
)
SELECT doc_id, size, source_size, target, CAST(floor(i * rate + u) - floor((i - 1) * rate + u) AS BIGINT) * size AS taken FROM o
"""

OP10_SQL = """
WITH c AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings
), p AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, CAST(len(list_filter(list_zip(q.b, c.b), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
  FROM c q JOIN c ON q.id <> c.id WHERE q.id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
), r AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), p AS (
  SELECT doc_id, t, CAST(n AS BIGINT) AS n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:n], '') AS suffix FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

ORACLE_SQL = {"op6_fss_neardup": OP6_SQL, "op7_systematic_mix": OP7_SQL, "op10_multi_index": OP10_SQL, "op11_fim_select": OP11_SQL}
