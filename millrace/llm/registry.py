"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import brown_lm, byte_bpe, fm_quality, html_main, kd_means, line_frequency, lsh_forest, mixing, packing, rabitq, reply_trees, surrogates, whitening
from millrace.llm._shared import table, word_count

Query = Callable[[SparkSession, str], DataFrame]


def op1_brown_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.perplexity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh_forest.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), lsh_forest.Forest(width=3, percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_sized(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rabitq.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return fm_quality.score(docs, fm_quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op8_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = reply_trees.digests(reply_trees.as_tree(rows.union(more)))
    return out.withColumn("conv_id", F.when(~F.col("conv_id.none"), F.col("conv_id.id")))


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_rules(table(spark, sf_dir, "documents"))


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = kd_means.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    said = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return given.select("vec_id", "cluster", "distance", *(F.col(c).try_cast("long").alias(c) for c in ("cluster_inertia", "inertia")), said.alias("centroid_sha256"))


_W = r"[^\x20\x09-\x0D]+"
_OPEN = r"([<\[])(\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?SYS>>))"

OP9_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS r, coalesce(text, '') AS x, role, text FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(r) + length(regexp_replace(x, '{_OPEN}', '\1\\\2', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, 'none') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '{_W}') AS ws FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS k FROM g) WHERE k > 1
  ) GROUP BY r
), lines AS (
  SELECT r, host, t, line, len(regexp_extract_all(line, '{_W}')) AS n,
    regexp_replace(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_W}')
), common AS (
  SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT t) > {line_frequency.LineRules().max_line_docs}
), gone AS (
  SELECT r, sum(n) AS words FROM lines SEMI JOIN common USING (host, norm) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), f AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.words, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN again USING (r) LEFT JOIN gone USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= {line_frequency.LineRules().min_kept_percent} * n_words AS kept
FROM f
"""


OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS three
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.three = b.three AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS m ON m.doc_id = x JOIN n AS o ON o.doc_id = y WHERE 100 * c >= 85 * (m.n + o.n - c)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, 65), lambda i: (v.e[i] - q.e[i]) * (v.e[i] - q.e[i])), lambda x, y: x + y)) AS score FROM v JOIN v AS q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


def _op13_sql() -> str:
    """Plain rounds over all pairs of vectors and centroids, components as rows."""
    parts = ["""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), x AS MATERIALIZED (
  SELECT r, unnest(range(64)) AS j, unnest(e) AS x FROM v
), c0 AS MATERIALIZED (
  SELECT k, unnest(range(64)) AS j, unnest(e) AS c
  FROM (SELECT e, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), e) - 1 AS k FROM v QUALIFY k < 16)
)"""]
    for n in range(kd_means.ROUNDS + 1):
        parts.append(f""", a{n} AS MATERIALIZED (
  SELECT r, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM (SELECT r, k, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (j) GROUP BY r, k) GROUP BY r
), c{n + 1} AS MATERIALIZED (
  SELECT k, j, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT k, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM a{n} JOIN x USING (r) GROUP BY k, j) USING (k, j)
)""")
    n = kd_means.ROUNDS
    return "".join(parts) + f"""
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, s.h AS centroid_sha256
FROM a{n} AS a JOIN v USING (r) JOIN (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS h FROM c{n} GROUP BY k) AS s ON s.k = a.k
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_brown_bigrams, op2_lsh_forest, op3_best_fit_packing, op4_pivotal_mixing, op5_one_bit_codes, op6_surrogates, op7_factorisation_machine, op8_site_templates, op9_reply_trees, op10_line_frequency, op11_lobpcg_whitening, op12_byte_bpe, op13_kd_means)}


def oracle_sql() -> dict[str, str]:
    return {"op2_lsh_forest": OP2_SQL, "op5_one_bit_codes": OP5_SQL, "op9_reply_trees": OP9_SQL, "op10_line_frequency": OP10_SQL, "op13_kd_means": _op13_sql()}
