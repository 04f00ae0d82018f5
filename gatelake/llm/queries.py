"""Registered queries of this subpackage: each operator with its production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm import (decontaminate, embedding_dedup, html_text, licenses, line_dedup, merkle, ngram_join, prefix_trie,
                          quality, secrets, sentence_pieces, substring_dedup, warc)
from gatelake.llm.common import read_table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read_table(spark, sf_dir, "documents"))


_COMPONENTS = """
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b, root FROM reached JOIN both_ways ON a = id WHERE root < b),
smallest AS (SELECT id, min(root) AS root FROM reached GROUP BY id)"""
SQL["op10_ngram_join"] = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS shingle
  FROM texts, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest ON id = d.doc_id"""


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read_table(spark, sf_dir, "embeddings"))


SQL["op4_embedding_dedup"] = f"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.95),
{_COMPONENTS},
counts AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN smallest s ON s.id = e.vec_id LEFT JOIN counts c ON c.id = e.vec_id"""


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.match_licenses(read_table(spark, sf_dir, "documents"), licenses.known_digests(spark))


SQL["op5_licenses"] = licenses.oracle_sql()


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(read_table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS keeper FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(read_table(spark, sf_dir, "documents"))


SQL["op13_merkle_manifest"] = merkle.oracle_sql()


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


SQL["op12_prefix_trie"] = prefix_trie.oracle_sql()


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op11_substring_dedup"] = substring_dedup.oracle_sql()
