"""The ten queries of the training-data operators over the standard tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.warc import report_sql

#: The tokenizer file that packing counts by; a parameter of the deployment.
TOKENIZER = os.environ.get("TESSERA_TOKENIZER", "") or public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import report

    return report(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import similarity_join

    return similarity_join(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, by a model fitted on a bounded sample of the documents' languages."""
    from tessera.llm.language_id import fit, identify

    langs, model = fit(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    return identify(table(spark, sf_dir, "pages"), langs, model, "page_id", "html", url_col="url", markup=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import document_rates

    return document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_dedup, op2_pii, op3_warc, op4_toxicity, op5_substring_dedup, op6_media_columns, op7_jaccard_join, op8_language_id, op9_packing, op10_mixing)}

#: Exact links by a self-join within labels, then the smallest reachable id by a recursive walk.
OP1_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
walk(x, y) AS (SELECT vec_id, vec_id FROM good UNION SELECT walk.x, links.y FROM walk JOIN links ON walk.y = links.x),
low AS (SELECT x, min(y) AS component_id FROM walk GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, coalesce(low.component_id, e.vec_id) AS component_id,
       coalesce(e.vec_id = coalesce(low.component_id, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN low ON low.x = e.vec_id LEFT JOIN deg ON deg.x = e.vec_id
"""

#: Exact: every shingle by itself, pairs that share one, then the smallest reachable id by a recursive walk.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
half AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
walk(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.x, links.y FROM walk JOIN links ON walk.y = links.x),
low AS (SELECT x, min(y) AS class_id FROM walk GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, low.class_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, d.doc_id = low.class_id AS kept
FROM documents d JOIN low ON low.x = d.doc_id LEFT JOIN deg ON deg.x = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op3_warc": report_sql(), "op7_jaccard_join": OP7_SQL}
