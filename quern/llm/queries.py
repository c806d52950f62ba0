"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import ego, html, media, mixing, quality, sharding, simhash, tokens, urls


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_classes(table(spark, sf_dir, "embeddings"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_chunks(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.prefix_token_counts(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repetition_limit=2.0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.score_urls(table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.95),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, p.b FROM reach r JOIN p ON r.other = p.a),
classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
links AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
SELECT t.vec_id, c.class_id, CASE WHEN c.id IS NOT NULL THEN CAST(coalesce(l.n, 0) AS BIGINT) END AS n_links
FROM embeddings t LEFT JOIN classes c ON t.vec_id = c.id LEFT JOIN links l ON t.vec_id = l.id
"""

OP9_SQL = """
WITH sized AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
summed AS (
  SELECT doc_id, n_bytes,
    CAST(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS byte_start,
    CAST(sum(n_bytes) OVER () AS BIGINT) AS total
  FROM sized),
counted AS (SELECT *, greatest(1, (total + 8388607) // 8388608) AS n FROM summed)
SELECT doc_id, n_bytes, byte_start, CAST(least(n - 1, CAST(byte_start AS HUGEINT) * n // greatest(total, 1)) AS BIGINT) AS shard FROM counted
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_html": op2_html,
        "op3_embeddings": op3_embeddings,
        "op4_media": op4_media,
        "op5_token_counts": op5_token_counts,
        "op6_mixing": op6_mixing,
        "op7_bpe": op7_bpe,
        "op8_quality": op8_quality,
        "op9_sharding": op9_sharding,
        "op10_urls": op10_urls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embeddings": OP3_SQL, "op9_sharding": OP9_SQL}
