"""Queries of the evaluation operators: the benchmark's passages are the queries, a document is relevant by its quality label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as V
from ..operators import search as S
from ..session import checkpointed, table
from .search_queries import SQL as SEARCH_SQL
from .search_queries import _lexical
from .text_queries import _PRINT


def _rankings(spark, sf, k: int = 20) -> DataFrame:
    asked, posts, docs = _lexical(spark, sf)
    return S.sparse_topk(asked, posts, docs, k).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")


def _qrels(spark, sf) -> DataFrame:
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return queries.crossJoin(table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("grade")))


_METRICS = ["recall_at_5", "recall_at_10", "recall_at_20", "mrr_at_20", "ndcg_at_10"]


def retrieval_metrics(spark, sf):
    return V.metrics(_rankings(spark, sf), _qrels(spark, sf))


def macro_metrics(spark, sf):
    return V.macro(retrieval_metrics(spark, sf), _METRICS)


def fact_coverage(spark, sf):
    facts = table(spark, sf, "documents").select("doc_id", F.col("source").alias("fact"))
    required = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).crossJoin(facts.select("fact").distinct())
    return V.coverage(_rankings(spark, sf), facts, required)


def duplicate_rate(spark, sf):
    prints = table(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return V.duplicate_rate(_rankings(spark, sf), prints)


def no_answer(spark, sf):
    labels = table(spark, sf, "labels")
    return labels.select("doc_id", V.no_answer_correct(F.col("quality") == 0, F.col("toxic") == 1).alias("correct"))


def citation_precision(spark, sf):
    cited = _rankings(spark, sf, 10).join(table(spark, sf, "labels"), "doc_id").select("query_id", (F.col("quality") == 1).alias("supported"))
    return V.citation_precision(cited)


def latency_percentiles(spark, sf):
    return V.percentiles(table(spark, sf, "events"), "value", ["user_id"])


def _stages(spark, sf):
    wide = checkpointed(_rankings(spark, sf))  # read for every stage and check
    narrow = wide.where("rank <= 10")
    return wide.select(F.lit("wide").alias("stage"), "query_id", "doc_id", "rank").unionByName(narrow.select(F.lit("narrow").alias("stage"), "query_id", (F.col("doc_id") - F.when(F.col("rank") == 10, 1).otherwise(0)).alias("doc_id"), "rank"))


def stage_report(spark, sf):
    return V.stage_report(_stages(spark, sf), _qrels(spark, sf))


def lineage_violations(spark, sf):
    return V.lineage_violations(_stages(spark, sf), ["wide", "narrow"], {"narrow": 8}).withColumn("n", F.col("n").cast("bigint"))


def bootstrap_ci(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), F.col("toxic").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))
    return V.paired_bootstrap(labels)


def latency_bootstrap(spark, sf):
    return V.clustered_percentile(table(spark, sf, "events"), "user_id", "value")


QUERIES = {f.__name__: f for f in (retrieval_metrics, macro_metrics, fact_coverage, duplicate_rate, no_answer, citation_precision, latency_percentiles, stage_report, lineage_violations, bootstrap_ci, latency_bootstrap)}

_RANKED = f"sparse AS ({SEARCH_SQL['sparse_topk'].replace('rank <= 10', 'rank <= 20')}), ranked AS (SELECT query_id, chunk_id AS doc_id, rank FROM sparse)"
_GAIN = "(power(2.0::DOUBLE, grade) - 1)"
_GRADES = "grades AS (SELECT doc_id, quality * 2 + toxic AS grade FROM labels), good AS (SELECT * FROM grades WHERE grade > 0)"
_TABLE = f"""{_RANKED}, {_GRADES},
ideal AS (SELECT count(*) AS positives, sum({_GAIN} / log2(i + 1)) FILTER (i <= 10) AS idcg FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC, doc_id) AS i FROM good)),
found AS (SELECT r.query_id, r.rank, g.grade FROM ranked r LEFT JOIN good g USING (doc_id)),
per AS (SELECT item_id AS query_id, round(count(*) FILTER (grade > 0 AND rank <= 5) / any_value(positives), 6) AS recall_at_5, round(count(*) FILTER (grade > 0 AND rank <= 10) / any_value(positives), 6) AS recall_at_10,
round(count(*) FILTER (grade > 0 AND rank <= 20) / any_value(positives), 6) AS recall_at_20, round(coalesce(1 / min(rank) FILTER (grade > 0), 0), 6) AS mrr_at_20,
round(coalesce(sum({_GAIN} / log2(rank + 1)) FILTER (grade > 0 AND rank <= 10), 0) / any_value(idcg), 6) AS ndcg_at_10 FROM benchmark LEFT JOIN found ON item_id = query_id CROSS JOIN ideal GROUP BY item_id)"""
_STAGED = f"{_RANKED}, staged AS (SELECT 'wide' AS stage, query_id, doc_id, rank FROM ranked UNION ALL SELECT 'narrow', query_id, doc_id - CASE WHEN rank = 10 THEN 1 ELSE 0 END, rank FROM ranked WHERE rank <= 10)"

SQL = {
    "retrieval_metrics": f"WITH {_TABLE} SELECT * FROM per",
    "macro_metrics": f"WITH {_TABLE} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, count({m}) AS support FROM per" for m in _METRICS),
    "fact_coverage": f"WITH {_RANKED} SELECT item_id AS query_id, round(count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents), 6) AS coverage FROM benchmark LEFT JOIN ranked ON item_id = query_id LEFT JOIN documents USING (doc_id) GROUP BY item_id",
    "duplicate_rate": f"""WITH {_RANKED}, prints AS (SELECT doc_id, {_PRINT} AS p FROM documents), s AS (SELECT query_id, p, count(*) AS n FROM ranked JOIN prints USING (doc_id) GROUP BY ALL)
SELECT query_id, CASE WHEN sum(n) > 1 THEN round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) ELSE 0 END AS duplicate_rate FROM s GROUP BY query_id""",
    "no_answer": "SELECT doc_id, CAST((quality = 0) = (toxic = 1) AS DOUBLE) AS correct FROM labels",
    "citation_precision": f"WITH {_RANKED} SELECT query_id, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS citation_precision FROM ranked JOIN labels USING (doc_id) WHERE rank <= 10 GROUP BY query_id",
    "latency_percentiles": "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY user_id",
    "stage_report": f"WITH {_STAGED}, {_GRADES} SELECT stage, query_id, count(*) AS candidates, count(*) - count(DISTINCT s.doc_id) AS duplicates, round(count(DISTINCT g.doc_id) / (SELECT count(*) FROM good), 6) AS recall FROM staged s LEFT JOIN good g USING (doc_id) GROUP BY stage, query_id",
    "lineage_violations": f"""WITH {_STAGED}
SELECT 'narrow' AS stage, query_id, 'invented' AS violation, count(DISTINCT doc_id) AS n FROM staged a WHERE stage = 'narrow' AND NOT EXISTS (SELECT 1 FROM staged b WHERE b.stage = 'wide' AND b.query_id = a.query_id AND b.doc_id = a.doc_id) GROUP BY query_id
UNION ALL SELECT stage, query_id, 'repeated', CAST(sum(n - 1) AS BIGINT) FROM (SELECT stage, query_id, doc_id, count(*) AS n FROM staged GROUP BY ALL HAVING count(*) > 1) GROUP BY stage, query_id
UNION ALL SELECT stage, query_id, 'too many', count(*) - 8 FROM staged WHERE stage = 'narrow' GROUP BY stage, query_id HAVING count(*) > 8""",
}
