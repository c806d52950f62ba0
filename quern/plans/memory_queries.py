"""Queries of the conversation, index and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index as X
from ..operators import memory as M
from ..session import ensure_checkpoint_dir, table
from .text_queries import _tokens_sql


def _turns(spark, sf) -> DataFrame:
    return M.record_turns(table(spark, sf, "conversations"))


def record_turns(spark, sf):
    return _turns(spark, sf).withColumn("importance", F.round("importance", 6))


def recent_turns(spark, sf):
    return M.recent_turns(_turns(spark, sf), 2).select("conv_id", "turn_no", "text")


def _hits(spark, sf) -> DataFrame:
    """Each turn as a hit of its conversation's query, scored by size."""
    t = _turns(spark, sf)
    rows = t.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 1000 + F.col("turn_no")).alias("chunk_id"), F.lit("turn").alias("kind"), "turn_no", F.when(F.col("turn_no") % 2 == 0, F.col("turn_no") + 1).alias("accessed_turn"), "importance", F.col("n_tokens").cast("double").alias("score"), "text", F.concat(F.col("text"), F.lit(" "), F.col("text")).alias("wide"))
    return rows.withColumn("rank", F.col("turn_no"))


def memory_rescore(spark, sf):
    return M.rescore(_hits(spark, sf), F.lit(10)).select("query_id", "chunk_id", "memory_score", "rank")


def context_budget(spark, sf):
    return M.within_budget(_hits(spark, sf), 150).select("query_id", "chunk_id", "rank", "chosen", "used")


def turn_windows(spark, sf):
    return M.windows(_turns(spark, sf), 2).select("conv_id", "upto", F.array_join("texts", "\n---\n").alias("texts"))


def consolidate(spark, sf):
    return M.consolidate(_turns(spark, sf), lambda previous, texts: f"{previous or ''}|{len(texts)}", 2)


def corpus_tokens(spark, sf):
    t = _turns(spark, sf).select(F.lit("turn").alias("kind"), "n_tokens", "turn_no")
    d = table(spark, sf, "documents").select(F.lit("chunk").alias("kind"), T.estimate_tokens(F.col("text")).alias("n_tokens"), F.lit(None).cast("int").alias("turn_no"))
    return M.corpus_tokens(t.unionByName(d))


def stream_turns(spark, sf):
    """The table read as a stream to its end; numbered turns go to the shared checkpoint folder."""
    from ..streaming import turns as S

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/turns-{uuid.uuid4().hex}"
    source = table(spark, sf, "conversations")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    try:
        stream = spark.readStream.schema(source.schema).parquet(f"{sf}/conversation[s].parquet")
        rows = S.numbered_turns(stream, 4).select("conv_id", "turn_no", "text", "summary")
        rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def orphan_audit(spark, sf):
    t = lambda n: table(spark, sf, n)
    checks = [
        X.orphans(t("labels"), t("documents"), "doc_id", "label without document"),
        X.orphans(t("documents"), t("labels"), "doc_id", "document without label"),
        X.orphans(t("orders").select(F.col("o_custkey").alias("c_custkey")), t("customer"), "c_custkey", "order without customer"),
        X.orphans(t("customer").select(F.col("c_custkey").alias("o_custkey")), t("orders"), "o_custkey", "customer without order"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def upsert_meta(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    return X.upserted(old, new, ["key"])


def _chunks(spark, sf) -> DataFrame:
    """Documents as chunks; every fourth is the parent of the three after it."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") - F.col("doc_id") % 4).alias("parent_id"), "source", F.lit(None).cast("int").alias("accessed_turn"))


def _gone(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("chunk_id"))


def delete_cascade(spark, sf):
    gone = _gone(spark, sf)
    return X.cleared_parents(X.without(_chunks(spark, sf), gone, "chunk_id"), gone).select("chunk_id", "parent_id", "source")


def touch_access(spark, sf):
    return X.touched(_chunks(spark, sf), _gone(spark, sf), F.lit(7)).select("chunk_id", "accessed_turn")


QUERIES = {f.__name__: f for f in (record_turns, recent_turns, memory_rescore, context_budget, turn_windows, consolidate, corpus_tokens, stream_turns, orphan_audit, upsert_meta, delete_cascade, touch_access)}

_TURNS = f"""talk AS (SELECT conv_id, turn, role, text, lead(role) OVER o AS next_role, lead(text) OVER o AS nxt FROM conversations WHERE role IN ('user', 'assistant')
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role <> 'user')),
said AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no, '[user] ' || coalesce(text, '') || chr(10) || '[assistant] ' || CASE WHEN next_role = 'assistant' THEN coalesce(nxt, '') ELSE '' END AS text FROM talk WHERE role = 'user'),
turns AS (SELECT *, {_tokens_sql('text')} AS n_tokens FROM said)"""
_IMPORTANCE = "least(1.0::DOUBLE, 0.35::DOUBLE + n_tokens / 1500.0::DOUBLE)"

SQL = {
    "record_turns": f"WITH {_TURNS} SELECT conv_id, turn_no, text, n_tokens, round({_IMPORTANCE}, 6) AS importance FROM turns",
    "recent_turns": f"WITH {_TURNS} SELECT conv_id, turn_no, text FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) <= 2",
    "memory_rescore": f"""WITH {_TURNS}, h AS (SELECT conv_id AS query_id, conv_id * 1000 + turn_no AS chunk_id, turn_no,
round(n_tokens::DOUBLE / max(n_tokens) OVER (PARTITION BY conv_id) + 0.35::DOUBLE * power(0.5::DOUBLE, greatest(0, 10 - CASE WHEN turn_no % 2 = 0 THEN turn_no + 1 ELSE turn_no END) / 40.0::DOUBLE) + 0.25::DOUBLE * {_IMPORTANCE}, 6) + 0.0::DOUBLE AS memory_score FROM turns)
SELECT query_id, chunk_id, memory_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY memory_score DESC, turn_no, chunk_id) AS INTEGER) AS rank FROM h""",
    "turn_windows": f"WITH {_TURNS} SELECT conv_id, CAST(((turn_no - 1) // 2 + 1) * 2 AS INTEGER) AS upto, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn_no) AS texts FROM turns GROUP BY conv_id, (turn_no - 1) // 2 HAVING count(*) = 2",
    "corpus_tokens": f"WITH {_TURNS}, u AS (SELECT n_tokens, turn_no FROM turns UNION ALL SELECT {_tokens_sql('text')}, NULL FROM documents) SELECT count(*) AS n_chunks, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS n_tokens, coalesce(max(turn_no), 0) AS last_turn FROM u",
    "stream_turns": """WITH n AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no, text FROM conversations),
w AS (SELECT conv_id, CAST(max(turn_no) AS INTEGER) AS turn_no, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn_no) AS summary FROM n GROUP BY conv_id, (turn_no - 1) // 4 HAVING count(*) = 4)
SELECT conv_id, turn_no, text, summary FROM n LEFT JOIN w USING (conv_id, turn_no)""",
    "orphan_audit": """SELECT 'label without document' AS relation, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document without label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer without order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "upsert_meta": """SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT CAST(o_custkey AS VARCHAR), max(o_orderpriority) FROM orders GROUP BY o_custkey""",
    "delete_cascade": """WITH g AS (SELECT doc_id FROM labels WHERE quality = 0), c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 4 END AS parent_id, source FROM documents)
SELECT chunk_id, CASE WHEN parent_id NOT IN (SELECT doc_id FROM g) THEN parent_id END AS parent_id, source FROM c WHERE chunk_id NOT IN (SELECT doc_id FROM g)""",
    "touch_access": "SELECT doc_id AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 7 END AS accessed_turn FROM documents",
}
