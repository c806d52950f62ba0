"""Conversation memory: turns, their importance and recency, consolidation, and the budget of a context."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ensure_importable

HALF_LIFE, W_RELEVANCE, W_RECENCY, W_IMPORTANCE = 40.0, 1.0, 0.35, 0.25
SMALL_CORPUS, BUDGET, RECENT, SUMMARY_EVERY = 8000, 6000, 4, 12


def importance(n_tokens: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.35) + n_tokens / F.lit(1500.0))


def record_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, text, n_tokens, importance) from messages (conv_id, turn, role, text): each user message with the assistant's next one
    before another user message; a missing answer is empty. turn_no counts from 1 in a conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.when(F.col("role") == "user", 0).otherwise(1))
    talk = messages.where(F.col("role").isin("user", "assistant")).withColumns({"_next_role": F.lead("role").over(order), "_next": F.lead("text").over(order)})
    asked = talk.where("role = 'user'")
    answer = F.when(F.col("_next_role") == "assistant", F.coalesce("_next", F.lit(""))).otherwise(F.lit(""))
    text = F.concat(F.lit("[user] "), F.coalesce("text", F.lit("")), F.lit("\n[assistant] "), answer)
    out = asked.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("turn_no"), text.alias("text"))
    out = out.withColumn("n_tokens", T.estimate_tokens(F.col("text")))
    return out.withColumn("importance", importance(F.col("n_tokens")))


def recency(kind: Column, turn_no: Column, accessed: Column, now: Column, half_life: float = HALF_LIFE) -> Column:
    """0.5 to the power of the turns since the last use over the half-life; what isn't a turn has 0.5."""
    since = F.greatest(F.lit(0), now - F.greatest(turn_no, F.coalesce(accessed, F.lit(0))))
    return F.when((kind == "turn") & turn_no.isNotNull(), F.pow(F.lit(0.5), since / half_life)).otherwise(F.lit(0.5))


def rescore(hits: DataFrame, now: Column, decimals: int = 6) -> DataFrame:
    """hits (query_id, chunk_id, kind, turn_no, accessed_turn, importance, score, rank) with memory_score, ranked by it; equal scores keep their order."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    relevance = F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0))
    weight = F.when(F.coalesce("importance", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("importance"))
    total = W_RELEVANCE * relevance + W_RECENCY * recency(F.col("kind"), F.col("turn_no"), F.col("accessed_turn"), now) + W_IMPORTANCE * weight
    out = hits.withColumn("memory_score", F.round(total, decimals) + 0.0)
    order = Window.partitionBy("query_id").orderBy(F.col("memory_score").desc(), "rank", "chunk_id")
    return out.withColumn("_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("_rank", "rank")


def recent_turns(turns: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n turns of each conversation, in order of turn_no."""
    last = Window.partitionBy("conv_id").orderBy(F.col("turn_no").desc())
    return turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def within_budget(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(query_id, chunk_id, rank, chosen, used): hits in order, each with its wide text if that still fits, else its own text, else not at all.

    Which one fits depends on those before it, so a query's hits are one group; a query's hits are a page.
    """
    ensure_importable(hits.sparkSession)
    sized = hits.select("query_id", "chunk_id", "rank", "text", "wide", T.estimate_tokens(F.col("text")).alias("n"), T.estimate_tokens(F.col("wide")).alias("n_wide"))

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for r in rows.sort_values(["rank", "chunk_id"]).itertuples(index=False):
            if used >= budget:
                break
            for size, text in ((r.n_wide, r.wide), (r.n, r.text)):
                if used + size <= budget:
                    used += int(size)
                    out.append((r.query_id, r.chunk_id, r.rank, text, used))
                    break
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "rank", "chosen", "used"])

    kinds = {f.name: f.dataType.simpleString() for f in sized.schema.fields}
    return sized.groupBy("query_id").applyInPandas(take, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rank {kinds['rank']}, chosen string, used int")


def windows(turns: DataFrame, every: int = SUMMARY_EVERY) -> DataFrame:
    """(conv_id, upto, texts): the turns of each full window of `every` turns, in order."""
    group = F.floor((F.col("turn_no") - 1) / every).cast("int")
    rows = turns.groupBy("conv_id", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("turn_no", "text"))).alias("t"))
    return rows.where(F.size("t") == every).select("conv_id", ((F.col("g") + 1) * every).alias("upto"), F.transform("t", lambda x: x["text"]).alias("texts"))


def consolidate(turns: DataFrame, summarize: Callable[[str | None, list[str]], str | None], every: int = SUMMARY_EVERY, turn_chars: int | None = None) -> DataFrame:
    """(conv_id, upto, summary): the rolling summary after each conversation's last full window. summarize(previous, texts) is the caller's model;
    a window for which it fails or gives nothing leaves the summary as it was. turn_chars: cut each turn for a model with little room (1200, say); by default turns are whole."""
    ensure_importable(turns.sparkSession)
    parts = windows(turns, every)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        summary, at = None, 0
        for r in rows.sort_values("upto").itertuples(index=False):
            try:
                new = summarize(summary, [t[:turn_chars] for t in r.texts])
            except Exception:  # a model's failure never stops the conversation
                new = None
            if new:
                summary, at = new.strip(), r.upto
        return pd.DataFrame([(rows["conv_id"].iloc[0], at, summary)] if summary else [], columns=["conv_id", "upto", "summary"])

    return parts.groupBy("conv_id").applyInPandas(fold, f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, upto int, summary string")


def corpus_tokens(chunks: DataFrame, kinds: tuple[str, ...] = ("chunk", "turn")) -> DataFrame:
    return chunks.where(F.col("kind").isin(*kinds)).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("turn_no"), F.lit(0)).alias("last_turn"))


def build_context(chunks: DataFrame, hits: DataFrame, turns: DataFrame, now: Column, budget: int = BUDGET, small: int = SMALL_CORPUS) -> DataFrame:
    """(query_id, chunk_id, rank, chosen, used, part): what goes into the prompt. A corpus of up to `small` tokens goes in whole (part "corpus"), in order of chunk_id;
    otherwise the rescored hits (part "memory") within the budget, without the most recent turns: these (part "recent") go in as they are, in the order of the
    conversations and turns, beside the budget. turns: (conv_id, turn_no, chunk_id, text); the last RECENT of each conversation are recent, for every query."""
    total = corpus_tokens(chunks).first()["n_tokens"]
    if total <= small:
        own = chunks.where(F.col("kind").isin("chunk", "turn"))
        order = Window.partitionBy("query_id").orderBy("chunk_id")
        every = hits.select("query_id").distinct().crossJoin(own.select("chunk_id", "text", "n_tokens"))
        return every.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"), F.col("text").alias("chosen"), F.sum("n_tokens").over(order).cast("int").alias("used"), F.lit("corpus").alias("part"))
    last = recent_turns(turns)
    found = within_budget(rescore(hits.join(last.select("chunk_id"), "chunk_id", "left_anti"), now), budget).withColumn("part", F.lit("memory"))
    listed = last.groupBy().agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn_no", "chunk_id", "text"))).alias("t"))  # RECENT turns of each open conversation
    recent = hits.select("query_id").distinct().join(F.broadcast(listed)).select("query_id", F.posexplode("t").alias("i", "r"))
    recent = recent.select("query_id", "r.chunk_id", (F.col("i") + 1).alias("rank"), F.col("r.text").alias("chosen"), F.lit(0).alias("used"), F.lit("recent").alias("part"))
    return recent.unionByName(found)
