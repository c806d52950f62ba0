"""What a hit needs to be read: its text, its parent window, its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, ...) with the chunk's columns and wide: the text of its parent of the same document, else its own. Hits without a chunk are dropped."""
    parent = chunks.where("kind = 'parent'").select(F.col("chunk_id").alias("_p"), F.col("doc_id").alias("_d"), F.col("text").alias("_wide"))
    full = hits.join(chunks, "chunk_id")
    return full.join(parent, (F.col("parent_id") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").withColumn("wide", F.coalesce("_wide", "text")).drop("_p", "_d", "_wide")


def backfilled(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The first k hits of each query that have a chunk, ranked anew: stale candidates make room for the next."""
    alive = hits.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return alive.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("rank") <= k)


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """(query_id, chunk_id, pos, text) of the chunks up to radius places from each hit, itself among them. An equi-join on document and place: the band is spelled out."""
    around = hits.where("kind = 'chunk' and doc_id is not null and pos is not null").select("query_id", "chunk_id", "doc_id", F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("pos"))
    own = chunks.where("kind = 'chunk'").select("doc_id", "pos", "text")
    return around.join(own, ["doc_id", "pos"]).select("query_id", "chunk_id", "pos", "text")


def stitched(hits: DataFrame, chunks: DataFrame, radius: int) -> DataFrame:
    """hits whose wide is the text of the places around, in order; hits that aren't chunks of a document stay as they are."""
    if radius == 0:
        return hits
    if not 0 < radius <= 100:
        raise ValueError("radius must lie between 0 and 100")
    near = neighbours(hits, chunks, radius).groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_near"))
    joined = F.array_join(F.transform("_near", lambda x: x["text"]), " ")
    return hits.join(near, ["query_id", "chunk_id"], "left").withColumn("wide", F.when(F.size("_near") > 0, joined).otherwise(F.col("wide"))).drop("_near")


def parent_windows(chunks: DataFrame, per_parent: int = 4) -> DataFrame:
    """(doc_id, pos, text): every per_parent consecutive chunks of a document joined; pos is the first one's place."""
    group = F.floor(F.col("pos") / per_parent).cast("int")
    rows = chunks.groupBy("doc_id", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return rows.select("doc_id", (F.col("g") * per_parent).alias("pos"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
