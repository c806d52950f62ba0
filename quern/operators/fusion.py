"""Fusion of ranked channels: rankings are (query_id, channel, chunk_id, score, rank), one row for each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

_CHANNEL = ("query_id", "channel")


def with_channel(ranked: DataFrame, name: str) -> DataFrame:
    settle(ranked.sparkSession)
    return ranked.select("query_id", F.lit(name).alias("channel"), "chunk_id", "score", "rank")


def sanitized(rankings: DataFrame) -> DataFrame:
    """Finite scores only, each candidate once (its first rank), ranks without gaps."""
    first = Window.partitionBy(*_CHANNEL, "chunk_id").orderBy("rank")
    fine = rankings.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    once = fine.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*_CHANNEL).orderBy("rank")))


def normalized(rankings: DataFrame) -> DataFrame:
    """rankings with norm (min-max within the channel, 1 where all scores are equal up to 1e-12) and phase (0 for the first to pi for the last)."""
    own = Window.partitionBy(*_CHANNEL)
    lo, hi, n = F.min("score").over(own), F.max("score").over(own), F.count("*").over(own)
    out = sanitized(rankings).withColumns({"_lo": lo, "_hi": hi, "_n": n})
    scale = F.greatest(F.abs("_lo"), F.abs("_hi"), F.lit(1.0))  # differences of scaled scores can't overflow
    span = F.col("_hi") / scale - F.col("_lo") / scale
    norm = F.when(F.col("_hi") - F.col("_lo") < 1e-12, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") / scale - F.col("_lo") / scale) / span)))
    phase = F.when(F.col("_n") > 1, F.pi() * (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return out.withColumns({"norm": norm, "phase": phase}).drop("_lo", "_hi", "_n")


def coherence(norm: DataFrame) -> DataFrame:
    """(query_id, channel, kappa): how peaked the channel's positive normalised scores are, 0 (flat, or less than three) to 1."""
    positive = F.when(F.col("norm") > 0, F.col("norm"))
    sums = norm.groupBy(*_CHANNEL).agg(F.count(positive).alias("n"), F.sum(positive).alias("s"), F.sum(positive * positive).alias("s2"))
    purity = (F.col("s2") / (F.col("s") * F.col("s")) * F.col("n") - 1) / (F.col("n") - 1)
    return sums.select(*_CHANNEL, F.when(F.col("n") > 2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), purity))).otherwise(F.lit(0.0)).alias("kappa"))


def weight_of(weights: dict[str, float]) -> Column:
    """The channel's weight; channels without one weigh 1."""
    if any(w < 0 or w != w or w == float("inf") for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))])[F.col("channel")], F.lit(1.0))


def weighted(norm: DataFrame, weights: dict[str, float], coherence_strength: float = 0.0) -> DataFrame:
    """norm with the column weight; with a strength above 0, channels that are more decided for the query weigh more."""
    if not 0 <= coherence_strength <= 1:
        raise ValueError("coherence_strength must lie in [0, 1]")
    out = norm.withColumn("weight", weight_of(weights))
    if coherence_strength == 0:
        return out
    best = F.max("kappa").over(Window.partitionBy("query_id"))
    factor = F.when(best > 0, (1 - coherence_strength) + coherence_strength * F.col("kappa") / best).otherwise(F.lit(1.0))
    return out.join(coherence(norm).select(*_CHANNEL, factor.alias("_f")), list(_CHANNEL)).withColumn("weight", F.col("weight") * F.col("_f")).drop("_f")


def _best(scored: DataFrame, k: int, decimals: int | None) -> DataFrame:
    if decimals is not None:
        scored = scored.withColumn("score", F.round("score", decimals) + 0.0)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantum_fuse(rankings: DataFrame, weights: dict[str, float], k: int, strength: float = 1.0, coherence_strength: float = 0.0, decimals: int | None = None) -> DataFrame:
    """(query_id, chunk_id, classical, interference, score, per_channel, channels, rank).

    A channel gives amplitude sqrt(weight x norm) and a phase by rank. The pairwise terms 2 a b cos(p - q) need no self-join: their sum is the squared
    length of the added amplitudes less the sum of their squares. A channel's worst candidate has norm 0: it stays a candidate, but the channel adds nothing.
    """
    w = weighted(normalized(rankings), weights, coherence_strength)
    some = F.col("norm") > 0
    a2 = F.when(some, F.col("weight") * F.col("norm")).otherwise(F.lit(0.0))
    x, y = F.sqrt(a2) * F.cos("phase"), F.sqrt(a2) * F.sin("phase")
    shared = F.when(some, F.struct("channel", "norm"))
    sums = w.groupBy("query_id", "chunk_id").agg(F.sum(a2).alias("classical"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.count(shared).alias("_n"), F.array_sort(F.collect_list(shared)).alias("_c"))
    wave = F.when(F.col("_n") > 1, F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") - F.col("classical")).otherwise(F.lit(0.0))
    out = sums.withColumn("interference", wave).withColumn("score", F.col("classical") + strength * F.col("interference"))
    out = out.select("query_id", "chunk_id", "classical", "interference", "score", F.map_from_entries("_c").alias("per_channel"), F.transform("_c", lambda c: c["channel"]).alias("channels"))
    return _best(out, k, decimals)


def combsum(rankings: DataFrame, weights: dict[str, float], k: int, decimals: int | None = None) -> DataFrame:
    return quantum_fuse(rankings, weights, k, strength=0.0, decimals=decimals)


def rrf_fuse(rankings: DataFrame, weights: dict[str, float], k: int, rrf_k: int = 60, coherence_strength: float = 0.0, decimals: int | None = None) -> DataFrame:
    """Sum of weight / (rrf_k + rank). Ranks are those given: a repeated candidate takes up ranks, its first one counts."""
    raw = rankings.groupBy(*_CHANNEL, "chunk_id").agg(F.min("rank").alias("rank"))
    if coherence_strength > 0:
        own = weighted(normalized(rankings), weights, coherence_strength).select(*_CHANNEL, "weight").distinct()
        raw = raw.join(own, list(_CHANNEL))
    else:
        raw = raw.withColumn("weight", weight_of(weights))
    sums = raw.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("score"), F.array_sort(F.collect_list("channel")).alias("channels"))
    return _best(sums, k, decimals)


def fuse(rankings: DataFrame, weights: dict[str, float], k: int, method: str = "quantum", strength: float = 1.0, rrf_k: int = 60, coherence_strength: float = 0.0, decimals: int | None = None) -> DataFrame:
    if method == "quantum":
        return quantum_fuse(rankings, weights, k, strength, coherence_strength, decimals)
    if method == "rrf":
        return rrf_fuse(rankings, weights, k, rrf_k, coherence_strength, decimals)
    raise ValueError("method must be 'rrf' or 'quantum'")


def structural_blend(fused: DataFrame, structural: DataFrame, weight: float = 1.0, rrf_k: int = 60) -> DataFrame:
    """fused (query_id, chunk_id, rank) in the order of 1 / (k + fusion rank) + weight / (k + structural rank); candidates without a structural rank follow in fusion order.
    Adds fusion_rank, structural_rank, blend_score; rank is the new place."""
    if weight == 0:
        return fused.withColumns({"fusion_rank": F.col("rank"), "structural_rank": F.lit(None).cast("int"), "blend_score": F.lit(None).cast("double")})
    s = structural.select("query_id", "chunk_id", F.col("rank").alias("structural_rank"))
    out = fused.withColumnRenamed("rank", "fusion_rank").join(s, ["query_id", "chunk_id"], "left")
    out = out.withColumn("blend_score", 1 / (rrf_k + F.col("fusion_rank")) + weight / (rrf_k + F.col("structural_rank")))
    order = Window.partitionBy("query_id").orderBy(F.col("structural_rank").isNull(), F.col("blend_score").desc(), "fusion_rank", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order))


def candidate_union(rankings: DataFrame, most: int = 1000) -> DataFrame:
    """(query_id, chunk_id, place): the channels' candidates by turns, each once, up to `most` for a query."""
    first = rankings.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "channel")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.rank", "at.channel", "chunk_id")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "chunk_id", "place")


def reconcile(candidates: DataFrame, proposed: DataFrame) -> DataFrame:
    """A reranker's order (query_id, chunk_id, rank) applied to candidates: unknown ids are dropped, of a repeated one the first place counts, those that are missing follow in their old order."""
    new = proposed.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("_new"))
    order = Window.partitionBy("query_id").orderBy(F.col("_new").isNull(), "_new", "rank")
    return candidates.join(new, ["query_id", "chunk_id"], "left").withColumn("_rank", F.row_number().over(order)).drop("rank", "_new").withColumnRenamed("_rank", "rank")
