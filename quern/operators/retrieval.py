"""The two search pipelines over a batch of queries, as one plan each: channels, fusion, structural rerank, reranker, diversity, hydration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import text as T
from ..functions import vectors as V
from ..session import checkpointed
from . import diversity as D
from . import fusion as U
from . import hydrate as H
from . import search as S

LIMITS = {"k": 100, "channel_k": 1000, "structural_depth": 1000, "rerank_pool": 1000, "diversity_pool": 1000, "stitch_radius": 100, "rrf_k": 1_000_000}


@dataclass(frozen=True)
class Config:
    """Settings of a search. diversity_method: none, mmr, dpp, or fermionic (the legacy choice, by `diversity`)."""

    k: int = 10
    channel_k: int = 100
    fusion: str = "quantum"
    weights: dict = field(default_factory=lambda: {"dense": 1.0, "sparse": 0.8, "structural": 0.9})
    strength: float = 1.0
    coherence_strength: float = 0.0
    rrf_k: int = 60
    structural: bool = True
    structural_depth: int = 100
    structural_weight: float = 1.0
    binary: bool = False
    mode: str = "exact"  # of the dense channel: exact, or two-phase by "full", "bands" or "auto"
    rerank_pool: int = 30
    diversity_method: str = "none"
    diversity_pool: int = 40
    diversity: float = 0.35
    mmr_lambda: float = 0.5
    dpp_alpha: float = 1.0
    stitch_radius: int = 0
    filters: S.Filters = S.Filters()

    def __post_init__(self):
        for name, most in LIMITS.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most:
                raise ValueError(f"{name} must be a whole number up to {most}")
        for name, known in (("fusion", ("quantum", "rrf")), ("mode", ("exact", "full", "bands", "auto")), ("diversity_method", ("none", "mmr", "dpp", "fermionic"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {known}")
        if not 0 <= self.diversity <= 1 or not 0 <= self.coherence_strength <= 1:
            raise ValueError("diversity and coherence_strength must lie in [0, 1]")

    @classmethod
    def of(cls, spark: SparkSession, pipeline: str = "legacy", **given) -> Config:
        """Defaults of the pipeline ("legacy" or "v2"), then settings quern.<name> of the session, then those given."""
        base = cls(diversity_method="fermionic") if pipeline == "legacy" else cls(fusion="rrf")
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"quern.{f.name}", None)
            if value is not None and f.name not in ("weights", "filters"):
                kind = type(getattr(base, f.name))
                found[f.name] = value.lower() == "true" if kind is bool else kind(value)
        return replace(base, **{**found, **given})


@dataclass
class Corpus:
    """Tables of an index (see index.SCHEMAS) and the encoder that made its vectors. Vectors without tokens (and constellation): those of the chunks that late interaction
    looks at are made from chunks' ctx."""

    docs: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    encoder: E.Encoder


@dataclass
class Found:
    """hits: a row for each query and result; views: each channel's own best; stages: what every stage left, for stage reports."""

    hits: DataFrame
    views: DataFrame
    stages: DataFrame


Rerank = Callable[[DataFrame], DataFrame]
"""Gets (query_id, chunk_id, rank, text), returns (query_id, chunk_id, rank); what it leaves out follows in the old order."""


def expanded(queries: DataFrame, expand: Callable[[str], list[str]], most: int = 10) -> DataFrame:
    """(query_id, part, text): each query with up to `most` distinct other wordings from the caller's function; if it fails the query stands alone."""

    def wordings(text: str) -> list[str]:
        try:
            other = [x.strip() for x in expand(text) if x and x.strip()]
        except Exception:  # a model's failure leaves the query as it is
            other = []
        return list(dict.fromkeys([text, *other]))[: most + 1]

    @F.arrow_udf("array<string>")
    def more(texts: pa.Array) -> pa.Array:
        return pa.array([wordings(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return queries.select("query_id", F.posexplode(more("text")).alias("part", "text"))


def encoded_queries(queries: DataFrame, encoder: E.Encoder, expand: Callable[[str], list[str]] | None = None, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """(query_id, dense, tokens) and (query_id, term, weight). Of several wordings the dense vectors are added, the greatest weights taken, the token rows put together."""
    text = T.normalize(F.col("text")) if normalize else F.col("text")
    asked = queries.select("query_id", text.alias("text")).where("text is not null and text <> ''")
    parts = expanded(asked, expand) if expand else asked.select("query_id", F.lit(0).alias("part"), "text")
    parts = parts.withColumn("_k", F.struct("query_id", "part"))
    rows = E.encode(parts, "_k", "text", encoder).select("_k.query_id", "_k.part", "dense", "tokens")
    merged = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "dense", "tokens"))).alias("p"))
    most = getattr(encoder, "max_tokens", 256)
    one = F.size("p") == 1
    dense = F.when(one, F.col("p")[0]["dense"].cast("array<double>")).otherwise(V.weighted_sum(F.transform("p", lambda x: x["dense"])))
    tokens = F.slice(F.flatten(F.transform("p", lambda x: x["tokens"])), 1, most)
    terms = E.postings(parts, "_k", "text").groupBy("_k.query_id", "term").agg(F.max("weight").alias("weight"))
    return merged.select("query_id", dense.alias("dense"), tokens.alias("tokens")), terms


def _channels(q: DataFrame, terms: DataFrame, corpus: Corpus, c: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    dims = corpus.encoder.dense_dim
    universe = corpus.chunks.where(F.col("kind").isin(*S.SEARCHABLE)).select("chunk_id")
    scope = S.in_scope(corpus.chunks, c.filters, corpus.docs).select("chunk_id")
    own = corpus.vectors.join(scope, "chunk_id", "left_semi")
    if c.mode == "exact":
        dense = S.dense_topk(q.select("query_id", F.col("dense").alias("v")), own.select("chunk_id", F.col("dense").alias("v")), c.channel_k, dims)
    else:
        signed = q.select("query_id", "dense", E.signature(F.col("dense"), dims).alias("sig"))
        dense = S.two_phase_topk(signed, own.select("chunk_id", "sig", "codes"), c.channel_k, E.SIGNATURE_BITS // 64, mode=c.mode)
    sparse = S.sparse_topk(terms, corpus.postings, universe, c.channel_k, scope)
    return dense, sparse, own


def _structural(q: DataFrame, own: DataFrame, pool: DataFrame, k: int, corpus: Corpus, binary: bool) -> DataFrame:
    if "tokens" not in own.columns:
        if binary:
            raise ValueError("binary late interaction needs vectors with a constellation")
        met = corpus.chunks.join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi").where("ctx is not null")
        return S.maxsim_topk(q, met.select("chunk_id", F.col("ctx").alias("tokens")), pool, k, encode=corpus.encoder.tokens)
    if binary:
        signed = q.select("query_id", E.token_signatures(F.col("tokens"), corpus.encoder.token_dim).alias("tokens"))
        return S.maxsim_topk(signed, own.select("chunk_id", F.col("constellation").alias("tokens")), pool, k, binary=True)
    return S.maxsim_topk(q, own.select("chunk_id", "tokens"), pool, k)


def _stage(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("stage"), "query_id", F.col("chunk_id").alias("doc_id"), "rank")


def _reranked(ranked: DataFrame, corpus: Corpus, pool: int, rerank: Rerank) -> DataFrame:
    seen = ranked.where(F.col("rank") <= pool).join(corpus.chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "rank", "text")
    return U.reconcile(ranked, rerank(seen))


def _diverse(ranked: DataFrame, corpus: Corpus, c: Config, relevance) -> DataFrame:
    v = corpus.vectors.select("chunk_id", F.col("dense").alias("v"))
    rows = ranked.where(F.col("rank") <= max(c.k, c.diversity_pool)).select("query_id", "chunk_id", "rank", relevance.alias("score")).join(v, "chunk_id", "left")
    options = {"fermionic": {"diversity": c.diversity}, "mmr": {"mmr_lambda": c.mmr_lambda}, "dpp": {"dpp_alpha": c.dpp_alpha}}[c.diversity_method]
    return D.diversify(rows, c.k, c.diversity_method, max(c.k, c.diversity_pool), **options)


def search_legacy(queries: DataFrame, corpus: Corpus, config: Config | None = None, expand: Callable[[str], list[str]] | None = None, rerank: Rerank | None = None) -> Found:
    """Three fused channels (dense, sparse, structural over the union of both), then reranker, then fermionic selection where more than k are left."""
    c = config or Config.of(queries.sparkSession)
    q, terms = encoded_queries(queries, corpus.encoder, expand, normalize=False)
    q = checkpointed(q)
    dense, sparse, own = _channels(q, terms, corpus, c)
    # rankings of a batch of queries are small and each is read several times: they are written instead of searched for again
    dense, sparse = checkpointed(dense), checkpointed(sparse)
    both = U.with_channel(dense, "dense").unionByName(U.with_channel(sparse, "sparse"))
    pool = U.candidate_union(both)
    structural = _structural(q, own, pool, c.channel_k, corpus, c.binary)
    channels = both.unionByName(U.with_channel(structural, "structural"))
    diverse = c.diversity_method != "none" and c.diversity > 0
    depth = max(c.k, c.rerank_pool if rerank else 0, c.diversity_pool if diverse else 0)
    channels = checkpointed(channels)
    fused = U.fuse(channels, c.weights, depth, c.fusion, c.strength, c.rrf_k, c.coherence_strength, decimals=6)
    fused = checkpointed(fused.select("query_id", "chunk_id", "score", "rank"))
    ranked = _reranked(fused, corpus, c.rerank_pool, rerank) if rerank else fused
    final = ranked.select("query_id", "chunk_id", "score", "rank")
    if diverse:
        many = final.groupBy("query_id").agg(F.count("*").alias("_n")).where(F.col("_n") > c.k).select("query_id")
        few = final.join(many, "query_id", "left_anti")
        final = _diverse(final.join(many, "query_id", "left_semi"), corpus, c, F.col("score")).unionByName(few)
    final = checkpointed(final)
    hits = H.stitched(H.with_parents(final.where(F.col("rank") <= c.k), corpus.chunks), corpus.chunks, c.stitch_radius)
    stages = _stage("dense", dense).unionByName(_stage("sparse", sparse)).unionByName(_stage("fusion", fused)).unionByName(_stage("final", final.where(F.col("rank") <= c.k)))
    return Found(hits, channels.where(F.col("rank") <= c.k), stages)


def search_v2(queries: DataFrame, corpus: Corpus, config: Config | None = None, expand: Callable[[str], list[str]] | None = None, rerank: Rerank | None = None) -> Found:
    """Two generators, fusion, structural rerank of the best, reranker, selection, hydration with backfill. The result's score is 1 / rank; fusion_score and fusion_rank stay."""
    c = config or Config.of(queries.sparkSession, "v2")
    q, terms = encoded_queries(queries, corpus.encoder, expand)
    q = checkpointed(q)
    dense, sparse, own = _channels(q, terms, corpus, c)
    dense, sparse = checkpointed(dense), checkpointed(sparse)
    channels = U.with_channel(dense, "dense").unionByName(U.with_channel(sparse, "sparse"))
    depth = max(2 * c.k, c.structural_depth if c.structural else 0, c.rerank_pool if rerank else 0, c.diversity_pool if c.diversity_method != "none" else 0)
    weights = {} if c.fusion == "rrf" else {x: c.weights.get(x, 1.0) for x in ("dense", "sparse")}
    fused = U.fuse(channels, weights, min(depth, 1000), c.fusion, c.strength, c.rrf_k, 0.0 if c.fusion == "rrf" else c.coherence_strength, decimals=9)
    fused = checkpointed(fused)
    ranked = fused.select("query_id", "chunk_id", F.col("score").alias("fusion_score"), "rank", F.col("rank").alias("fusion_rank"))
    if c.structural and c.structural_weight > 0:
        head = fused.where(F.col("rank") <= c.structural_depth).select("query_id", "chunk_id")
        ranked = U.structural_blend(ranked.drop("fusion_rank"), _structural(q, own, head, c.structural_depth, corpus, c.binary), c.structural_weight, c.rrf_k)
    if rerank or c.diversity_method != "none":
        ranked = checkpointed(ranked)
    if rerank:
        ranked = _reranked(ranked, corpus, c.rerank_pool, rerank)
    if c.diversity_method != "none":
        size = F.least(F.lit(max(c.k, c.diversity_pool)), F.count("*").over(Window.partitionBy("query_id")))
        pooled = ranked.withColumn("_n", size)
        picked = _diverse(pooled.where(F.col("rank") <= F.col("_n")), corpus, c, (F.col("_n") - F.col("rank") + 1) / F.col("_n"))
        ranked = U.reconcile(ranked, picked)
    final = checkpointed(H.backfilled(ranked, corpus.chunks, c.k).withColumn("score", 1 / F.col("rank")))
    wide = H.with_parents(final, corpus.chunks)
    filtered = c.filters != S.Filters()
    hits = wide if filtered else H.stitched(wide, corpus.chunks, c.stitch_radius)  # neighbours may lie outside the filters
    stages = _stage("dense", dense).unionByName(_stage("sparse", sparse)).unionByName(_stage("fusion", fused)).unionByName(_stage("ranked", ranked)).unionByName(_stage("final", final))
    return Found(hits, channels.where(F.col("rank") <= c.k), stages)


def plan_of(df: DataFrame) -> str:
    """The physical plan, without running it."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
