"""Retrieval metrics. rankings (query_id, doc_id, rank), qrels (query_id, doc_id, grade). Repeated documents take up ranks and earn nothing; queries without a positive grade have null metrics."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_importable

SEED, SAMPLES = 20260813, 10_000


def _gain(grade: Column, top: Column) -> Column:
    """(2^grade - 1) / 2^top without large powers."""
    return F.pow(F.lit(2.0), grade - top) * -F.expm1(-F.ln(F.lit(2.0)) * grade)


def metrics(rankings: DataFrame, qrels: DataFrame, recall_at: tuple[int, ...] = (5, 10, 20), mrr_at: int = 20, ndcg_at: int = 10, decimals: int = 6) -> DataFrame:
    """(query_id, recall_at_K..., mrr_at_K, ndcg_at_K) for every query of the rankings or the qrels: one join and one aggregation."""
    positive = qrels.where("grade > 0").groupBy("query_id", "doc_id").agg(F.max("grade").cast("double").alias("grade"))
    own = Window.partitionBy("query_id")
    ideal_rank = F.row_number().over(own.orderBy(F.col("grade").desc(), "doc_id"))
    labelled = positive.withColumns({"_ideal": ideal_rank, "_top": F.max("grade").over(own)})
    ideal = labelled.groupBy("query_id").agg(F.count("*").alias("_positives"), F.max("_top").alias("_top"), F.sum(F.when(F.col("_ideal") <= ndcg_at, _gain(F.col("grade"), F.col("_top")) / F.log2(F.col("_ideal") + 1))).alias("_idcg"))
    first = rankings.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = first.join(labelled.select("query_id", "doc_id", "grade", F.col("_top")), ["query_id", "doc_id"], "left")
    sums = found.groupBy("query_id").agg(
        *[F.count(F.when((F.col("grade") > 0) & (F.col("rank") <= k), 1)).alias(f"_hits_{k}") for k in recall_at],
        F.min(F.when((F.col("grade") > 0) & (F.col("rank") <= mrr_at), F.col("rank"))).alias("_first"),
        F.sum(F.when((F.col("grade") > 0) & (F.col("rank") <= ndcg_at), _gain(F.col("grade"), F.col("_top")) / F.log2(F.col("rank") + 1))).alias("_dcg"),
    )
    both = ideal.join(sums, "query_id", "full")
    has = F.col("_positives") > 0
    unit = lambda x: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), decimals)
    return both.select(
        "query_id",
        *[F.when(has, unit(F.coalesce(f"_hits_{k}", F.lit(0)) / F.col("_positives"))).alias(f"recall_at_{k}") for k in recall_at],
        F.when(has, F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), decimals)).alias(f"mrr_at_{mrr_at}"),
        F.when(has, unit(F.coalesce("_dcg", F.lit(0.0)) / F.col("_idcg"))).alias(f"ndcg_at_{ndcg_at}"),
    )


def coverage(rankings: DataFrame, facts: DataFrame, required: DataFrame, k: int = 20, decimals: int = 6) -> DataFrame:
    """(query_id, coverage): share of the required facts (query_id, fact) that documents of the first k ranks hold (facts: doc_id, fact)."""
    need = required.distinct()
    held = rankings.where(F.col("rank") <= k).join(facts.distinct(), "doc_id").select("query_id", "fact").distinct().withColumn("_has", F.lit(1))
    return need.join(held, ["query_id", "fact"], "left").groupBy("query_id").agg(F.round(F.count("_has") / F.count("*"), decimals).alias("coverage"))


def duplicate_rate(rankings: DataFrame, prints: DataFrame, k: int = 20, decimals: int = 6) -> DataFrame:
    """(query_id, duplicate_rate): pairs of equal content among all pairs of the first k ranks; documents without a fingerprint (doc_id, fingerprint) are equal to themselves alone."""
    top = rankings.where(F.col("rank") <= k).join(prints, "doc_id", "left")
    same = F.coalesce(F.concat(F.lit("f:"), F.col("fingerprint")), F.concat(F.lit("d:"), F.col("doc_id").cast("string")))
    sizes = top.groupBy("query_id", same.alias("c")).agg(F.count("*").alias("n")).groupBy("query_id").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum("n").alias("n"))
    return sizes.select("query_id", F.when(F.col("n") > 1, F.round(F.col("pairs") / (F.col("n") * (F.col("n") - 1)), decimals)).otherwise(F.lit(0.0)).alias("duplicate_rate"))


def no_answer_correct(gold: Column, predicted: Column) -> Column:
    """1 or 0 by agreement of two booleans; null where one is missing."""
    return (gold == predicted).cast("double")


def citation_precision(labels: DataFrame) -> DataFrame:
    """(query_id, citation_precision): share of supported citations (query_id, supported)."""
    return labels.groupBy("query_id").agg(F.round(F.avg(F.col("supported").cast("double")), 6).alias("citation_precision"))


def macro(per_query: DataFrame, columns: list[str], decimals: int = 6) -> DataFrame:
    """(metric, mean, support): means over the queries that have the metric."""
    row = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")
    return per_query.select(row).groupBy("m.metric").agg(F.round(F.avg("m.value"), decimals).alias("mean"), F.count("m.value").alias("support"))


def percentiles(samples: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99), decimals: int = 6) -> DataFrame:
    """Exact, linearly interpolated percentiles as columns p50, p95, ..."""
    found = F.percentile(F.col(value), F.array(*[F.lit(p) for p in points]))
    return samples.groupBy(*by).agg(found.alias("p")).select(*by, *[F.round(F.col("p")[i], decimals).alias(f"p{round(p * 100)}") for i, p in enumerate(points)])


def paired_bootstrap(pairs: DataFrame, samples: int = SAMPLES, seed: int = SEED, chunk: int = 500) -> DataFrame:
    """(n, delta, low, high): mean of b - a over (query_id, a, b) with its 95 % interval; queries are drawn with replacement.

    Pairs with a null are left out. A query pair is two numbers, so the pairs are sent to all tasks; the samples are spread over them, each chunk with its own seed.
    """
    spark = ensure_importable(pairs.sparkSession)
    rows = pairs.where("a is not null and b is not null").orderBy("query_id").select((F.col("b") - F.col("a")).alias("d")).toPandas()["d"].to_numpy(float)
    if not len(rows):
        return spark.createDataFrame([], "n bigint, delta double, low double, high double")
    sent = spark.sparkContext.broadcast(rows)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = sent.value
        for batch in batches:
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                yield pd.DataFrame({"mean": [float(d[rng.integers(0, len(d), len(d))].mean()) for _ in range(min(chunk, samples - int(i) * chunk))]})

    means = spark.range(-(-samples // chunk)).mapInPandas(draw, "mean double")
    ends = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(ends.alias("p")).select(F.lit(len(rows)).cast("bigint").alias("n"), F.lit(float(rows.mean())).alias("delta"), F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def weighted_percentile(values: np.ndarray, times: np.ndarray, point: float) -> float:
    """np.percentile of sorted values, each repeated so many times."""
    ends = np.cumsum(times)
    at = point * (int(ends[-1]) - 1)
    low = int(at)
    a, b = values[np.searchsorted(ends, [low, min(low + 1, int(ends[-1]) - 1)], side="right")]
    return float(a + (b - a) * (at - low))


def clustered_percentile(samples: DataFrame, cluster: str, value: str, point: float = 0.95, draws: int = SAMPLES, seed: int = SEED, chunk: int = 100) -> DataFrame:
    """(point, low, high): a percentile of value with its 95 % interval; whole clusters (a query with all its repetitions) are drawn with replacement."""
    spark = ensure_importable(samples.sparkSession)
    rows = samples.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v")).orderBy(cluster).select("v").collect()
    groups = [np.array(r.v) for r in rows]
    if not groups:
        return spark.createDataFrame([], "point double, low double, high double")
    # a draw weights the sorted values by how often their cluster is drawn: nothing is joined or sorted for each draw
    joined = np.concatenate(groups)
    order = np.argsort(joined, kind="stable")
    sent = spark.sparkContext.broadcast((joined[order], np.repeat(np.arange(len(groups)), [len(g) for g in groups])[order], len(groups)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, owner, n = sent.value
        for batch in batches:
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                yield pd.DataFrame({"q": [weighted_percentile(values, np.bincount(rng.integers(0, n, n), minlength=n)[owner], point) for _ in range(min(chunk, draws - int(i) * chunk))]})

    qs = spark.range(-(-draws // chunk)).mapInPandas(draw, "q double")
    whole = float(np.percentile(np.concatenate(groups), point * 100))
    return qs.agg(F.percentile("q", F.array(F.lit(0.025), F.lit(0.975))).alias("p")).select(F.lit(whole).alias("point"), F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def stage_report(stages: DataFrame, qrels: DataFrame) -> DataFrame:
    """(stage, query_id, candidates, duplicates, recall) of stages (stage, query_id, doc_id, rank)."""
    positive = qrels.where("grade > 0").select("query_id", "doc_id").distinct()
    total = positive.groupBy("query_id").agg(F.count("*").alias("_n"))
    hit = positive.withColumn("_hit", F.lit(1))
    rows = stages.join(hit, ["query_id", "doc_id"], "left").groupBy("stage", "query_id").agg(F.count("*").alias("candidates"), (F.count("*") - F.countDistinct("doc_id")).alias("duplicates"), F.countDistinct(F.when(F.col("_hit") == 1, F.col("doc_id"))).alias("_found"))
    return rows.join(total, "query_id", "left").select("stage", "query_id", "candidates", "duplicates", F.round(F.col("_found") / F.col("_n"), 6).alias("recall"))


def lineage_violations(stages: DataFrame, order: list[str], limits: dict[str, int] | None = None) -> DataFrame:
    """(stage, query_id, violation, n): candidates that the stage before didn't have, repeated candidates, and more than the stage's limit."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    rows = stages.withColumn("_at", place)
    before = rows.select("query_id", "doc_id", (F.col("_at") + 1).alias("_at")).distinct()
    invented = rows.where("_at > 1").join(before, ["query_id", "doc_id", "_at"], "left_anti").groupBy("stage", "query_id").agg(F.lit("invented").alias("violation"), F.countDistinct("doc_id").alias("n"))
    repeated = rows.groupBy("stage", "query_id", "doc_id").count().where("count > 1").groupBy("stage", "query_id").agg(F.lit("repeated").alias("violation"), F.sum(F.col("count") - 1).alias("n"))
    out = invented.unionByName(repeated)
    for stage, most in (limits or {}).items():
        over = rows.where(F.col("stage") == stage).groupBy("stage", "query_id").agg(F.lit("too many").alias("violation"), (F.count("*") - most).alias("n")).where("n > 0")
        out = out.unionByName(over)
    return out


def hash_sample(df: DataFrame, id_col: str, n: int, seed: str = "0") -> DataFrame:
    """n rows in the order of the SHA-256 of seed and id: the same rows whatever the partitions."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), id_col).limit(n)


def canonical_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, allow_nan=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def write_report(value, path: str) -> None:
    """Strict JSON, complete or not at all: it is written beside its place and moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".json")
    try:
        with os.fdopen(handle, "w") as f:
            json.dump(value, f, sort_keys=True, indent=2, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


class Protocol:
    """Calibration, validation and test splits that can't be mixed up: the validation run fixes configuration and data by their hash, and the test runs only under that hash."""

    SPLITS = ("calibration", "validation", "test")

    def __init__(self):
        self.locked: str | None = None

    def run(self, split: str, configuration: dict, query_ids: list[str]) -> str:
        if split not in self.SPLITS:
            raise ValueError(f"split must be one of {self.SPLITS}")
        own = canonical_hash({"configuration": configuration})
        if split == "validation":
            if self.locked not in (None, own):
                raise ValueError("validation has run with another configuration")
            self.locked = own
        if split == "test" and self.locked != own:
            raise ValueError("the test split runs only with the validated configuration")
        return canonical_hash({"split": split, "configuration": own, "queries": sorted(query_ids)})


def throughput(completed: int, seconds: float, failures: int = 0, least: int = 30) -> dict:
    """Queries a second, and why the figure can't be claimed, if so."""
    reasons = [r for r, bad in (("too few queries", completed < least), ("failures", failures > 0), ("no time passed", seconds <= 0)) if bad]
    return {"qps": completed / seconds if seconds > 0 else None, "eligible": not reasons, "reasons": reasons}
