"""Operator 6: mixing sources to target weights by temperature.

Weights are the sources' token shares raised to an exponent, found by bisection so that the mixture has a target entropy or no
source is repeated more than a limit. They are realised as block permutations: a source's documents fall into blocks by hash; every epoch
orders the blocks anew; whole epochs take all blocks, the last one takes blocks in its order up to the source's
token budget, and of the block at the border the documents first in hash order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable

#: Decision tables up to this size go to the rows; larger ones are joined by Spark's own choice.
BROADCAST_BYTES = 32 << 20
_WHOLE = 2**63 - 1
MOST_EXPONENT = 64.0


def word_count(text: Column) -> Column:
    """Tokens as this operator counts them: runs of visible characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: float
    weights: dict  # by source: share of the mixture
    epochs: dict  # by source: how often its tokens are used


def _entropy(w: dict) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


def solve(tokens: dict, budget: float | None = None, repetition_limit: float | None = 2.0, entropy: float | None = None, keep_all: bool = False) -> Mixture:
    """The mixture of sources with so many tokens.

    entropy (nats): the exponent (0 to MOST_EXPONENT) whose weights have it. Otherwise repetition_limit: the smallest exponent in [0, 1] at which no source is used more
    often than that; above 1 large sources are repeated more. A target that no exponent meets is a ValueError. budget: tokens of the mixture, by default
    all there are. keep_all: the least budget that uses every source once at least. Sources without tokens have weight 0; without any tokens there is nothing to meet.
    """
    size = {s: float(t) for s, t in tokens.items() if t and t > 0}
    if not size:
        return Mixture(1.0, 0.0, {s: 0.0 for s in tokens}, {s: 0.0 for s in tokens})
    total, top = sum(size.values()), max(size.values())

    def at(a: float) -> tuple[dict, float]:
        raw = {s: (t / top) ** a for s, t in size.items()}
        z = math.fsum(raw.values())
        w = {s: x / z for s, x in raw.items()}
        return w, (max(t / w[s] for s, t in size.items()) if keep_all else float(total if budget is None else budget))

    def high(a: float) -> bool:
        """Whether the exponent may be smaller."""
        w, b = at(a)
        if entropy is not None:
            return _entropy(w) <= entropy + 1e-12
        return max(w[s] * b / t for s, t in size.items()) <= (repetition_limit or math.inf) * (1 + 1e-12)

    lo, hi = 0.0, 1.0
    while entropy is not None and not high(hi) and hi < MOST_EXPONENT:
        hi *= 2
    if entropy is not None and _entropy(at(lo)[0]) < entropy - 1e-9:
        raise ValueError(f"no mixture of {len(size)} sources has an entropy of {entropy}: the most is {_entropy(at(lo)[0]):.6f}")
    if not high(hi):
        raise ValueError(f"no exponent meets entropy={entropy}, repetition_limit={repetition_limit}, budget={budget}: the nearest mixture has entropy {_entropy(at(hi)[0]):.6f} and uses sources up to {max(at(hi)[0][s] * at(hi)[1] / t for s, t in size.items()):.6f} times")
    if high(lo):
        hi = lo
    else:
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if high(mid) else (mid, hi)
    w, b = at(hi)
    return Mixture(hi, b, {s: w.get(s, 0.0) for s in tokens}, {s: w[s] * b / size[s] if s in size else 0.0 for s in tokens})


def _rows(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    text = df[text_col].cast("string")
    row = F.xxhash64(F.lit(seed), df[id_col], F.xxhash64(text))
    return df.select(df[id_col].alias("id"), df[source_col].alias("src"), word_count(text).alias("tokens"), row.alias("h"), F.xxhash64(row).alias("h2")).where("tokens > 0")


def _small(df: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def _running(blocks: DataFrame, order: Column) -> DataFrame:
    """blocks with start: the sum of the sizes of its source's and epoch's blocks before it in the order. Sums run over range partitions, as in sharding: a
    source's blocks needn't meet in one task; one number for each partition goes to the driver, one for each source and epoch back to the rows."""
    spark = blocks.sparkSession
    keys = [F.col("src"), F.col("epoch"), F.col("turn"), F.col("block")]
    rows = blocks.withColumn("turn", order)
    rows = checkpointed(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).drop("turn"))
    at = rows.columns.index("size")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(b.column(at).to_numpy().sum()) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total])], names=["part", "total"])

    before, so_far = {}, 0
    for r in sorted(rows.mapInArrow(totals, "part int, total bigint").collect()):
        before[r.part] = so_far
        so_far += r.total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = before[TaskContext.get().partitionId()]
        for b in batches:
            size = b.column(at).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start + np.cumsum(size) - size)], names=[*b.schema.names, "place"])
            start += int(size.sum())

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = checkpointed(rows.mapInArrow(add, f"{kinds}, place bigint"))
    first = placed.groupBy(F.col("src").alias("of"), F.col("epoch").alias("then")).agg(F.min("place").alias("first"))
    return placed.join(_small(first, first.count(), 48), F.col("src").eqNullSafe(F.col("of")) & (F.col("epoch") == F.col("then"))).withColumn("start", F.col("place") - F.col("first")).drop("of", "then", "first", "place")


def _decisions(rows: DataFrame, seed: int, block_tokens: int, **target) -> tuple[Mixture, DataFrame, DataFrame, int]:
    """The mixture; (src, blocks) of every source; (src, block, epoch, cut, progress): rows of the block with h2 <= cut are taken in the epoch; its rows."""
    spark = ensure_importable(rows.sparkSession)
    totals = {r.src: r.t for r in rows.groupBy("src").agg(F.sum("tokens").alias("t")).collect()}
    mix = solve(totals, **target)
    kind = rows.schema["src"].dataType.simpleString()
    table = [(s, max(1, math.ceil(t / block_tokens)), float(t), mix.weights[s] * mix.budget, math.floor(mix.epochs[s] + 1e-9)) for s, t in totals.items()]
    sources = spark.createDataFrame(table, f"src {kind}, blocks long, total double, want double, whole long")
    named = rows.join(_small(sources, len(table), 64).withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("h", "blocks"))
    blocks = named.groupBy("src", "block").agg(F.sum("tokens").alias("size"), F.first("total").alias("total"), F.first("want").alias("want"), F.first("whole").alias("whole"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    blocks = _running(blocks, F.xxhash64(F.lit(seed), "epoch", "block"))
    left = F.when(F.col("epoch") < F.col("whole"), F.col("total")).otherwise(F.col("want") - F.col("whole") * F.col("total") + 1e-6)
    blocks = checkpointed(blocks.withColumn("left", left).where("start < left"))
    border = blocks.where("start + size > left")
    inside = rows.join(_small(sources.select(F.col("src").alias("s"), "blocks"), len(table), 64), F.col("src").eqNullSafe(F.col("s"))).withColumn("block", F.pmod("h", "blocks"))
    edge = border.select(F.col("src").alias("bs"), F.col("block").alias("bb"), "start", "left")
    inside = inside.join(_small(edge, len(table), 64), F.col("src").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
    taken = inside.withColumn("end", F.col("start") + F.sum("tokens").over(Window.partitionBy("src").orderBy("h2"))).where("end <= left")
    cuts = taken.groupBy("src").agg(F.max("h2").alias("cut")).select(F.col("src").alias("cs"), "cut")
    out = blocks.where("start + size <= left").withColumn("cut", F.lit(_WHOLE)).unionByName(border.join(_small(cuts, len(table), 64), F.col("src").eqNullSafe(F.col("cs"))).drop("cs"))
    out = out.select("src", "block", "epoch", "cut", ((F.col("epoch") * F.col("total") + F.col("start")) / F.col("want")).alias("progress"))
    out = checkpointed(out)
    return mix, sources.select("src", "blocks"), out, out.count()


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_tokens: int = 100_000, seed: int = 11, **target) -> DataFrame:
    """(id_col, source_col, tokens, epoch, block, progress): the documents of the mixture, one row for each time that a document is used.

    progress (0 to 1) is the share of its source's budget that is used before its block; sorted by it, every prefix of the result
    holds the sources in about the target weights. Options of target: see solve. Each source's tokens stay within its budget.

    A null source is a source of its own. Rows with a null text and texts without tokens are left out. Rows with the same id and
    text are taken together. Null ids are kept; other columns are ignored; an empty table gives no rows. All sources and texts are counted whole.
    """
    rows = checkpointed(_rows(df, id_col, source_col, text_col, seed))
    _, sources, cuts, n = _decisions(rows, seed, block_tokens, **target)
    out = _apply(rows, "src", "h", "h2", sources, cuts, n, "tokens")
    return out.select(F.col("id").alias(id_col), F.col("src").alias(source_col), "tokens", "epoch", F.col("q_block").alias("block"), "progress")


def _apply(rows: DataFrame, src: str, h: str, h2: str, sources: DataFrame, cuts: DataFrame, n: int, tokens: str) -> DataFrame:
    named = sources.select(F.col("src").alias("q_src"), F.col("blocks").alias("q_blocks"))
    rows = rows.join(_small(named, named.count(), 64), F.col(src).eqNullSafe(F.col("q_src"))).withColumn("q_at", F.pmod(h, "q_blocks"))
    cuts = cuts.select(F.col("src").alias("q_of"), F.col("block").alias("q_block"), "epoch", "cut", "progress")
    return rows.join(_small(cuts, n, 80), F.col("q_src").eqNullSafe(F.col("q_of")) & (F.col("q_at") == F.col("q_block")) & (F.col(h2) <= F.col("cut")) & (F.col(tokens) > 0))


def mix_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_tokens: int = 100_000, seed: int = 11, **target) -> DataFrame:
    """The rows of df that mix takes, as often as it takes them, with all their columns. Documents aren't exchanged as long as the table of blocks
    (80 bytes a block of block_tokens) stays below BROADCAST_BYTES; beyond, Spark joins by source and block.

    Nulls, empty texts and tables, repeated rows, ties and targets that can't be met: as in mix and solve. Texts are counted whole, and columns of df may have any names.
    """
    rows = checkpointed(_rows(df, id_col, source_col, text_col, seed))
    _, sources, cuts, n = _decisions(rows, seed, block_tokens, **target)
    text = F.col("q_doc")[text_col].cast("string")
    row = F.xxhash64(F.lit(seed), F.col("q_doc")[id_col], F.xxhash64(text))
    docs = df.select(F.struct("*").alias("q_doc"))
    docs = docs.select("q_doc", F.col("q_doc")[source_col].alias("q_source"), row.alias("q_h"), F.xxhash64(row).alias("q_h2"), F.when(text.rlike(r"\S"), 1).otherwise(0).alias("q_some"))
    return _apply(docs, "q_source", "q_h", "q_h2", sources, cuts, n, "q_some").select("q_doc.*")
