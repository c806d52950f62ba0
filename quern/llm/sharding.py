"""Operator 9: contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = 8 << 20, n_shards: int | None = None) -> DataFrame:
    """(id_col, n_bytes, byte_start, shard) of every row of df, in the order of id (nulls first), then size.

    byte_start is the sum of the sizes before the row; the range [0, total) is cut into n_shards equal parts (by default so many
    that a part has target_bytes at most), and a row belongs to the part in which it starts. So a shard is a contiguous run of rows, and off
    its equal share by less than the largest text. A null text has 0 bytes; rows of no bytes at the very end belong to the last
    shard. Rows with the same id are ordered by size, then text hash; repeated rows are interchangeable. Other columns are ignored; an
    empty table gives no rows.

    Only ids and sizes are exchanged, once, by range; the sums of the partitions then meet on the driver (one number each), and each partition
    adds its own prefix sums to the sum before it.
    """
    spark = ensure_importable(df.sparkSession)
    text = df[text_col].cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), size.alias("n_bytes"), F.xxhash64(text).alias("row"))
    keys = [F.col("id").asc_nulls_first(), F.col("n_bytes").asc(), F.col("row").asc()]
    rows = checkpointed(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).drop("row"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(b.column(1).to_numpy().sum()) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total])], names=["part", "total"])

    parts = {r.part: r.total for r in rows.mapInArrow(totals, "part int, total bigint").collect()}
    whole = sum(parts.values())
    n = n_shards or max(1, -(-whole // target_bytes))
    before, at = {}, 0
    for p in sorted(parts):
        before[p] = at
        at += parts[p]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = before[TaskContext.get().partitionId()]
        for batch in batches:
            b = batch.column(1).to_numpy()
            first = start + np.cumsum(b) - b
            lo = min(n - 1, int(first[0]) * n // whole) if whole and len(b) else 0
            hi = min(n - 1, int(first[-1]) * n // whole) if whole and len(b) else 0
            cuts = np.array([-(-k * whole // n) for k in range(lo + 1, hi + 1)], np.int64)
            part = lo + np.searchsorted(cuts, first, side="right")
            start += int(b.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first), pa.array(part.astype(np.int64))], names=["id", "n_bytes", "byte_start", "shard"])

    return rows.mapInArrow(assign, f"id {kind}, n_bytes bigint, byte_start bigint, shard bigint").withColumnRenamed("id", id_col)


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """df as Parquet below path, a folder for each shard, rows in order of id. Options: see shard.

    Ids name the rows here: a null or repeated id, and a column named shard, are a ValueError, before anything is written; so there are no ties. Null and empty texts have 0
    bytes, other columns are kept, whatever their names; long texts are written whole. An empty table writes no shard. A path that exists is an error.
    """
    if "shard" in df.columns:
        raise ValueError("the table has a column named shard")
    plan = shard(df, id_col, text_col, **options).select(F.col(id_col).alias("_shard_id"), F.col("shard").alias("_shard"))
    if not plan.groupBy("_shard_id").count().where("_shard_id is null or count > 1").isEmpty():
        raise ValueError(f"{id_col} has null or repeated ids")
    rows = df.join(plan, df[id_col] == plan["_shard_id"]).drop("_shard_id")
    rows.repartition("_shard").sortWithinPartitions("_shard", id_col).withColumnRenamed("_shard", "shard").write.mode("error").partitionBy("shard").parquet(path)
