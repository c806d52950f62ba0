"""An inverted-file index for approximate nearest neighbours by dot product.

Centroids are fitted to a bounded sample; every vector is filed under its nearest centroid. A query looks only into the lists of its nearest
centroids, as many as a measurement against exact search says are needed for the recall that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable
from . import search as S

#: Vectors that centroids are fitted to, and queries that the number of lists is measured with.
FIT_ROWS, MEASURED = 65_536, 256
RECALL_GATE = 0.98


@dataclass
class Ivf:
    """rows (chunk_id, v, list) of all vectors that can be searched, and the centroids of the lists."""

    rows: DataFrame
    centroids: np.ndarray
    dims: int


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = x @ c.T
    return s.argmax(1), s.max(1)


def fit_centroids(x: np.ndarray, lists: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; an empty list takes the vector that is farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = [_nearest(x[at : at + S.SCORE_ROWS], c) for at in range(0, len(x), S.SCORE_ROWS)]
        own, like = np.concatenate([a for a, _ in near]), np.concatenate([b for _, b in near])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(like)[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def build(vectors: DataFrame, dims: int, lists: int | None = None, fit_rows: int = FIT_ROWS) -> Ivf:
    """An index of vectors (chunk_id, v). lists: by default the square root of the number of rows, 4096 at most. The fit takes the fit_rows vectors that are
    first by a hash of their ids; all rows are filed. Null vectors are in no list; vectors of another number of dimensions are an error."""
    spark = ensure_importable(vectors.sparkSession)
    rows = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fit_rows).select("v").toArrow()["v"].combine_chunks()
    x = S._matrix(dims)(sample)
    c = fit_centroids(x, lists or max(1, min(4096, round(n**0.5)))) if len(x) else np.zeros((1, dims))
    sent = spark.sparkContext.broadcast(c)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = S._matrix(dims)
        for b in batches:
            for at in range(0, b.num_rows, S.SCORE_ROWS):
                part = b.slice(at, S.SCORE_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_nearest(read(part.column(1)), sent.value)[0].astype(np.int32))], names=["chunk_id", "v", "list"])

    filed = rows.mapInArrow(file, "chunk_id bigint, v array<double>, list int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Ivf(checkpointed(filed.repartitionByRange(parts, "list", "chunk_id").sortWithinPartitions("list", "chunk_id")), c, dims)


def search(queries: DataFrame, index: Ivf, k: int, probes: int, decimals: int = 6, query_bytes: int = S.QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank) from the lists of each query's `probes` nearest centroids. queries (query_id, v) are sent to all tasks, in blocks for which
    a task needs query_bytes; each block is a pass over the lists."""
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")
    blocks = S.query_blocks(asked, k, query_bytes, F.lit(8 * index.dims + len(index.centroids)))
    return S.top_k(reduce(DataFrame.unionByName, [_search_block(b, index, k, probes, decimals) for b in blocks]), k)


def _search_block(queries: DataFrame, index: Ivf, k: int, probes: int, decimals: int) -> DataFrame:
    got = queries.toArrow()
    dims, ids, q = index.dims, got["query_id"].to_numpy(), S._matrix(index.dims)(got["v"].combine_chunks())
    near = np.zeros((len(ids), len(index.centroids)), bool)
    for at in range(0, len(ids), S.SCORE_ROWS):
        part = np.argsort(-(q[at : at + S.SCORE_ROWS] @ index.centroids.T), axis=1, kind="stable")[:, :probes]
        np.put_along_axis(near[at : at + S.SCORE_ROWS], part, True, axis=1)
    sent = index.rows.sparkSession.sparkContext.broadcast((ids, q, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, near = sent.value
        best, read = [S._Best(len(ids[at : at + S.SCORE_ROWS]), k) for at in range(0, len(ids), S.SCORE_ROWS)], S._matrix(dims)
        for batch in batches:  # rows are sorted by list
            list_, chunk = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(list_)) + 1).tolist(), len(list_)]
            for a, b in zip(cut, cut[1:]):
                mine = near[:, list_[a]] if b > a else np.zeros(0, bool)
                for at in range(a, b if mine.any() else a, S.SCORE_ROWS):
                    end = min(b, at + S.SCORE_ROWS)
                    x = read(batch.column(1).slice(at, end - at))
                    for i, found in enumerate(best):
                        own = np.flatnonzero(mine[i * S.SCORE_ROWS : (i + 1) * S.SCORE_ROWS])
                        if len(own):
                            s = np.round(x @ q[own + i * S.SCORE_ROWS].T, decimals) + 0.0
                            r, c = np.nonzero(s >= found.floor[own][None, :])
                            found.add(own[c], chunk[at + r], s[r, c])
        for i, found in enumerate(best):
            yield found.rows(pa.array(ids[i * S.SCORE_ROWS : (i + 1) * S.SCORE_ROWS]))

    return S.in_few_tasks(index.rows).mapInArrow(run, S._BEST)


def probes_for(queries: DataFrame, index: Ivf, k: int, recall: float = RECALL_GATE) -> int:
    """The fewest lists with which the mean recall of exact search's k best is `recall`, measured with the MEASURED queries that are first by a hash of
    their ids, against all rows."""
    some = queries.where("v is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED)
    exact = S.dense_topk(some, index.rows.select("chunk_id", "v"), k, index.dims)
    hits = exact.join(index.rows.select("chunk_id", "list"), "chunk_id").select("query_id", "list").collect()
    got = some.select("query_id", F.col("v").cast("array<double>").alias("v")).toArrow()
    if not hits:
        return 1
    order = np.argsort(-(S._matrix(index.dims)(got["v"].combine_chunks()) @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    row = {i: r for r, i in enumerate(got["query_id"].to_pylist())}
    need = np.sort([place[row[h.query_id], h.list] for h in hits])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def recall_gate(found: DataFrame, exact: DataFrame, k: int, gate: float = RECALL_GATE) -> DataFrame:
    """(query_id, recall, passed) of each query, against exact search."""
    return S.recall_of(found, exact, k).withColumn("passed", F.col("recall") >= gate)
