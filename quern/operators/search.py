"""Top-k search. The unit is a batch of queries; every result is (query_id, chunk_id, score, rank), ties by ascending chunk_id.

Scores are rounded before they are ordered, so that the order doesn't depend on the last bits of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import checkpointed, ensure_importable

SEARCHABLE = ("chunk", "turn", "summary")
KINDS = (*SEARCHABLE, "parent", "rolling_summary")
#: Query rows are sent to all tasks in parts for which a task needs so many bytes; each part is a pass over the vectors.
QUERY_BYTES = 64 << 20
#: A task scores so many rows, and as many queries, at a time.
SCORE_ROWS = 1024
SCORE_CELLS = SCORE_ROWS * SCORE_ROWS
PREFETCH_FACTOR, PREFETCH_LEAST, PREFETCH_MOST = 4, 200, 1000
BAND_THRESHOLD = 20_000
#: A table up to this size goes to every task.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Filters:
    """Conditions on chunks, all of which must hold; None and empty mean no condition. metadata: equality of typed values in the documents' JSON."""

    kinds: tuple[str, ...] = SEARCHABLE
    doc_ids: tuple[int, ...] | None = None
    parent_ids: tuple[int, ...] | None = None
    sources: tuple[str, ...] | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        unknown = set(self.kinds) - set(KINDS)
        if unknown:
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        for name, most in (("doc_ids", 100), ("parent_ids", 100), ("sources", 100), ("metadata", 32)):
            if len(getattr(self, name) or ()) > most:
                raise ValueError(f"{name} holds more than {most} values")
        for key, value in self.metadata.items():
            if not isinstance(key, str) or not key.replace("_", "a").replace("-", "a").replace(".", "a").isalnum():
                raise ValueError(f"bad metadata key {key!r}")
            if value is not None and not isinstance(value, (str, bool, int, float)):
                raise TypeError(f"metadata value of {key} must be a scalar")


def metadata_equals(document: Column, key: str, value) -> Column:
    """Whether the JSON document has the value, of the same type, at the key; a missing key and bad JSON never match."""
    found = F.try_parse_json(document)
    path = f"$['{key}']"
    kind = F.schema_of_variant(F.try_variant_get(found, path, "variant"))
    if value is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(value, bool):
        want, own = "boolean", kind == "BOOLEAN"
    elif isinstance(value, str):
        want, own = "string", kind == "STRING"
    else:
        want, own = "double", kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return F.coalesce(own & (F.try_variant_get(found, path, want) == F.lit(value).cast(want)), F.lit(False))


def in_scope(chunks: DataFrame, filters: Filters, docs: DataFrame | None = None) -> DataFrame:
    """The chunks that the filters let through; docs (doc_id, source, metadata) is read only for conditions on documents."""
    out = chunks.where(F.col("kind").isin(*filters.kinds))
    if filters.doc_ids:
        out = out.where(F.col("doc_id").isin(*filters.doc_ids))
    if filters.parent_ids:
        out = out.where(F.col("parent_id").isin(*filters.parent_ids))
    if filters.sources or filters.metadata:
        if docs is None:
            raise ValueError("conditions on documents need docs")
        good = docs
        if filters.sources:
            good = good.where(F.col("source").isin(*filters.sources))
        for key, value in filters.metadata.items():
            good = good.where(metadata_equals(F.col("metadata"), key, value))
        out = out.join(good.select("doc_id"), "doc_id", "left_semi")
    return out


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """scored with rank (from 1) in each group, ranks up to k: greatest score first, then smallest chunk_id."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Best:
    """The k best rows of each of a few queries so far: of what a task has seen, only rows that can still be among them are held."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.size = 0

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.held.append((query, chunk, score))
            self.size += len(query)
        if self.size > 2 * self.k * self.n:
            self.cut()

    def meet(self, chunk: np.ndarray, s: np.ndarray, touched: np.ndarray | None = None) -> None:
        """s: a score for each chunk (down) and query (across); where not touched, there is none."""
        if self.k < len(s) and np.isneginf(self.floor).any() and not np.isnan(s).any():  # else every row of a first block is held
            seen = s if touched is None else np.where(touched, s, -np.inf)
            self.floor = np.maximum(self.floor, np.partition(seen, len(s) - self.k, axis=0)[len(s) - self.k])
        keep = s >= self.floor[None, :]
        r, c = np.nonzero(keep if touched is None else keep & touched)
        self.add(c, chunk[r], s[r, c])

    def cut(self) -> None:
        a, b, c = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((b, -c, a))
        a, b, c = a[order], b[order], c[order]
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        keep, last = rank < self.k, rank == self.k - 1
        self.floor[a[last]] = c[last]
        self.held, self.size = [(a[keep], b[keep], c[keep])], int(keep.sum())

    def rows(self, ids: pa.Array) -> pa.RecordBatch:
        self.cut()
        a, b, c = self.held[0]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(b), pa.array(c)], names=["query_id", "chunk_id", "score"])


_BEST = "query_id bigint, chunk_id bigint, score double"


def query_blocks(queries: DataFrame, k: int, query_bytes: int, held: Column) -> list[DataFrame]:
    """queries in blocks for which a task needs about query_bytes: held bytes a row, and what _Best holds of k rows for each query."""
    total, n = queries.agg(F.coalesce(F.sum(held), F.lit(0)), F.countDistinct("query_id")).first()
    blocks = max(1, -(-(total + 48 * k * n) // query_bytes))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def in_few_tasks(rows: DataFrame) -> DataFrame:
    """rows in two partitions for each core at most: every task gives k rows a query, so that the exchange doesn't grow with the number of rows."""
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)


def blocks_topk(queries: DataFrame, rows: DataFrame, k: int, read: Callable[[pa.Array], np.ndarray], score: Callable[[np.ndarray, np.ndarray], np.ndarray], query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best rows of each query. queries (query_id LONG, v), rows (chunk_id LONG, v). score(rows, queries) gives a matrix, greater is better.

    Queries are sent to all tasks, which score the rows where these are, SCORE_CELLS pairs at a time. A block of queries takes up to query_bytes in a task,
    with the k best rows of each; more of them are sent block by block, each a pass over the rows.
    """
    spark = ensure_importable(rows.sparkSession)
    rows = in_few_tasks(rows.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "v").where("v is not null"))
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "v").where("v is not null")

    def one(block: DataFrame) -> DataFrame:
        got = block.toArrow()
        v = got["v"].combine_chunks()
        sent = spark.sparkContext.broadcast((got["query_id"].to_numpy(), read(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = [_Best(len(ids[at : at + SCORE_ROWS]), k) for at in range(0, len(ids), SCORE_ROWS)]
            for batch in batches:
                for at in range(0, batch.num_rows, SCORE_ROWS):
                    x, chunk = read(batch.column(1).slice(at, SCORE_ROWS)), batch.column(0).slice(at, SCORE_ROWS).to_numpy(zero_copy_only=False)
                    for i, b in enumerate(best):
                        b.meet(chunk, score(x, q[i * SCORE_ROWS : (i + 1) * SCORE_ROWS]))
            for i, b in enumerate(best):
                yield b.rows(pa.array(ids[i * SCORE_ROWS : (i + 1) * SCORE_ROWS]))

        return rows.mapInArrow(run, _BEST)

    return top_k(reduce(DataFrame.unionByName, map(one, query_blocks(queries, k, query_bytes, 8 * F.size("v")))), k)


def _matrix(dims: int) -> Callable[[pa.Array], np.ndarray]:
    def read(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)

    return read


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, dims: int, decimals: int = 6) -> DataFrame:
    """Exact: greatest dot products. queries (query_id, v), vectors (chunk_id, v); vectors of another number of dimensions are an error."""

    def score(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.round(rows @ q.T, decimals) + 0.0

    as_double = F.col("v").cast("array<double>")
    return blocks_topk(queries.withColumn("v", as_double), vectors.withColumn("v", as_double), k, _matrix(dims), score)


def hamming_topk(queries: DataFrame, signatures: DataFrame, k: int, words: int) -> DataFrame:
    """Exact: least Hamming distances of LONG words; score is the negative distance. queries (query_id, v), signatures (chunk_id, v)."""

    def read(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, words).view(np.uint64)

    def score(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros((len(rows), len(q)))
        for w in range(words):
            total -= np.bitwise_count(rows[:, w][:, None] ^ q[:, w][None, :])
        return total

    return blocks_topk(queries, signatures, k, read, score)


def band_pairs(queries: DataFrame, signatures: DataFrame, count: int = 16) -> DataFrame:
    """Distinct (query_id, chunk_id) that share a band: an equi-join, partitioned by band."""
    q = queries.select("query_id", F.explode(V.bands(F.col("v"), count)).alias("band"))
    d = signatures.select("chunk_id", F.explode(V.bands(F.col("v"), count)).alias("band"))
    return q.join(d, "band").select("query_id", "chunk_id").distinct()


def two_phase_topk(queries: DataFrame, index: DataFrame, k: int, words: int, decimals: int = 6, mode: str = "auto", band_count: int = 16) -> DataFrame:
    """Signature prefilter, then dot products of quantised vectors. queries (query_id, sig, dense), index (chunk_id, sig, codes ARRAY<BYTE>).

    Phase one keeps the max(4 k, 200) (1000 at most) nearest signatures. mode: "full" compares all signatures, "bands" only those that share a band, and all
    for queries that find less than half as many that way; "auto" uses bands above BAND_THRESHOLD chunks.
    """
    if mode not in ("auto", "full", "bands"):
        raise ValueError("mode must be auto, full or bands")
    depth = min(max(PREFETCH_FACTOR * k, PREFETCH_LEAST), PREFETCH_MOST)
    q, d = queries.select("query_id", F.col("sig").alias("v")), index.select("chunk_id", F.col("sig").alias("v"))
    if mode == "full" or (mode == "auto" and index.count() <= BAND_THRESHOLD):
        near = hamming_topk(q, d, depth, words)
    else:
        pairs = band_pairs(q, d, band_count).join(q.withColumnRenamed("v", "qv"), "query_id").join(d, "chunk_id")
        near = top_k(pairs.select("query_id", "chunk_id", (-V.hamming(F.col("qv"), F.col("v"))).cast("double").alias("score")), depth)
        few = q.join(near.groupBy("query_id").count().where(F.col("count") >= depth // 2), "query_id", "left_anti")
        near = near.join(few.select("query_id"), "query_id", "left_anti").unionByName(hamming_topk(few, d, depth, words))
    again = near.select("query_id", "chunk_id").join(queries.select("query_id", "dense"), "query_id").join(index.select("chunk_id", "codes"), "chunk_id")
    return top_k(again.select("query_id", "chunk_id", (F.round(V.dot(F.col("dense"), V.dequantize(F.col("codes"))), decimals) + 0.0).alias("score")), k)


def recall_of(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact top k that is found."""
    hits = exact.where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("one"))
    got = found.where(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return hits.join(got, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count("one"), 6).alias("recall"))


def sparse_topk(queries: DataFrame, postings: DataFrame, universe: DataFrame, k: int, scope: DataFrame | None = None, decimals: int = 6, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Sum of query weight x weight x IDF over the shared terms.

    queries (query_id, term, weight), postings (term, chunk_id, weight), universe (chunk_id): all searchable chunks; their number and the document frequencies
    over them make the IDF, also where scope (chunk_id) restricts what is scored. Weights may be negative; a chunk with a negative
    sum stays. Terms nobody has count nothing. Only the queries' terms leave the postings, before these are exchanged where the terms are made from texts on the way;
    they are brought together by chunk and written, since document frequencies and scores need them. A task scores its chunks one after another
    and gives k of them for each query; beyond query_bytes, queries are taken block by block.
    """
    ensure_importable(postings.sparkSession)
    q = checkpointed(queries.groupBy("query_id", "term").agg(F.sum("weight").alias("qw")).where("term is not null"))
    n = max(1, universe.count())
    blocks = query_blocks(q, k, query_bytes, F.octet_length(F.col("term").cast("string")) + 128)
    return top_k(reduce(DataFrame.unionByName, [_sparse_block(b, postings, universe, n, k, scope, decimals) for b in blocks]), k)


def _sparse_block(q: DataFrame, postings: DataFrame, universe: DataFrame, n: int, k: int, scope: DataFrame | None, decimals: int) -> DataFrame:
    """Of queries (query_id, term, qw) that are few enough to be sent to all tasks."""
    kind = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *postings.schema.fields]}
    codes = checkpointed(q.select("term").distinct().select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("code")))
    # the semi-join can be planned below the postings' aggregation, a join can't
    wanted = postings.join(F.broadcast(codes.select("term")), "term", "left_semi").join(F.broadcast(codes), "term").select("chunk_id", "code", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))
    wanted = wanted.join(universe.select("chunk_id"), "chunk_id", "left_semi")
    held = checkpointed(wanted.groupBy("chunk_id").agg(F.collect_list("code").alias("codes"), F.collect_list("weight").alias("weights")))
    df = held.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count("*").alias("df")).toArrow()
    got = q.join(F.broadcast(codes), "term").select("query_id", "code", F.col("qw").cast("double").alias("qw")).orderBy("code", "query_id").toArrow()
    count = int(got["code"].to_numpy().max()) + 1 if len(got) else 0
    frequency = np.zeros(count)
    frequency[df["code"].to_numpy()] = df["df"].to_numpy()
    weight = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
    asked = got["query_id"].combine_chunks().dictionary_encode()
    asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
    each = np.bincount(got["code"].to_numpy(), minlength=count)  # queries that have the term; theirs stand together, in the order of terms
    sent = postings.sparkSession.sparkContext.broadcast((asked.dictionary, each, np.cumsum(each) - each, asked.indices.to_numpy(), got["qw"].to_numpy(), weight))
    scored = held if scope is None else held.join(scope.select("chunk_id"), "chunk_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, each, first, query, qw, weight = sent.value
        best = [_Best(len(ids[at : at + SCORE_ROWS]), k) for at in range(0, len(ids), SCORE_ROWS)]
        step = max(1, SCORE_CELLS // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows if best else 0, step):
                chunk, lists, weights = (x.slice(at, step) for x in batch.columns)
                code, w = lists.flatten().to_numpy(), weights.flatten().to_numpy()
                row = np.repeat(np.arange(len(chunk)), lists.value_lengths().to_numpy())
                s, touched = np.zeros(len(chunk) * len(ids)), np.zeros(len(chunk) * len(ids), bool)
                part = np.cumsum(each[code]) // SCORE_CELLS  # postings that meet so many query terms are added at a time
                cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(code)]
                for a, b in zip(cut, cut[1:]):
                    times = each[code[a:b]]
                    own = np.repeat(first[code[a:b]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    cell = np.repeat(row[a:b] * len(ids), times) + query[own]
                    s += np.bincount(cell, qw[own] * np.repeat(w[a:b], times) * np.repeat(weight[code[a:b]], times), len(s))
                    touched[cell] = True
                s, touched = np.round(s, decimals).reshape(len(chunk), -1) + 0.0, touched.reshape(len(chunk), -1)
                number = chunk.to_numpy(zero_copy_only=False)
                for i, b in enumerate(best):
                    b.meet(number, s[:, i * SCORE_ROWS : (i + 1) * SCORE_ROWS], touched[:, i * SCORE_ROWS : (i + 1) * SCORE_ROWS])
        for i, b in enumerate(best):
            yield b.rows(ids[i * SCORE_ROWS : (i + 1) * SCORE_ROWS])

    rows = in_few_tasks(scored.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "codes", "weights"))
    return rows.mapInArrow(run, f"query_id {kind['query_id']}, chunk_id bigint, score double").withColumn("chunk_id", F.col("chunk_id").cast(kind["chunk_id"]))


def _similarity(x: np.ndarray, y: np.ndarray, binary: bool) -> np.ndarray:
    """For each row of x its greatest likeness to a row of y."""
    if binary:
        apart = np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2)
        return 1 - 2 * apart.min(1) / (64 * x.shape[1])
    return (x.astype(np.float64) @ y.astype(np.float64).T).max(1)


def _rows_of(matrix: pa.Scalar) -> np.ndarray | None:
    a = matrix.values
    return None if a is None or not len(a) else a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def maxsim_topk(queries: DataFrame, docs: DataFrame, pool: DataFrame, k: int, binary: bool = False, decimals: int = 6, query_bytes: int = QUERY_BYTES, encode: Callable[[list[str]], list[np.ndarray]] | None = None) -> DataFrame:
    """Late interaction over a candidate pool (query_id, chunk_id). queries (query_id, tokens), docs (chunk_id, tokens): matrices of floats, or of LONG words if binary.
    With encode the docs' tokens are texts, of which the pool's are made into matrices where they are met; a matrix can be forty times its text.

    Matrices meet only for pairs of the pool. Queries of up to query_bytes together are sent to all tasks, and a chunk's matrix is joined once, with the list of
    its queries; beyond, both matrices are joined to each pair."""
    pairs = pool.select("query_id", "chunk_id").distinct()
    asked = queries.select("query_id", "tokens")
    size = asked.agg(F.coalesce(F.sum(F.when(F.size("tokens") > 0, 8 * F.size("tokens") * F.size(F.col("tokens")[0]))), F.lit(0))).first()[0]
    score = (F.round("s", decimals) + 0.0).alias("score")

    def matrices(column: pa.Array) -> Iterator[np.ndarray | None]:
        if encode is None:
            yield from map(_rows_of, column)
            return
        for at in range(0, len(column), 32):
            texts = column.slice(at, 32).to_pylist()
            own = iter(encode([t for t in texts if t is not None]))
            yield from (None if t is None else next(own) for t in texts)

    if size > query_bytes:

        @F.arrow_udf("double")
        def both(q: pa.Array, d: pa.Array) -> pa.Array:
            met = ((_rows_of(a), y) for a, y in zip(q, matrices(d)))
            return pa.array([0.0 if x is None or y is None else float(_similarity(x, y, binary).mean()) for x, y in met])

        joined = pairs.join(asked.withColumnRenamed("tokens", "qt"), "query_id").join(docs.select("chunk_id", F.col("tokens").alias("dt")), "chunk_id")
        return top_k(joined.select("query_id", "chunk_id", both("qt", "dt").alias("s")).select("query_id", "chunk_id", score), k)
    got = asked.toArrow()
    sent = queries.sparkSession.sparkContext.broadcast({i: _rows_of(m) for i, m in zip(got["query_id"].to_pylist(), got["tokens"])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            out: list[tuple] = []
            for chunk, ids, y in zip(batch.column(0), batch.column(1), matrices(batch.column(2))):
                some = [i for i in ids.as_py() if i in held]
                with_rows = [i for i in some if held[i] is not None] if y is not None else []
                out += [(i, chunk.as_py(), 0.0) for i in set(some).difference(with_rows)]
                if with_rows:
                    best = _similarity(np.concatenate([held[i] for i in with_rows]), y, binary)
                    ends = np.cumsum([len(held[i]) for i in with_rows])
                    out += [(i, chunk.as_py(), float(part.mean())) for i, part in zip(with_rows, np.split(best, ends[:-1]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.column(1).type.value_type), pa.array([r[1] for r in out], batch.column(0).type), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "chunk_id", "s"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    listed = pairs.groupBy("chunk_id").agg(F.collect_list("query_id").alias("ids")).join(docs.select("chunk_id", "tokens"), "chunk_id").select("chunk_id", "ids", "tokens")
    return top_k(listed.mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, s double").select("query_id", "chunk_id", score), k)


def lookup(table: DataFrame, ids: list[int], id_col: str = "chunk_id") -> DataFrame:
    """Rows of the ids in the order given (column ordinal); missing ids are left out, of a repeated id the first place counts."""
    if len(ids) > PREFETCH_MOST:
        raise ValueError(f"more than {PREFETCH_MOST} ids")
    wanted = table.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{id_col} bigint, ordinal int")
    return table.join(F.broadcast(wanted), id_col).orderBy("ordinal")
