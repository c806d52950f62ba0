"""Operator 3: embedding near-dedup by an epsilon grid order join.

Unit vectors within an angle are within a distance eps. Equal vectors are taken together first. The others are projected onto the leading principal axes,
given grid cells of width eps there, and sorted by cell. The sequence is cut into blocks; pairs of blocks whose boxes are further apart
than eps are skipped, the other pairs are tasks. A task joins its two sequences recursively: two intervals are skipped as soon as their boxes are
further apart than eps, counted whole as soon as the balls around them lie within eps of each other, halved while large, and
compared when small. The projection never lengthens a distance, so nothing is lost.

No pairs leave a task: for each vector it gives the number of links and one vector of its group in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable
from .graph import components

#: Axes that have grid cells, axes whose distances are looked at, and coordinates from which the axes are computed.
LEADING, AXES, SPAN = 8, 16, 256
#: The sequence is cut into about BLOCKS blocks, of so many vectors at least and at most (a task's last block may have nearly twice as many). Only the tasks' sizes depend on it.
BLOCKS, BLOCK_LEAST, BLOCK_MOST = 12, 512, 32_768
#: A block's vectors take so many bytes at most, as doubles.
BLOCK_BYTES = 16 << 20
_LEAF = 128
#: Links that a task holds before it sums them up.
_HELD = 1_000_000
#: A vector is named by its block and its place there.
_POS = 1 << 16


def _packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw BINARY, d, h, h2) of every row: raw the vector's elements, null unless it has elements, all finite, and isn't zero; h and h2 are hashes of it."""
    narrow = df.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = df.schema[id_col].dataType.simpleString()
    width = np.float32 if narrow else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat = v.flatten()
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(width) + width(0)  # no negative zeros
            n = np.where(np.asarray(v.is_valid()), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            ends = np.cumsum(n)
            bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
            good = (bad[ends] == bad[ends - n]) & (some[ends] > some[ends - n])
            raw = [values[e - k : e].tobytes() if g else None for e, k, g in zip(ends.tolist(), n.tolist(), good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(n)], names=["id", "raw", "d"])

    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<float>" if narrow else "array<double>").alias("v")).mapInArrow(run, f"id {kind}, raw binary, d bigint")
    return rows.withColumns({"h": F.when(F.col("raw").isNotNull(), F.xxhash64("raw")).otherwise(F.xxhash64("id")), "h2": F.xxhash64(F.lit(1), "raw")})


def _vectors(raw: list[bytes] | bytes, dims: int, width: type) -> np.ndarray:
    """Unit vectors, as doubles."""
    x = np.frombuffer(b"".join(raw) if isinstance(raw, list) else raw, width).reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(rows: DataFrame, width: type) -> tuple[int, int, np.ndarray]:
    """The number of vectors (raw, d), the largest d, and as columns the AXES directions of largest variance of their first SPAN coordinates.

    From sums of tasks, which are summed again by a few tasks: the driver gets 16 sums, whatever the number of rows."""

    def add(parts: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n, d, s, q = 0, 0, np.zeros(0), np.zeros((0, 0))
        for m, k, t, r in parts:
            if len(t) > len(s):
                s, q = np.pad(s, (0, len(t) - len(s))), np.pad(q, (0, len(t) - len(s)))
            n, d = n + m, max(d, k)
            s[: len(t)] += t
            q[: len(t), : len(t)] += r
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([d]), pa.array([s.tobytes()]), pa.array([q.tobytes()])], names=["n", "d", "s", "q"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            for batch in batches:
                d = batch.column(1).to_numpy()
                for k in np.unique(d).tolist():
                    x = _vectors(batch.column(0).filter(pa.array(d == k)).to_pylist(), k, width)[:, :SPAN]
                    yield len(x), k, x.sum(0), x.T @ x

        return add(parts())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add((n, d, (s := np.frombuffer(t)), np.frombuffer(q).reshape(len(s), len(s))) for b in batches for n, d, t, q in zip(*(c.to_pylist() for c in b.columns)))

    kind = "n bigint, d bigint, s binary, q binary"
    sums = rows.select("raw", "d").mapInArrow(first, kind).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16))).repartition(16, "g").drop("g").mapInArrow(again, kind).collect()
    n = sum(r.n for r in sums)
    if not n:
        return 0, 0, np.zeros((0, 0))
    most = max(len(r.s) for r in sums) // 8
    s, q = np.zeros(most), np.zeros((most, most))
    for r in sums:
        t = np.frombuffer(r.s)
        s[: len(t)] += t
        q[: len(t), : len(t)] += np.frombuffer(r.q).reshape(len(t), len(t))
    _, axes = np.linalg.eigh(q / n - np.outer(s / n, s / n))
    return n, max(r.d for r in sums), np.ascontiguousarray(axes[:, ::-1][:, :AXES])


def _project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    x = x[:, : len(axes)]
    return x @ axes[: x.shape[1]]


class Sequence:
    """A block's vectors in grid order, with the box and the ball of every interval of _LEAF rows, of twice as many, and so on."""

    def __init__(self, unit: np.ndarray, count: np.ndarray, axes: np.ndarray):
        self.unit, self.count = unit, count
        self.y = _project(unit, axes)
        self.near, self.square = self.y.astype(np.float32), (self.y * self.y).sum(1).astype(np.float32)
        n = len(unit)
        self.levels = []  # (starts, low, high, centre, radius) from leaves to the whole
        step = _LEAF
        while True:
            starts = np.arange(0, n, step)
            size = np.minimum(step, n - starts)[:, None]
            centre = np.add.reduceat(unit, starts, axis=0) / size
            far = np.sqrt(((unit - np.repeat(centre, size[:, 0], axis=0)) ** 2).sum(1))
            self.levels.append((starts, np.minimum.reduceat(self.y, starts, axis=0), np.maximum.reduceat(self.y, starts, axis=0), centre, np.maximum.reduceat(far, starts)))
            if len(starts) == 1:
                break
            step *= 2
        self.step = step

    def level(self, k: int) -> tuple:
        return self.levels[min(k, len(self.levels) - 1)]


class Links:
    """Numbers of links, and groups, of the rows of a task."""

    def __init__(self, n: int):
        self.count, self.root = np.zeros(n, np.int64), np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > _HELD:
            self.settle()

    def settle(self) -> np.ndarray:
        """The root of every row: the first row of its group."""
        if self.a:
            a, b, root = np.concatenate(self.a), np.concatenate(self.b), self.root
            self.a, self.b, self.held = [], [], 0
            while len(a):
                x, y = root[a], root[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = root[root]
                    if np.array_equal(up, root):
                        break
                    root = up
            self.root = root
        return self.root


def link(p: Sequence, q: Sequence, same: bool, least: float, eps: float, sure: float) -> Links:
    """Links between the rows of p and q (same: q is p), whose rows count from 0 and, for q, on from the end of p. A link is a cosine, rounded to six places, of `least` at
    least; vectors further apart than eps have none, those within `sure` of each other have one."""
    shift = 0 if same else len(p.unit)
    out = Links(len(p.unit) + (0 if same else len(q.unit)))
    k = max(len(p.levels), len(q.levels)) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    limit = eps * eps
    while k >= 0 and len(a):
        starts_p, lo_p, hi_p, mid_p, r_p = p.level(k)
        starts_q, lo_q, hi_q, mid_q, r_q = q.level(k)
        keep, whole = np.zeros(len(a), bool), np.zeros(len(a), bool)
        for at in range(0, len(a), 50_000):
            i, j = a[at : at + 50_000], b[at : at + 50_000]
            gap = np.maximum(0, np.maximum(lo_q[j] - hi_p[i], lo_p[i] - hi_q[j]))
            keep[at : at + 50_000] = (gap * gap).sum(1) <= limit
            tight = np.flatnonzero(r_p[i] + r_q[j] <= sure)
            whole[at + tight] = np.sqrt(((mid_p[i[tight]] - mid_q[j[tight]]) ** 2).sum(1)) + r_p[i[tight]] + r_q[j[tight]] <= sure
        for i, j in zip(a[whole].tolist(), b[whole].tolist()):
            _all(out, p, q, *_span(starts_p, i, len(p.unit)), *_span(starts_q, j, len(q.unit)), shift, same and i == j)
        a, b = a[keep & ~whole], b[keep & ~whole]
        if k == 0:
            for i, j in zip(a.tolist(), b.tolist()):
                _leaf(out, p, q, *_span(starts_p, i, len(p.unit)), *_span(starts_q, j, len(q.unit)), shift, same and i == j, least, limit)
            break
        k -= 1
        a, b = _children(a, len(p.level(k)[0]), k < len(p.levels) - 1, b, len(q.level(k)[0]), k < len(q.levels) - 1)
        if same:
            a, b = a[a <= b], b[a <= b]
    return out


def _span(starts: np.ndarray, i: int, n: int) -> tuple[int, int]:
    return int(starts[i]), int(starts[i + 1]) if i + 1 < len(starts) else n


def _children(a: np.ndarray, n_a: int, halve_a: bool, b: np.ndarray, n_b: int, halve_b: bool) -> tuple[np.ndarray, np.ndarray]:
    both = [(2 * a + x if halve_a else a, 2 * b + y if halve_b else b) for x in range(2 if halve_a else 1) for y in range(2 if halve_b else 1)]
    a, b = np.concatenate([x for x, _ in both]), np.concatenate([y for _, y in both])
    there = (a < n_a) & (b < n_b)
    return a[there], b[there]


def _all(out: Links, p: Sequence, q: Sequence, i: int, j: int, k: int, m: int, shift: int, own: bool) -> None:
    if own:
        out.count[i:j] += p.count[i:j].sum() - p.count[i:j]
        out.join(np.full(j - i - 1, i), np.arange(i + 1, j))
        return
    out.count[i:j] += q.count[k:m].sum()
    out.count[k + shift : m + shift] += p.count[i:j].sum()
    out.join(np.full(m - k, i), np.arange(k, m) + shift)
    out.join(np.arange(i + 1, j), np.full(j - i - 1, k + shift))


def _leaf(out: Links, p: Sequence, q: Sequence, i: int, j: int, k: int, m: int, shift: int, own: bool, least: float, limit: float) -> None:
    d = p.square[i:j, None] + q.square[None, k:m] - 2 * (p.near[i:j] @ q.near[k:m].T)
    x, y = np.nonzero(d <= np.float32(limit + 1e-4))
    if own:
        x, y = x[x < y], y[x < y]
    if not len(x):
        return
    if 8 * len(x) > d.size:
        cosine = (p.unit[i:j] @ q.unit[k:m].T)[x, y]
    else:
        cosine = np.einsum("ij,ij->i", p.unit[x + i], q.unit[y + k])
    near = np.round(cosine, 6) >= least
    x, y = x[near] + i, y[near] + k
    out.count[i:j] += np.bincount(x - i, q.count[y], j - i).astype(np.int64)
    out.count[k + shift : m + shift] += np.bincount(y - k, p.count[x], m - k).astype(np.int64)
    out.join(x, y + shift)


def near_classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = 0.95) -> DataFrame:
    """(id_col, class_id, n_links) of every row of df: n_links is the number of other rows whose vectors have a cosine (rounded to six places) of min_cosine
    at least with the row's, class_id the smallest id of the rows that are connected by such links, the row itself included.

    Exact: every row is compared with every other unless the two are provably too far apart, or provably near. Rows with a null, empty or zero
    vector, or with a null, NaN or infinite element, have a null class and null links. Vectors of different lengths have no link. Repeated
    rows are links of each other, also with equal ids. A null id is kept; a class whose ids are all null has a null class_id.
    Other columns are ignored, whatever their names; an empty table gives no rows. There are no ties to settle but that of equal ids.

    Equal vectors are joined once, so a vector that many rows share costs what one row does. Any exact join of vectors that spread evenly over all
    directions compares most pairs of blocks when eps is as wide as the spread along an axis (cosine 0.95 in 64 dimensions): then the exchange is
    about BLOCKS times the vectors, and beyond BLOCKS * BLOCK_MOST vectors it grows as their square. It is in proportion where blocks are skipped.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be above 0 and at most 1")
    spark = ensure_importable(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    width = np.float32 if df.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    rows = _packed(df, id_col, vector_col)
    usable = rows.where("raw is not null")
    total, dims, axes = _axes(usable, width)
    if not total:
        return df.select(df[id_col].alias(id_col), F.lit(None).cast(kind).alias("class_id"), F.lit(None).cast("bigint").alias("n_links"))
    eps = float(np.sqrt(2 - 2 * (min_cosine - 5e-7))) + 1e-6
    sure = float(np.sqrt(max(0.0, 2 - 2 * (min_cosine + 1e-9)))) - 1e-9
    lead = min(LEADING, axes.shape[1])
    cells = [f"c{i}" for i in range(lead)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, raw = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            c = np.zeros((len(d), lead), np.int64)
            for k in np.unique(d).tolist():
                at = np.flatnonzero(d == k)
                c[at] = np.floor(_project(_vectors([raw[i] for i in at.tolist()], k, width), axes)[:, :lead] / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c[:, i]) for i in range(lead)]], names=["raw", "d", "h", "h2", "n", "id", *cells])

    one = usable.groupBy("h", "h2").agg(F.first("raw").alias("raw"), F.first("d").alias("d"), F.count("*").alias("n"), F.min("id").alias("id")).select("raw", "d", "h", "h2", "n", "id")
    size = max(1, min(BLOCK_MOST, BLOCK_BYTES // (8 * dims), max(BLOCK_LEAST, -(-total // BLOCKS))))
    parts = max(1, min(-(-total // size), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = one.mapInArrow(place, f"raw binary, d bigint, h bigint, h2 bigint, n bigint, id {kind}, " + ", ".join(f"{c} bigint" for c in cells)).repartitionByRange(parts, "d", *cells).sortWithinPartitions("d", *cells)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def make(t: pa.Table) -> pa.RecordBatch:
            d = t["d"][0].as_py()
            y = _project(_vectors(t["raw"].to_pylist(), d, width), axes)
            names = ("h", "h2", "n")
            columns = [pa.array([d]), pa.array([b"".join(t["raw"].to_pylist())]), *[pa.array([t[c].to_numpy().astype(np.int64).tobytes()]) for c in names], pa.array([t["id"].to_pylist()], pa.list_(t["id"].type)), pa.array([y.min(0).tolist()]), pa.array([y.max(0).tolist()])]
            return pa.RecordBatch.from_arrays(columns, names=["d", "raw", *names, "ids", "lo", "hi"])

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            while True:
                d = t["d"].to_numpy()
                cut = int(np.searchsorted(d, d[0], side="right")) if len(d) else 0
                if cut < 2 * size and cut == len(d):
                    break
                cut = cut if cut < 2 * size else size
                yield make(t.slice(0, cut))
                t = t.slice(cut)
            held = t.to_batches()
        if held and sum(map(len, held)):
            yield make(pa.Table.from_batches(held))

    blocks = order.mapInArrow(block, f"d bigint, raw binary, h binary, h2 binary, n binary, ids array<{kind}>, lo array<double>, hi array<double>")
    name = F.monotonically_increasing_id()  # the task and, below it, 33 bits of the place there
    blocks = checkpointed(blocks.withColumn("block", F.shiftleft(F.shiftright(name, 33), 16) + name.bitwiseAND((1 << 33) - 1)))
    # blocks meet by the first axis' cells, then by their boxes
    low, high = (F.floor(F.col(x)[0] / eps) for x in ("lo", "hi"))
    boxes = blocks.select("block", "d", "lo", "hi", low.alias("from"), F.explode(F.sequence(low, high + 1)).alias("cell"))
    a, b = boxes.alias("a"), boxes.alias("b")
    gap = F.aggregate(F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x * x)
    meet = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.block") <= F.col("b.block")) & (F.col("a.cell") == F.greatest("a.from", "b.from"))
    pairs = a.join(b, meet).where(gap <= eps * eps).select(F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    ends = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    work = ends.join(blocks.select("block", "d", "raw", "n"), "block").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x", "y").sortWithinPartitions("x", "y", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for r in range(batch.num_rows):
                at, x, y, d = (batch.column(c)[r].as_py() for c in (0, 1, 2, 3))
                here = Sequence(_vectors(batch.column(4)[r].as_buffer(), d, width), np.frombuffer(batch.column(5)[r].as_buffer(), np.int64), axes)
                if x != y and at == x:
                    before = here
                    continue
                p = here if x == y else before
                found = link(p, here, x == y, min_cosine, eps, sure)
                root = found.settle()
                some = np.flatnonzero(found.count)
                place = np.concatenate([x * _POS + np.arange(len(p.unit)), y * _POS + np.arange(len(here.unit))])
                yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(found.count[some]), pa.array(place[root[some]])], names=["node", "links", "root"])

    found = checkpointed(work.select("block", "x", "y", "d", "raw", "n").mapInArrow(compare, "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                h, h2, n = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)[r].as_py() * _POS + np.arange(len(h))), pa.array(h), pa.array(h2), pa.array(n), batch.column(4)[r].values], names=["node", "h", "h2", "n", "id"])

    each = blocks.select("block", "h", "h2", "n", "ids").mapInArrow(unpack, f"node bigint, h bigint, h2 bigint, n bigint, id {kind}")
    each = each.join(links, "node", "left").join(roots, "node", "left").select("h", "h2", "id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("root").isNotNull().alias("linked"))
    least = each.where("linked").groupBy("root").agg(F.min("id").alias("class_id"))
    each = each.join(least, "root", "left").select("h", "h2", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"), "n_links")
    return rows.select("id", "h", "h2", F.col("raw").isNotNull().alias("usable")).join(each.withColumn("usable", F.lit(True)), ["h", "h2", "usable"], "left").select(F.col("id").alias(id_col), "class_id", "n_links")
