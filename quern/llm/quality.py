"""Operator 8: quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel over a few statistics of the text. Each partition of the labelled rows sums its
part of the normal equations; the driver adds the parts, which have the same size whatever the data, and solves for
ridge scores. Isotonic regression on rows that the fit didn't see turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable
from .arrow import over_pieces, pieces, string_bytes


STATISTICS = ("log_bytes", "lower", "upper", "digit", "newline", "point", "symbol", "bar", "high", "word_bytes", "same_words", "line_bytes")

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _POINT, _SYMBOL, _BAR, _HIGH = range(1, 10)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in " \t"]] = _SPACE
_CLASS[[ord(c) for c in "\n\r"]] = _LINE
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = _POINT
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{}~"]] = _SYMBOL
_CLASS[ord("|")] = _BAR
_CLASS[128:] = _HIGH


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text, given the texts' UTF-8 bytes; an empty text has zeros."""
    n = np.diff(offsets)
    size = np.maximum(n, 1).astype(np.float64)
    kind = _CLASS[raw]

    def share(c: int) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int64)])
        return at[offsets[1:]] - at[offsets[:-1]]

    lower, upper, digit, line, point, symbol, bar, high = (share(c) for c in (_LOWER, _UPPER, _DIGIT, _LINE, _POINT, _SYMBOL, _BAR, _HIGH))
    blank = (kind == _SPACE) | (kind == _LINE)
    visible = ~blank
    first = visible.copy()
    first[1:] &= blank[:-1]
    first[offsets[:-1][n > 0]] = visible[offsets[:-1][n > 0]]
    starts = np.flatnonzero(first)
    words = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    letters = np.concatenate([[0], np.cumsum(visible, dtype=np.int64)])
    in_words = letters[offsets[1:]] - letters[offsets[:-1]]
    same = np.zeros(len(n))
    if len(starts) > 1:
        code = raw.astype(np.uint64) + np.uint64(1)
        place = np.arange(len(raw), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.arange(len(raw), dtype=np.uint64) - np.concatenate([np.zeros(starts[0], np.uint64), np.repeat(starts.astype(np.uint64), np.diff(np.append(starts, len(raw))))])
        mixed = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[blank] = 0
        hashes = np.add.reduceat(mixed, starts)
        equal = np.concatenate([[0], np.cumsum(hashes[1:] == hashes[:-1])])
        a, b = np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])
        some = b - a > 1
        same[some] = (equal[b[some] - 1] - equal[a[some]]) / (b[some] - a[some] - 1)
    return np.stack([np.log1p(n), lower / size, upper / size, digit / size, line / size, point / size, symbol / size, bar / size, high / size, np.log1p(in_words / np.maximum(words, 1)), same, np.where(n > 0, np.log1p(n / (line + 1.0)), 0.0)], axis=1)


@dataclass(frozen=True)
class Model:
    """A fitted classifier; its size doesn't depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the projections
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray  # isotonic steps: scores, then probabilities
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.phases
        return np.concatenate([np.sqrt(2 / len(self.phases)) * np.cos(z), np.ones((len(x), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rounded, so that equal texts have equal scores wherever they stand in a batch."""
        return np.round(np.concatenate([self.features(x[at : at + 4096]) @ self.ridge for at in range(0, len(x), 4096)]), 9) if len(x) else np.zeros(0)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.ones(len(scores))
        return np.interp(scores, self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nondecreasing weighted least-squares fit of y over ascending x, by pooling adjacent violators: one (x, level) for each x."""
    level: list[list[float]] = []
    for v, u in zip(y.tolist(), w.tolist()):
        level.append([v, u, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, u2, n2 = level.pop()
            v1, u1, n1 = level[-1]
            level[-1] = [(v1 * u1 + v2 * u2) / (u1 + u2), u1 + u2, n1 + n2]
    return x, np.repeat([v for v, _, _ in level], [int(n) for _, _, n in level]) if level else y


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x ARRAY<DOUBLE>) of every row of df; x is null for a null text."""
    ensure_importable(df.sparkSession)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        null = np.asarray(batch.column(1).is_null())
        x = statistics(*string_bytes(batch.column(1)))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        if null.any():
            values = pa.array([None if bad else v for bad, v in zip(null, values.to_pylist())], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "x"])

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(over_pieces(piece, 1), f"id {df.schema[id_col].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", label_id: str = "doc_id", features: int = 256, penalty: float = 1e-3, max_labels: int = 200_000, seed: int = 7) -> Model:
    """The classifier for rows (id, x) of `_rows` and labels (label_id, label_col 0 or 1).

    max_labels bounds the labelled rows that are used: where there are more, those with the smallest hash of their id. The means and scales
    are over all rows. A fifth of the labelled rows (by hash) isn't fitted but calibrates. Null labels, labels without a document and
    documents without a text don't count; repeated labels each do. Without labels every document gets probability 1.
    """
    k = len(STATISTICS)
    moments = rows.where("x is not null").agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)]).first()
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(k)])
    weights, phases = rng.normal(size=(k, features)) * np.sqrt(1 / k), rng.uniform(0, 2 * np.pi, features)
    blank = Model(mean, scale, weights, phases, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    ranked = labels.select(labels[label_id].alias("lid"), labels[label_col].cast("double").alias("y"), F.xxhash64(F.lit(seed), labels[label_id]).alias("h")).where("lid is not null and y is not null")
    total = ranked.count()
    if total > max_labels:  # hashes are uniform: the bound is met up to a fraction of a percent
        ranked = ranked.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * (max_labels / total))))
    known = rows.where("x is not null").join(ranked, F.col("id") == F.col("lid")).select("x", "y", "h")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((features + 1, features + 1)), np.zeros(features + 1), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z, y = blank.features(_matrix(part.column(0))), part.column(1).to_numpy()
                a += z.T @ z
                b += z.T @ y
                n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()]), pa.array([n])], names=["a", "b", "n"])

    held = F.pmod("h", F.lit(5)) == 0
    known = checkpointed(known)
    sums_ = known.where(~held).coalesce(16).mapInArrow(parts, "a binary, b binary, n bigint").collect()
    if not sums_:
        return blank
    a = sum(np.frombuffer(r.a).reshape(features + 1, -1) for r in sums_)
    b = sum(np.frombuffer(r.b) for r in sums_)
    n = sum(r.n for r in sums_)
    ridge = np.linalg.solve(a / n + penalty * np.diag(np.append(np.ones(features), 0) + 1e-9), b / n)
    model = Model(mean, scale, weights, phases, ridge, np.zeros(0), np.zeros(0))
    scored = known.where(held).mapInArrow(_score_known(model), "s double, y double")
    # scores on a grid of 1/500: the steps have a bounded size
    grid = scored.groupBy(F.round("s", 0), F.round(F.col("s") * 500).alias("g")).agg(F.avg("y").alias("y"), F.count("*").alias("w")).groupBy("g").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("w")).orderBy("g").collect()
    if not grid:
        return Model(mean, scale, weights, phases, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, levels = isotonic(np.array([r.g / 500 for r in grid]), np.array([r.y for r in grid]), np.array([float(r.w) for r in grid]))
    return Model(mean, scale, weights, phases, ridge, knots, levels)


def _score_known(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.scores(_matrix(batch.column(0)))), batch.column(1)], names=["s", "y"])

    return run


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, **options) -> DataFrame:
    """(id_col, score, probability, keep) of every row of df.

    score is the ridge score, probability its calibrated value, keep whether probability reaches the threshold. A null text
    has a null score and probability, and isn't kept; an empty text is scored by its statistics (zeros). Repeated rows and null
    ids are scored each; other columns of df are ignored; an empty table gives no rows. With no usable labels all texts are kept.
    Texts are read whole, once. Options: see fit.
    """
    rows = checkpointed(_rows(df, id_col, text_col))
    model = fit(rows, labels, label_col, id_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.asarray(batch.column(1).is_null())
            s = np.zeros(batch.num_rows)
            s[~null] = model.scores(_matrix(batch.column(1).drop_null()))
            p = model.probabilities(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, mask=null), pa.array(p, mask=null), pa.array((p >= threshold) & ~null)], names=["id", "score", "probability", "keep"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, score double, probability double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of df that classify keeps, with all their columns. Rows aren't exchanged: the model, whose size is fixed, goes to them."""
    model = fit(checkpointed(_rows(df, id_col, text_col)), labels, label_col, id_col, **options)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for piece in pieces(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
            p = model.probabilities(model.scores(statistics(*string_bytes(piece.column(0)))))
            out.append((p >= threshold) & ~np.asarray(piece.column(0).is_null()))
        return pa.array(np.concatenate(out))

    return df.where(good(df[text_col].cast("string")))
