"""Selection of varied results: each query's short candidate list (query_id, chunk_id, rank, score, v) is one group of a grouped map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable

#: Candidates of a query that a selection looks at.
POOL = 40
_TINY = 1e-12


def unit_rows(vectors: list) -> np.ndarray | None:
    """The vectors at length 1; None if one is missing, of another size, not finite or zero."""
    if any(v is None for v in vectors) or len({len(v) for v in vectors}) != 1:
        return None
    m = np.array([list(v) for v in vectors], float)
    if not m.size or not np.isfinite(m).all():
        return None
    top = np.abs(m).max(1, keepdims=True)
    if (top <= 0).any():
        return None
    m = m / top
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def mmr(relevance: np.ndarray, unit: np.ndarray, k: int, lam: float = 0.5) -> list[int]:
    """Places of the k candidates picked by relevance less likeness to those picked before; of equal ones the first."""
    free, nearest, out = np.ones(len(relevance), bool), None, []
    while len(out) < k and free.any():
        value = lam * relevance - (0 if nearest is None else (1 - lam) * nearest)
        pick = int(np.argmax(np.where(free, value, -np.inf)))
        out.append(pick)
        free[pick] = False
        like = np.clip(unit @ unit[pick], -1, 1)
        nearest = like if nearest is None else np.maximum(nearest, like)
    return out


def shifted_cosine(unit: np.ndarray, jitter: float = 1e-9) -> np.ndarray:
    """The kernel (1 + cosine) / 2, positive semidefinite, with a little more on the diagonal."""
    k = (1 + unit @ unit.T) / 2
    return (k + k.T) / 2 + jitter * np.eye(len(unit))


def dpp(relevance: np.ndarray, unit: np.ndarray, k: int, alpha: float = 1.0, jitter: float = 1e-9) -> list[int]:
    """Greedy choice by determinant of the quality-weighted kernel, one Cholesky column for each pick; negative relevance has no quality.
    When no volume is left, the rest follows in the order given."""
    with np.errstate(all="ignore"):
        quality = np.maximum(relevance, 0.0) ** alpha
        left = quality**2 * (1 + jitter)
    n, floor = len(relevance), max(np.finfo(float).eps, jitter * 1e-6)
    if not np.isfinite(left).all():
        return list(range(min(k, n)))
    free, columns, out = np.ones(n, bool), np.zeros((n, 0)), []
    while len(out) < min(k, n):
        pick = int(np.argmax(np.where(free, left, -np.inf)))
        if left[pick] <= floor:
            return (out + np.flatnonzero(free).tolist())[:k]
        out.append(pick)
        free[pick] = False
        row = quality * quality[pick] * (1 + np.clip(unit @ unit[pick], -1, 1)) / 2
        column = (row - columns @ columns[pick]) / np.sqrt(left[pick])
        if not np.isfinite(column[free]).all():
            return list(range(min(k, n)))
        columns = np.column_stack([columns, np.where(free, column, 0.0)])
        left = np.maximum(left - column**2, 0.0)
    return out


def fermionic(relevance: np.ndarray, rows: np.ndarray, k: int, diversity: float = 0.35) -> list[int]:
    """Greedy choice by (1 - diversity) x 2 ln relevance + diversity x ln volume; a missing vector (zero row) is at right angles to all."""
    n = len(relevance)
    if diversity <= 0 or n <= 1 or k <= 0:
        return list(range(min(max(k, 0), n)))
    span = relevance.max() - relevance.min()
    share = (relevance - relevance.min()) / span if span > _TINY else np.ones(n)
    theta = min(1.0, max(0.0, 1 - diversity))
    gain, left = theta * 2 * np.log(np.maximum(share, _TINY)), np.ones(n)
    free, columns, out = np.ones(n, bool), np.zeros((n, 0)), []
    while len(out) < min(k, n):
        pick = int(np.argmax(np.where(free, gain + (1 - theta) * np.log(np.maximum(left, _TINY)), -np.inf)))
        if left[pick] < _TINY:
            return (out + np.flatnonzero(free).tolist())[:k]
        out.append(pick)
        free[pick] = False
        column = (rows @ rows[pick] - columns @ columns[pick]) / np.sqrt(left[pick])
        columns = np.column_stack([columns, column])
        left = np.maximum(left - column**2, 0.0)
    return out


def choose(relevance: np.ndarray, vectors: list, k: int, method: str, mmr_lambda: float = 0.5, dpp_alpha: float = 1.0, diversity: float = 0.35) -> list[int]:
    """Places in the order of choice. A bad vector or relevance leaves the order as it is (fermionic: a bad vector counts as missing)."""
    n = len(relevance)
    if method == "none" or not n or not np.isfinite(relevance).all():
        return list(range(min(k, n)))
    if method == "fermionic":
        dims = next((len(v) for v in vectors if v is not None), 0)
        rows = np.array([list(v) if v is not None and len(v) == dims else [0.0] * dims for v in vectors], float).reshape(n, dims)
        return fermionic(relevance, rows, k, diversity)
    unit = unit_rows(vectors)
    if unit is None:
        return list(range(min(k, n)))
    return mmr(relevance, unit, k, mmr_lambda) if method == "mmr" else dpp(relevance, unit, k, dpp_alpha)


def diversify(candidates: DataFrame, k: int, method: str = "none", pool: int = POOL, **options) -> DataFrame:
    """(query_id, chunk_id, score, rank): up to k of each query's first `pool` candidates, ranked in the order of choice.

    candidates: (query_id, chunk_id, rank, score, v ARRAY<DOUBLE>). Groups are as small as the pool, so a group is a page, whatever the number of queries.
    """
    if method not in ("none", "mmr", "dpp", "fermionic"):
        raise ValueError("method must be none, mmr, dpp or fermionic")
    few = candidates.where(F.col("rank") <= max(pool, k)).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.col("v").cast("array<double>").alias("v"))
    if method == "none":
        return few.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
    ensure_importable(candidates.sparkSession)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "chunk_id"]).drop_duplicates("chunk_id").reset_index(drop=True)
        at = choose(rows["score"].to_numpy(), list(rows["v"]), k, method, **options)
        out = rows.loc[at, ["query_id", "chunk_id", "score"]].reset_index(drop=True)
        out["rank"] = np.arange(1, len(at) + 1, dtype=np.int32)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in few.schema.fields}
    return few.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int")
