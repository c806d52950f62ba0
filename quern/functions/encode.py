"""Encoders: hashed n-grams as dense vectors and token matrices, hashed words as sparse weights, signatures by random planes.

CRC-32 values of all n-grams of a batch come from table steps over whole arrays: the state after n characters is that of n+1 characters less
one step, so the 3- to 5-grams of a text cost five steps for each position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_importable
from . import text as T

SEED = 7742
SIGNATURE_BITS, TOKEN_BITS = 1024, 128
_BLANKS = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")
_CJK = re.compile(T.CJK)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


def _step(state: np.ndarray, octet: np.ndarray) -> np.ndarray:
    return _TABLE[(state ^ octet) & np.uint32(255)] ^ (state >> np.uint32(8))


def gram_hashes(texts: list[str], low: int, high: int, prefix: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of prefix + gram for all character n-grams of all texts, and the text that each belongs to."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
    octets = np.zeros((4, n), np.uint32)
    for w in (1, 2, 3, 4):
        at = np.flatnonzero(width == w)
        if not len(at):
            continue
        c = codes[at]
        lead = (0, 0, 0xC0, 0xE0, 0xF0)[w]
        octets[0, at] = lead | (c >> np.uint32(6 * (w - 1)))
        for k in range(1, w):
            octets[k, at] = 0x80 | ((c >> np.uint32(6 * (w - 1 - k))) & np.uint32(0x3F))
    owner = np.repeat(np.arange(len(texts)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(n)  # characters from here to the text's end
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    for b in prefix:
        state = _step(state, np.full(n, b, np.uint32))
    start = np.arange(n)
    hashes, owners = [], []
    widest = int(width.max())
    for size in range(1, high + 1):
        keep = left[start] >= size
        start, state = start[keep], state[keep]
        if not len(start):
            break
        at = start + size - 1
        state = _step(state, octets[0, at])
        for k in range(1, widest):
            more = width[at] > k
            if more.any():
                state = np.where(more, _step(state, octets[k, at]), state)
        if size >= low:
            hashes.append(state ^ np.uint32(0xFFFFFFFF))
            owners.append(owner[start])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def hashed_vectors(texts: list[str], dims: int, low: int, high: int, prefix: bytes = b"") -> np.ndarray:
    """Each text's n-grams added with the sign of the hash's top bit to the place hash mod dims; rows have length 1, or are zero."""
    padded = [" " + _BLANKS.sub(" ", t.lower()) + " " for t in texts]
    h, owner = gram_hashes(padded, low, high, prefix)
    signs = np.where(h >> np.uint32(31), 1.0, -1.0)
    flat = np.bincount(owner * dims + (h % np.uint32(dims)).astype(np.int64), signs, len(texts) * dims)
    rows = flat.astype(np.float64).reshape(len(texts), dims)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=rows, where=size > 0).astype(np.float32)


def word_list(text: str) -> list[str]:
    """The words of functions.text.words, in Python."""
    out: list[str] = []
    for w in _WORDS.findall(text.lower()):
        chars = _CJK.findall(w)
        if not chars:
            out.append(w)
            continue
        out += [p for p in _CJK.split(w) if p]
        out += chars
        out += [a + b for a, b in zip(chars, chars[1:])]
    return out


class Encoder(Protocol):
    """What an encoder plug-in offers: one dense row and one matrix of token rows for each text. It runs in Python workers, a bounded batch at a time."""

    name: str
    dense_dim: int
    token_dim: int

    def dense(self, texts: list[str]) -> np.ndarray: ...

    def tokens(self, texts: list[str]) -> list[np.ndarray]: ...


class HashEncoder:
    """Language-free encoder without a model."""

    name = "hash"

    def __init__(self, dense_dim: int = 1024, token_dim: int = 128, max_tokens: int = 256):
        self.dense_dim, self.token_dim, self.max_tokens = dense_dim, token_dim, max_tokens

    def dense(self, texts: list[str]) -> np.ndarray:
        return hashed_vectors(texts, self.dense_dim, 3, 5)

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        own = [word_list(t)[: self.max_tokens] for t in texts]
        distinct = list(dict.fromkeys(w for ws in own for w in ws))
        at = {w: i for i, w in enumerate(distinct)}
        rows = hashed_vectors(distinct, self.token_dim, 2, 4, b"t:") if distinct else np.zeros((0, self.token_dim), np.float32)
        return [rows[[at[w] for w in ws]] if ws else np.zeros((1, self.token_dim), np.float32) for ws in own]


ENCODERS: dict[str, Callable[..., Encoder]] = {"hash": HashEncoder}


def make_encoder(kind: str = "hash", fallback: bool = False, **options) -> Encoder:
    """A registered encoder; an unknown kind is an error unless a fallback to the hash encoder is allowed."""
    if kind in ENCODERS:
        return ENCODERS[kind](**options)
    if fallback:
        return HashEncoder(**options)
    raise ValueError(f"no encoder named {kind!r}; known: {sorted(ENCODERS)}")


def _row_lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), pa.float32()))


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Encoder | None = None, batch: int = 32) -> DataFrame:
    """(id_col, dense ARRAY<FLOAT>, tokens ARRAY<ARRAY<FLOAT>>) of every row with a text; the encoder sees batches of bounded size."""
    ensure_importable(df.sparkSession)
    model = encoder or HashEncoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(1).to_pylist()
                dense, mats = model.dense(texts), model.tokens(texts)
                if len(dense) != len(texts) or len(mats) != len(texts):
                    raise ValueError("the encoder returned another number of vectors than of texts")
                offsets = np.concatenate([[0], np.cumsum([len(m) for m in mats])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), _row_lists(dense), pa.ListArray.from_arrays(pa.array(offsets), _row_lists(np.concatenate(mats)))], names=["id", "dense", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("text is not null")
    return rows.mapInArrow(run, f"id {kind}, dense array<float>, tokens array<array<float>>").withColumnRenamed("id", id_col)


def encode_dense(df: DataFrame, id_col: str, text_col: str, encoder: Encoder | None = None, batch: int = 32) -> DataFrame:
    """(id_col, dense ARRAY<FLOAT>): encode without the token rows."""
    ensure_importable(df.sparkSession)
    model = encoder or HashEncoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                dense = model.dense(part.column(1).to_pylist())
                if len(dense) != part.num_rows:
                    raise ValueError("the encoder returned another number of vectors than of texts")
                yield pa.RecordBatch.from_arrays([part.column(0), _row_lists(dense)], names=["id", "dense"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("text is not null")
    return rows.mapInArrow(run, f"id {kind}, dense array<float>").withColumnRenamed("id", id_col)


def postings(df: DataFrame, id_col: str, text_col: str, hashed: bool = True) -> DataFrame:
    """(id_col, term, weight): 1 + ln(tf) for each word of each text; term is the CRC-32 of the word (with its mark), or the word itself."""
    term = F.crc32(F.encode(F.concat(F.lit("w:"), F.col("word")), "utf-8")) if hashed else F.col("word")
    return df.select(id_col, F.explode(T.words(F.col(text_col))).alias("word")).groupBy(id_col, term.alias("term")).agg((1 + F.ln(F.count("*"))).alias("weight"))


# signatures


def uniform_stream(seed: int, count: int) -> np.ndarray:
    """A counter-based stream of uniform numbers (SplitMix64's output function)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed % 2**64) + (np.arange(count, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z // np.uint64(2048)) / 2.0**53


@lru_cache(maxsize=8)
def hyperplanes(seed: int, rows: int, columns: int) -> np.ndarray:
    u = uniform_stream(seed, 2 * rows * columns).reshape(-1, 2)
    radius = np.sqrt(-2.0 * np.log(np.maximum(u[:, 0], 1e-12)))
    return (radius * np.cos(2.0 * np.pi * u[:, 1])).astype(np.float32).reshape(rows, columns)


def _packed(rows: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.packbits(rows @ planes >= 0, axis=1).view(">i8").astype(np.int64)


def signature(vector: Column, dims: int, bits: int = SIGNATURE_BITS, seed: int = SEED) -> Column:
    """Sides of random planes as ARRAY<LONG>. The planes follow from the seed; each worker makes them once."""

    @F.arrow_udf("array<bigint>")
    def sign(vectors: pa.Array) -> pa.Array:
        null = np.asarray(vectors.is_null())
        rows = np.zeros((len(vectors), dims), np.float32)
        rows[~null] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        words = _packed(rows, hyperplanes(seed, dims, bits))
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * words.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel()), mask=pa.array(null))

    return sign(vector.cast("array<float>"))


def token_signatures(tokens: Column, dims: int, bits: int = TOKEN_BITS, seed: int = SEED ^ 0x5D) -> Column:
    """ARRAY<ARRAY<LONG>>: one signature for each row of a token matrix."""

    @F.arrow_udf("array<array<bigint>>")
    def sign(mats: pa.Array) -> pa.Array:
        rows = mats.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
        words = _packed(rows, hyperplanes(seed, dims, bits))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
        sizes = [0 if m is None else len(m) for m in mats]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), inner, mask=pa.array(mats.is_null()))

    return sign(tokens.cast("array<array<float>>"))
