"""Operator 1: near-duplicates by SimHash.

A text's fingerprint has 128 bits: each distinct word votes with the 128 bits of its hash. Its 16 bytes with their
positions are 16 entries of an inverted index. Two fingerprints that differ in at most k bits share at least
16 - k of the 16 positional bytes: five of them for CERTAIN = 11 bits. A single byte has 256 values, so its lists would grow with the square of
the corpus; the index therefore holds the triples of positional bytes within each half of the
fingerprint (2 x 56 lists of 24 bits). Of any five shared bytes three lie in one half, so every pair within 11 bits meets in a list. Pairs that meet there
have their shared positional bytes tallied; those that reach the guaranteed five are verified by their exact Hamming distance. All pairs of a
list are covered, whatever its length: long lists are cut into shorter ones by two further bytes, of which a pair must share two as well.

Two texts whose distinct words overlap by 0.8 (Jaccard) lie 19.4 bits apart in the mean, with a standard deviation of 4.1, and may share no byte. No minimum is
guaranteed for them, so each text is in further lists, under the least hashes of its words (20 bands of 6): at overlap 0.8 a pair meets there with
probability 0.998, whatever its distance. Pairs that meet there within max_distance bits are taken as they are; those up to `far_distance`
bits apart (mean and three deviations) if the exact overlap of their distinct words is at least `overlap`.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable
from .arrow import kept, over_pieces
from .bpe import gather, sums
from .graph import components

BYTES = 16
#: Pairs within so many bits are found for certain: they share LEAST_SHARED positional bytes at least.
CERTAIN = 11
LEAST_SHARED = BYTES - CERTAIN
#: Pairs of a band within so many bits are near-copies without a look at their words.
MAX_DISTANCE = 18
#: Farther pairs count if their distinct words overlap by OVERLAP at least.
FAR_DISTANCE, OVERLAP = 31, 0.8
#: Lists by least hashes: BANDS of WIDTH.
BANDS, WIDTH = 20, 6
_ODD = np.random.default_rng(7).integers(1, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Positional triples: three of any five shared bytes lie in one half.
TRIPLES = np.array([t for half in (range(8), range(8, 16)) for t in itertools.combinations(half, 3)], np.int64)
#: Rows of a list of which all pairs are checked at once; rows of a list of triples from which it is cut by two further bytes.
SHORT, CUT = 64, 2048
#: Rows of a long list that are compared with all others before its groups are.
_LEADS = 16
#: Keys of bands begin here, those of triples end far below.
FIRST_BAND = 1 << 62


class Words:
    """Chunks between white space to hashed words; a worker keeps it from batch to batch."""

    CAP = 200_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hashes = np.zeros((0, BYTES), np.uint8)

    def learn(self, keys: list[str]) -> None:
        import re

        find = re.compile(r"\w+").findall
        base = len(self.ids)
        parts = []
        words, ids = self.words, self.ids
        known = len(words)
        for i, k in enumerate(keys):
            ids[k] = base + i
            parts.append([words.setdefault(w, len(words)) for w in find(k.lower())])
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(parts), np.int64)])
        new = itertools.islice(words, known, None)
        raw = b"".join(xxhash.xxh3_128_digest(w) for w in new)
        self.hashes = np.concatenate([self.hashes, np.frombuffer(raw, np.uint8).reshape(-1, BYTES)])

    def fingerprints(self, texts: list[str]) -> list[bytes]:
        return self.sketches(texts)[0]

    def sketches(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Fingerprints, and the keys of the bands' lists (8 bytes each, none for a text without words)."""
        if len(self.ids) > self.CAP:
            self.clear()
        keys: list[str] = []
        per = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            part = t.split()
            per[i] = len(part)
            keys += part
        new = [k for k in dict.fromkeys(keys) if k not in self.ids]
        if new:
            self.learn(new)
        ids = np.fromiter(map(self.ids.__getitem__, keys), np.int64, len(keys))
        words, n = gather(self.flat, self.start, self.count, ids)
        n = sums(n, per)
        width = len(self.words) + 1
        pairs = np.unique(np.repeat(np.arange(len(texts)), n) * width + words)
        doc, word = pairs // width, pairs % width
        out = np.zeros((len(texts), BYTES), np.uint8)
        bands = np.zeros((len(texts), BANDS), np.int64)
        if len(pairs):
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            ends = np.append(heads[1:], len(doc))
            at = 0
            while at < len(heads):  # a bounded number of words at a time, one text at least
                to = max(at + 1, int(np.searchsorted(ends, heads[at] + 200_000, side="right")))
                rows = slice(heads[at], ends[to - 1])
                votes = _votes(self.hashes, word[rows], heads[at:to] - heads[at])
                size = (ends[at:to] - heads[at:to])[:, None]
                out[doc[heads[at:to]]] = np.packbits(2 * votes > size, axis=1)
                bands[doc[heads[at:to]]] = _bands(self.hashes, word[rows], heads[at:to] - heads[at])
                at = to
        result = [r.tobytes() for r in out]
        for i in np.flatnonzero(n == 0).tolist():  # no words: equal texts only
            result[i] = xxhash.xxh3_128_digest(" ".join(texts[i].split())) if texts[i].split() else bytes(BYTES)
        return result, [b"" if m == 0 else b.tobytes() for m, b in zip(n.tolist(), bands)]


def _votes(hashes: np.ndarray, word: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each text the number of its words with each of the 128 bits set."""
    if len(heads) == 1 and len(word) > 100_000:
        total = np.zeros((1, BYTES * 8), np.int64)
        for at in range(0, len(word), 100_000):
            total += np.unpackbits(hashes[word[at : at + 100_000]], axis=1).sum(0, dtype=np.int64)
        return total
    return np.add.reduceat(np.unpackbits(hashes[word], axis=1), heads, axis=0, dtype=np.int32)


def _bands(hashes: np.ndarray, word: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each text the keys of its bands' lists: hashes of the least hashes of its words; above all keys of triples."""
    words = np.ascontiguousarray(hashes[word, :8]).view(np.uint64).ravel()
    out = np.zeros((len(heads), BANDS), np.uint64)
    for i in range(BANDS * WIDTH):
        least = np.minimum.reduceat(words * _ODD[i], heads)
        out[:, i // WIDTH] = (out[:, i // WIDTH] ^ (least >> np.uint64(29)) ^ least) * _MIX[i % WIDTH]
    out = (out ^ out >> np.uint64(31)) * _ODD[:BANDS]
    return (out >> np.uint64(2) | np.uint64(FIRST_BAND)).astype(np.int64)


def _fingerprint_piece(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column(2).to_pylist()
    at = [i for i, t in enumerate(texts) if t is not None]
    found: list[bytes | None] = [None] * len(texts)
    bands: list[bytes | None] = [None] * len(texts)
    for i, fp, b in zip(at, *kept(("simhash",), Words).sketches([texts[i] for i in at])):
        found[i], bands[i] = fp, b
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array(bands, pa.binary()), batch.column(3)], names=["id", "row", "fp", "bands", "whole"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: Column | None = None) -> DataFrame:
    """(id, row, fp BINARY, bands BINARY, whole) of every row of df: row is a hash of the text, fp and bands null for a null text; whole as given."""
    ensure_importable(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    text = df[text_col].cast("string")
    whole = F.lit(0).cast("bigint") if whole is None else whole
    return df.select(df[id_col].alias("id"), F.xxhash64(text).alias("row"), text.alias("text"), whole.alias("whole")).mapInArrow(over_pieces(_fingerprint_piece, 2), f"id {kind}, row bigint, fp binary, bands binary, whole bigint")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = len(TRIPLES)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            column = batch.column(0).slice(at, 2000)
            own = batch.column(1).slice(at, 2000).to_pylist()
            fps = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)
            b = fps.astype(np.int64)
            key = np.arange(t) << 24 | b[:, TRIPLES[:, 0]] << 16 | b[:, TRIPLES[:, 1]] << 8 | b[:, TRIPLES[:, 2]]
            parts = fps.view(">i8").astype(np.int64)
            bands = np.frombuffer(b"".join(own), np.int64)
            count = np.fromiter(map(len, own), np.int64, len(own)) // 8
            halves = np.concatenate([np.repeat(parts, t, axis=0), np.repeat(parts, count, axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key.ravel(), bands])), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["key", "hi", "lo"])


def _matches(x: np.ndarray, y: np.ndarray, most: int, least: int) -> np.ndarray:
    """Count filter and check: enough shared positional bytes, and at most so many bits apart (rows are 16 bytes)."""
    diff = x ^ y
    if not least:
        return np.bitwise_count(diff.view(np.uint64)).sum(1) <= most
    out = (diff == 0).sum(1) >= least
    out[out] = np.bitwise_count(np.ascontiguousarray(diff[out]).view(np.uint64)).sum(1) <= most
    return out


def _short_pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in each run [start, end), half a million at a time."""
    size = ends - starts
    last = np.repeat(ends, size)
    rows = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(last))
    for shift in range(1, int(size.max(initial=0))):
        more = rows + shift < last
        rows, last = rows[more], last[more]
        for at in range(0, len(rows), 500_000):
            yield rows[at : at + 500_000], rows[at : at + 500_000] + shift


class _Long:
    """The links of one long list: `near` holds pairs of rows that connect all rows within `most` bits (that share `least` bytes), `apart` the other pairs
    up to `far` bits apart whose ends aren't connected.

    A few rows are compared with all others first; a row that matches such a lead is in its group. After that only rows of different groups are
    compared, every pair of them, until they are in one group."""

    def __init__(self, fps: np.ndarray, most: int, far: int, least: int):
        self.fps, self.most, self.far, self.least = fps, most, far, least
        self.halves = np.ascontiguousarray(fps).view(np.uint64)
        self.label = np.arange(len(fps))
        self.near: list[tuple[int, int]] = []
        self.apart: list[np.ndarray] = []
        left = np.arange(len(fps))
        for _ in range(_LEADS):
            if len(left) < 2:
                break
            lead, left = left[0], left[1:]
            ok = np.concatenate([_matches(fps[lead][None, :], fps[left[at : at + 500_000]], most, least) for at in range(0, len(left), 500_000)])
            self.label[left[ok]] = lead
            self.near += [(int(lead), x) for x in left[ok].tolist()]
            left = left[~ok]
        for rows in self.parts():
            self.cross(rows)

    def parts(self) -> Iterator[np.ndarray]:
        """Rows among which all pairs are to be looked at; pairs that share `least` bytes are together in one of them."""
        n = len(self.fps)
        if not self.least or n <= CUT:
            yield np.arange(n)
            return
        open_ = np.flatnonzero((self.fps != self.fps[0]).any(0))  # bytes that all rows share are among the shared ones of every pair
        more = self.least - (BYTES - len(open_))
        if more < 2:
            yield np.arange(n)
            return
        for i, j in itertools.combinations(open_.tolist(), 2):
            key = self.fps[:, i].astype(np.int64) << 8 | self.fps[:, j]
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            starts, ends = np.concatenate([[0], cut]), np.append(cut, n)
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                yield order[s:e]

    def cross(self, rows: np.ndarray) -> None:
        label = self.label
        for at in range(0, len(rows), 256):
            for to in range(at, len(rows), 65_536):
                i, j = rows[at : at + 256], rows[to : to + 65_536]
                p, q = np.nonzero(label[i][:, None] != label[j][None, :])
                ahead = q + to > p + at
                p, q = i[p[ahead]], j[q[ahead]]
                for k in range(0, len(p), 500_000):
                    self.compare(p[k : k + 500_000], q[k : k + 500_000])
                label = self.label

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        n, label = len(self.fps), self.label
        ok = _matches(self.fps[a], self.fps[b], self.most, self.least)
        if self.far > self.most:
            bits = np.bitwise_count(self.halves[a] ^ self.halves[b]).sum(1)
            away = (bits > self.most) & (bits <= self.far)
            if away.any():
                self.apart.append(np.stack([a[away], b[away]], axis=1))
        a, b = a[ok], b[ok]
        if not len(a):
            return
        _, one = np.unique(label[a] * n + label[b], return_index=True)
        up = np.arange(n)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(a[one].tolist(), b[one].tolist()):
            p, q = sorted((root(label[x]), root(label[y])))
            if p != q:
                up[q] = p
                self.near.append((x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.label = up[label]

    def far_pairs(self) -> np.ndarray:
        pairs = np.concatenate(self.apart) if self.apart else np.zeros((0, 2), np.int64)
        return pairs[self.label[pairs[:, 0]] != self.label[pairs[:, 1]]]


def _bucket_edges(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = CERTAIN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in each run [start, end) of rows with one key of triples: they connect all pairs within `most` bits that reach the count filter."""
    size = ends - starts
    short = (size > 1) & (size <= SHORT)
    for a, b in _short_pairs(starts[short], ends[short]):
        ok = _matches(fps[a], fps[b], most, LEAST_SHARED)
        yield a[ok], b[ok]
    for s, e in zip(starts[size > SHORT].tolist(), ends[size > SHORT].tolist()):
        near = np.array(_Long(fps[s:e], most, most, LEAST_SHARED).near, np.int64).reshape(-1, 2) + s
        yield near[:, 0], near[:, 1]


def _band_edges(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int, far: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of the rows in each run [start, end) of one band: pairs that connect those within `most` bits (True), and the other pairs up to `far` bits apart (False)."""
    size = ends - starts
    short = (size > 1) & (size <= SHORT)
    halves = np.ascontiguousarray(fps).view(np.uint64)
    for a, b in _short_pairs(starts[short], ends[short]):
        bits = np.bitwise_count(halves[a] ^ halves[b]).sum(1)
        for ok, near in (((bits > 0) & (bits <= most), True), ((bits > most) & (bits <= far), False)):
            yield a[ok], b[ok], near
    for s, e in zip(starts[size > SHORT].tolist(), ends[size > SHORT].tolist()):
        found = _Long(fps[s:e], most, far, 0)
        near, apart = np.array(found.near, np.int64).reshape(-1, 2) + s, found.far_pairs() + s
        yield near[:, 0], near[:, 1], True
        yield apart[:, 0], apart[:, 1], False


class _Forest:
    """Edges of a task, less those between rows that are connected already."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def add(self, a: bytes, b: bytes) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def _edges(most: int, far: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, size = _Forest(), 0
        held_k, held_f = np.zeros(0, np.int64), np.zeros((0, BYTES), np.uint8)

        def work(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            cut = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cut]), np.append(cut, len(keys))
            found: list[tuple[bytes, bytes, bool]] = []
            triples = keys[starts] < FIRST_BAND
            for a, b in _bucket_edges(fps, starts[triples], ends[triples], min(most, CERTAIN)):
                for x, y in zip(a.tolist(), b.tolist()):
                    p, q = fps[x].tobytes(), fps[y].tobytes()
                    if forest.add(p, q):
                        found.append((p, q, True))
            apart: set[tuple[bytes, bytes]] = set()
            for a, b, near in _band_edges(fps, starts[~triples], ends[~triples], most, far):
                for x, y in zip(a.tolist(), b.tolist()):
                    p, q = fps[x].tobytes(), fps[y].tobytes()
                    if near:
                        if forest.add(p, q):
                            found.append((p, q, True))
                    elif forest.root(p) != forest.root(q):
                        apart.add((min(p, q), max(p, q)))
            found += [(p, q, False) for p, q in sorted(apart) if forest.root(p) != forest.root(q)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.binary()), pa.array([y for _, y, _ in found], pa.binary()), pa.array([z for _, _, z in found], pa.bool_())], names=["a", "b", "near"]) if found else None

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal waiting, rows
            keys = np.concatenate([k for k, _ in waiting])
            fps = np.concatenate([f for _, f in waiting])
            end = len(keys) if last else int(np.searchsorted(keys, keys[-1], side="left"))
            out = work(keys[:end], fps[:end]) if end else None
            waiting, rows = [(keys[end:], fps[end:])], len(keys) - end
            return out

        for batch in batches:
            keys = batch.column(0).to_numpy()
            halves = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).astype(">i8")
            waiting.append((keys, halves.view(np.uint8).reshape(-1, BYTES)))
            rows += len(keys)
            if rows >= 200_000 and keys[-1] != waiting[0][0][0]:
                out = flush(False)
                if out is not None:
                    yield out
                if len(forest.up) > 1_000_000:  # forgetting only means that some edges come twice
                    forest = _Forest()
        if rows:
            out = flush(True)
            if out is not None:
                yield out

    return run


def fingerprint_edges(fps: DataFrame, max_distance: int = MAX_DISTANCE, far_distance: int = FAR_DISTANCE) -> DataFrame:
    """Edges (a, b, near) between the distinct fingerprints of fps (fp, bands). Near ones connect all pairs within CERTAIN bits and those of a band within
    max_distance bits; the others share a band, are up to far_distance bits apart and are to be verified. Pairs whose ends
    are connected already may be left out. A task holds the distinct fingerprints of one list, 24 bytes each, at a time."""
    posts = fps.mapInArrow(_postings, "key bigint, hi bigint, lo bigint")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return posts.repartition(max(n, 1), "key").sortWithinPartitions("key").mapInArrow(_edges(max_distance, far_distance), "a binary, b binary, near boolean")


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    find = re.compile(r"\w+").findall
    for batch in batches:
        sets = [np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in set(find(t.lower()))], np.uint64)).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["row", "words"])


def _overlapping(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sigs: DataFrame, df: DataFrame, text_col: str, overlap: float) -> DataFrame:
    """Pairs (a, b) of fingerprints whose texts' distinct words overlap enough; of the texts with one fingerprint, one decides."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    rows = checkpointed(sigs.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("row")))
    text = df[text_col].cast("string")
    texts = df.select(F.xxhash64(text).alias("row"), text.alias("text")).where("text is not null").join(rows.select("row"), "row", "left_semi").dropDuplicates(["row"])
    sets = checkpointed(texts.mapInArrow(_word_sets, "row bigint, words binary").join(rows, "row").select("fp", "words"))
    left, right = sets.select(F.col("fp").alias("a"), F.col("words").alias("x")), sets.select(F.col("fp").alias("b"), F.col("words").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_overlapping(overlap), "a binary, b binary")


def _grouped(sigs: DataFrame, df: DataFrame, text_col: str, max_distance: int, far_distance: int, overlap: float) -> DataFrame:
    """sigs with the column grp: a fingerprint that the rows of a group share."""
    edges = checkpointed(fingerprint_edges(sigs.select("fp", "bands").distinct(), max_distance, far_distance))
    far = _verified(edges.where("not near").select("a", "b").distinct(), sigs, df, text_col, overlap)
    roots = components(edges.where("near").select("a", "b").union(far)).select(F.col("node").alias("fp"), "root")
    return sigs.join(roots, "fp", "left").withColumn("grp", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, far_distance: int = FAR_DISTANCE, overlap: float = OVERLAP) -> DataFrame:
    """(id_col, duplicate_of) for every row that has a near-copy with a smaller id: duplicate_of is the smallest id of its group.

    Groups are the connected components of "within CERTAIN bits, or in a band together and within max_distance bits, or in a band together, within
    far_distance bits and with distinct words that overlap by `overlap`". Rows without a near-copy aren't in the result.
    A null text is in no group. Texts without a word (empty, white space, punctuation) form groups of equal texts up to white space.
    Repeated rows are near-copies of each other: all but one are in the result, even with the same id. A null id comes last
    in its group. Other columns of df, whatever their names, are ignored; an empty table gives no rows. Texts are read whole.
    """
    sigs = checkpointed(fingerprints(df, id_col, text_col).where("fp is not null").withColumn("key", F.monotonically_increasing_id()))
    named = _grouped(sigs, df, text_col, max_distance, far_distance, overlap).select("id", "row", "key", "grp")
    first = named.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "key")).alias("first"))
    out = named.join(first, "grp").where(F.col("key") != F.col("first.key"))
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("duplicate_of"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, far_distance: int = FAR_DISTANCE, overlap: float = OVERLAP) -> DataFrame:
    """df with one row of each group of near_duplicates, that with the smallest id, and all rows with a null text.

    All columns stay as they are. Of rows with the same id and text that stays whose columns have the least hash; rows that are equal in all columns
    are interchangeable. Nulls, empty texts and tables: as in near_duplicates.
    """
    whole = F.xxhash64(F.lit(1), *[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])
    sigs = checkpointed(fingerprints(df, id_col, text_col, whole).where("fp is not null"))
    named = _grouped(sigs, df, text_col, max_distance, far_distance, overlap)
    first = named.groupBy("grp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "whole")).alias("first"))
    tag = uuid.uuid4().hex[:8]
    row, all_, n = (f"_{x}_{tag}" for x in ("row", "all", "n"))
    kept = first.select(F.col("first.row").alias(row), F.col("first.whole").alias(all_))
    docs = df.withColumns({row: F.xxhash64(df[text_col].cast("string")), all_: whole})
    # the window keeps the join's partitioning: documents are exchanged once
    with_text = docs.where(docs[text_col].isNotNull()).join(kept, [row, all_], "left_semi")
    one = with_text.withColumn(n, F.row_number().over(Window.partitionBy(row, all_).orderBy(row))).where(F.col(n) == 1)
    return one.select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(df.where(df[text_col].isNull()))
