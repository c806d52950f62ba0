"""Operator 4: content-defined chunks of payloads, deduplicated, put together again and verified.

A gear hash rolls over the payload; a chunk ends where its ten upper bits are zero, after MIN bytes at least and MAX at most, so that equal passages
give equal chunks wherever they stand. Chunk digests are deduplicated by a Spark join. To verify, every payload is put together again from
the chunks that the store keeps, in order; payloads and chunks travel in compressed packs.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ensure_importable
from .arrow import pieces

MIN, MAX, BITS = 256, 8192, 10
_WINDOW = 32
#: Payload bytes that a task collects before it sends its packs, and payload bytes of a bucket.
_PACK_BYTES, BUCKET_BYTES = 32 << 20, 64 << 20
#: Joins name media and chunks by the first bytes of their SHA-256; the whole of it verifies what is put together.
NAME = 16


def _gear(seed: int = 20240229) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(payload: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the payload's chunks; none for an empty payload. The hash at a byte is the sum of the last 32 bytes' gear values, each shifted by its age."""
    n = len(payload)
    if n <= MIN:
        return [n] if n else []
    ends: list[int] = []
    found: list[int] = []
    at = 0
    for base in range(0, n, 1 << 20):  # a bounded stretch at a time, with the bytes before it that the hash still sees
        lead = min(base, _WINDOW)
        h = gear[np.frombuffer(payload[base - lead : base + (1 << 20)], np.uint8)]
        width = 1
        while width < _WINDOW:
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        here = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + base - lead + 1
        found += here[here > base].tolist()
    while n - at > MIN:
        i = bisect_left(found, at + MIN)
        end = min(found[i] if i < len(found) else n, at + MAX, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def _bucket(key: bytes, n: int) -> int:
    return int.from_bytes(key[:7], "big") % n


class _Packs:
    """Records to buckets, in compressed packs."""

    def __init__(self):
        self.out: dict[int, list[bytes]] = {}
        self.held = 0

    def add(self, bucket: int, *parts: bytes) -> None:
        record = struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)
        self.out.setdefault(bucket, []).append(record)
        self.held += len(record)

    def full(self) -> bool:
        return self.held > _PACK_BYTES

    def send(self) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=9)
        for b in sorted(self.out):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([z.compress(b"".join(self.out[b]))], pa.binary()), *(pa.nulls(1, pa.binary()),) * 2, pa.nulls(1, pa.int32())], names=["bucket", "pack", "at", "chunk", "to"])
        self.out, self.held = {}, 0


def _records(pack: bytes, k: int) -> Iterator[list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(pack)
    at, head = 0, struct.Struct(f"<{k}I")
    while at < len(raw):
        sizes = head.unpack_from(raw, at)
        at += head.size
        row = []
        for s in sizes:
            row.append(raw[at : at + s])
            at += s
        yield row


def chunks(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, media BINARY, n_bytes, ends ARRAY<INT>, digests ARRAY<BINARY>) of every row of df: media is the payload's SHA-256, digests the chunks'."""
    ensure_importable(df.sparkSession)
    gear = _gear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                media, size, ends, digests = [], [], [], []
                for p in piece.column(1).to_pylist():
                    if p is None:
                        for x in (media, size, ends, digests):
                            x.append(None)
                        continue
                    e = cuts(p, gear)
                    media.append(hashlib.sha256(p).digest())
                    size.append(len(p))
                    ends.append(e)
                    digests.append([hashlib.sha256(p[a:b]).digest() for a, b in zip([0, *e], e)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(media, pa.binary()), pa.array(size, pa.int64()), pa.array(ends, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))], names=["id", "media", "n_bytes", "ends", "digests"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[payload_col].cast("binary").alias("payload")).mapInArrow(run, f"id {kind}, media binary, n_bytes bigint, ends array<int>, digests array<binary>")


def _rebuilt(df: DataFrame, payload_col: str, uses: DataFrame, firsts: DataFrame, buckets: int) -> DataFrame:
    """(m, good): for each distinct payload whether it comes out again when its chunks are fetched from the deduplicated store in order.

    The store keeps a chunk with the medium that has it first. Spark joins find the chunks that a medium needs from others. Payloads meet these lists once, in buckets
    by medium; media that keep all their chunks are put together there. The others travel on with what they keep, and a chunk that others need is
    sent once to each bucket in which it is needed, however many media need it. Lists come before payloads, and these pass one pack at a time.
    """
    gear = _gear()
    keepers = firsts.where("shared").select("d", F.col("first.m").alias("keeper"))
    foreign = uses.select("m", "d").join(keepers, "d").where("m <> keeper")
    bucket = lambda c: F.pmod(F.conv(F.hex(F.substring(c, 1, 7)), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
    asks = F.struct(F.col("m").alias("at"), F.col("d").alias("chunk"), F.lit(None).cast("int").alias("to"))
    gives = F.struct(F.col("keeper").alias("at"), F.col("d").alias("chunk"), bucket("m").alias("to"))
    moves = foreign.select(F.explode(F.array(asks, gives)).alias("x")).select("x.*").distinct()
    lists = moves.select(bucket("at").alias("bucket"), F.lit(None).cast("binary").alias("pack"), "at", "chunk", "to")
    kind = "bucket int, pack binary, at binary, chunk binary, to int"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs()
        seen: set[bytes] = set()
        for batch in batches:
            for piece in pieces(batch, 0):
                for p in piece.column(0).to_pylist():
                    media = hashlib.sha256(p).digest()
                    if media not in seen:
                        seen.add(media)
                        packs.add(_bucket(media, buckets), media, p)
                if packs.full():
                    yield from packs.send()
                    seen = set()
        yield from packs.send()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needs: dict[bytes, set[bytes]] = {}
        gives: dict[bytes, dict[bytes, list[int]]] = {}
        packs, done = _Packs(), set()
        for batch in batches:
            for pack, at, chunk, to in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                if pack is None and to is None:
                    needs.setdefault(at, set()).add(chunk)
                elif pack is None:
                    gives.setdefault(at, {}).setdefault(chunk, []).append(to)
                else:
                    for media, payload in _records(pack, 2):
                        m = media[:NAME]
                        if m in done:
                            continue
                        done.add(m)
                        e, home = cuts(payload, gear), _bucket(m, buckets)
                        names = [hashlib.sha256(payload[a:b]).digest() for a, b in zip([0, *e], e)]
                        away, asked = needs.get(m, ()), gives.get(m, {})
                        own: dict[bytes, bytes] = {}
                        for d, a, b in zip(names, [0, *e], e):
                            if d[:NAME] not in away:
                                own[d] = payload[a:b]
                        for d, c in own.items():
                            for to in asked.get(d[:NAME], ()):
                                packs.add(to, b"C", d, c, b"")
                        if away:
                            # its ordered list, and what it keeps itself
                            packs.add(home, b"M", media, b"".join(names), b"".join(struct.pack("<I", len(c)) + c for c in own.values()))
                        else:
                            h = hashlib.sha256()
                            for d in names:
                                h.update(own[d])
                            packs.add(home, b"W", m, b"1" if h.digest() == media else b"0", b"")
                    if packs.full():
                        yield from packs.send()
        yield from packs.send()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: dict[bytes, bytes] = {}
        waiting: list[tuple[bytes, bytes, bytes]] = []

        def answer(found: list[tuple[bytes, bool]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.binary()), pa.array([g for _, g in found], pa.bool_())], names=["m", "good"])

        for batch in batches:
            for pack in batch.column(1).to_pylist():
                whole = []
                for tag, a, b, c in _records(pack, 4):
                    if tag == b"W":
                        whole.append((a, b == b"1"))
                    elif tag == b"M":
                        waiting.append((a, b, c))
                    else:
                        chunk[a] = b
                yield answer(whole)
        good = []
        for media, names, own in waiting:
            kept, at = [], 0
            while at < len(own):
                n = struct.unpack_from("<I", own, at)[0]
                kept.append(own[at + 4 : at + 4 + n])
                at += 4 + n
            here = {hashlib.sha256(c).digest(): c for c in kept}
            h = hashlib.sha256()
            for i in range(0, len(names), 32):
                d = names[i : i + 32]
                h.update(here.get(d) or chunk.get(d, b""))
            good.append((media[:NAME], h.digest() == media))
        yield answer(good)

    payloads = df.select(df[payload_col].cast("binary").alias("payload")).where("length(payload) > 0")
    sent = payloads.mapInArrow(send, kind).unionByName(lists)
    met = _to_buckets(sent, buckets).sortWithinPartitions(F.col("pack").isNotNull()).mapInArrow(store, kind)
    return _to_buckets(met, buckets).mapInArrow(rebuild, "m binary, good boolean")


def _to_buckets(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartitionById(buckets, F.col("bucket"))


def media_chunks(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", buckets: int | None = None) -> DataFrame:
    """(id_col, n_bytes, sha256, chunk_digests ARRAY<BINARY>, chunk_ends ARRAY<INT>, n_chunks, n_new, verified) of every row of df.

    n_new counts the chunks that no row with a smaller (id, place) has: the store holds exactly those. verified: the payload, put together from
    the store by its ordered list, has its own SHA-256 again. buckets: tasks of the exchange of payloads, by default spark.sql.shuffle.partitions or, if
    more, one for each BUCKET_BYTES of payload.

    A null payload has nulls; an empty one no chunks, and is verified. A payload of up to MIN bytes is one chunk. Repeated rows have new chunks
    in one of them only; null ids come last. Other columns are ignored; an empty table gives no rows. Payloads are read whole.
    """
    spark = df.sparkSession
    rows = checkpointed(chunks(df, id_col, payload_col).withColumn("key", F.monotonically_increasing_id()))
    if buckets is None:
        whole = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // BUCKET_BYTES))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    uses = rows.select(F.substring("media", 1, NAME).alias("m"), order.alias("at"), F.posexplode("digests").alias("place", "digest")).withColumn("d", F.substring("digest", 1, NAME))
    firsts = uses.groupBy("d").agg(F.min(F.struct("at", "place", "m")).alias("first"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    firsts = firsts.select("d", F.struct("first.m", "first.at.key").alias("first"), (F.col("lo") != F.col("hi")).alias("shared"))
    new = firsts.groupBy("first").agg(F.count("*").alias("n_new")).select("first.m", "first.key", "n_new")
    rebuilt = _rebuilt(df, payload_col, uses, firsts, buckets)
    # equal payloads have the same first row for all their chunks: a medium has one row in new, or none
    found = rebuilt.join(new.withColumnRenamed("key", "new_key"), "m", "left")
    out = rows.withColumn("m", F.substring("media", 1, NAME)).join(found, "m", "left")
    size = F.size("digests")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.lower(F.hex("media")).alias("sha256"),
        F.col("digests").alias("chunk_digests"),
        F.col("ends").alias("chunk_ends"),
        F.when(F.col("media").isNotNull(), size).alias("n_chunks"),
        F.when(F.col("media").isNotNull(), F.when(F.col("key") == F.col("new_key"), F.col("n_new")).otherwise(F.lit(0))).alias("n_new"),
        F.when(F.col("media").isNotNull(), (size == 0) | F.coalesce("good", F.lit(False))).alias("verified"),
    )


def chunk_store(df: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(digest, payload): one row for each distinct chunk of df's payloads.

    Null and empty payloads have no chunks; repeated rows and repeated passages add nothing; other columns, the ids among them, are ignored, whatever their names; an empty table gives
    no rows. Payloads are read whole. There are no ties: rows of one digest are equal.
    """
    gear = _gear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                found: dict[bytes, bytes] = {}
                for p in piece.column(0).to_pylist():
                    e = cuts(p, gear)
                    for a, b in zip([0, *e], e):
                        found[hashlib.sha256(p[a:b]).digest()] = p[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "payload"])

    ensure_importable(df.sparkSession)
    return df.select(df[payload_col].cast("binary").alias("payload")).where("payload is not null").mapInArrow(run, "digest binary, payload binary").dropDuplicates(["digest"])


def reconstruct(listed: DataFrame, store: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload BINARY) of every row of media_chunks' result, from a chunk store alone.

    A list with a chunk that the store lacks is an error; a null list gives a null, an empty one the empty payload. Repeated rows and null ids are kept, each with its payload. Other
    columns of listed, whatever their names, are ignored; an empty table gives no rows. store has a row for each digest once. Payloads are put together
    in time proportional to their length.
    """
    rows = listed.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col("chunk_digests").alias("digests"))
    rows = checkpointed(rows)
    parts = rows.select("key", F.posexplode("digests").alias("place", "digest")).join(store, "digest", "left")
    parts = parts.withColumn("payload", F.when(F.col("payload").isNull(), F.raise_error(F.lit("a chunk is missing")).cast("binary")).otherwise(F.col("payload")))
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "payload"))).alias("p"))
    glued = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["payload"])), ""))
    return rows.join(whole, "key", "left").select(F.col("id").alias(id_col), F.when(F.col("digests").isNotNull(), F.coalesce(glued, F.lit(b""))).alias("payload"))
