"""SimHash, epsilon grid join, media chunks."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quern.llm import ego, media, simhash
from quern.session import table

from .common import LONG, messy

DOCS = "doc_id bigint, text string"


def brute_groups(texts: list[str]) -> dict[int, int]:
    """By comparing all pairs: each place's first place of its group, by the operator's definition."""
    import re

    fps, bands = simhash.Words().sketches(texts)
    m = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 16)
    lists = [set(np.frombuffer(b, np.int64).tolist()) for b in bands]
    words = [set(re.findall(r"\w+", t.lower())) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        bits = np.bitwise_count(m[i] ^ m[i + 1 :]).sum(1)
        for j in (np.flatnonzero(bits <= simhash.FAR_DISTANCE) + i + 1).tolist():
            n = bits[j - i - 1]
            near = n <= simhash.CERTAIN or (lists[i] & lists[j] and (n <= simhash.MAX_DISTANCE or len(words[i] & words[j]) >= simhash.OVERLAP * len(words[i] | words[j])))
            if near:
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(i) for i in range(len(texts))}


def test_simhash_against_all_pairs(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pandas().sort_values("doc_id")
    ids = t.doc_id.tolist()
    want = {ids[i]: ids[r] for i, r in brute_groups(t.text.tolist()).items() if r != i}
    got = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(table(spark, sf, "documents")).collect()}
    assert got == want and len(want) > 10


def test_simhash_of_made_up_copies_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    texts = []
    for g in range(20):
        words = [f"w{x}" for x in rng.choice(3000, int(rng.integers(20, 120)), replace=False)]
        for _ in range(int(rng.integers(1, 40))):  # chains of small changes
            texts.append(" ".join(words))
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"w{rng.integers(3000)}"
    got = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {i: r for i, r in brute_groups(texts).items() if r != i}
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r.doc_id for r in kept} == set(range(len(texts))) - set(got)


def test_fingerprint_is_the_vote_of_distinct_words():
    import xxhash

    def naive(words):
        bits = np.sum([np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(w), np.uint8)).astype(int) for w in sorted(set(words))], axis=0)
        return np.packbits(2 * bits > len(set(words))).tobytes()

    texts = ["The cat, the CAT and a dog", "été à l'ombre", "x"]
    words = [["the", "cat", "and", "a", "dog"], ["été", "à", "l", "ombre"], ["x"]]
    assert simhash.Words().fingerprints(texts) == [naive(w) for w in words]
    long_words = [f"w{i}" for i in range(250_000)]
    assert simhash.Words().fingerprints([" ".join(long_words)]) == [naive(long_words)]


def chains(rng, n, step, shared):
    """Fingerprints that share their first bytes, each a few bits from the one before, in mixed order."""
    rows = np.zeros((n, 16), np.uint8)
    at = rng.integers(0, 256, 16, dtype=np.uint8)
    for i in range(n):
        if i % 37 == 0:  # a new chain
            at = at.copy()
            at[shared:] = rng.integers(0, 256, 16 - shared, dtype=np.uint8)
        for bit in rng.choice((16 - shared) * 8, step, replace=False):
            at[shared + bit // 8] ^= np.uint8(1 << (bit % 8))
        rows[i] = at
    return rows[rng.permutation(n)]


def forest_of(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in pairs:
        p, q = sorted((root(x), root(y)))
        up[q] = p
    return {i: root(i) for i in range(n)}


@pytest.mark.parametrize("n,step,cut", [(74, 8, 2048), (1000, 8, 2048), (1000, 8, 100), (1000, 3, 100), (300, 11, 64)])
def test_chains_in_long_lists_give_the_groups_of_all_pairs(monkeypatch, n, step, cut):
    monkeypatch.setattr(simhash, "CUT", cut)
    for seed in range(4):
        rows = chains(np.random.default_rng(seed), n, step, 3)
        shared = (rows[:, None] == rows[None]).sum(2)
        near = (np.bitwise_count(rows[:, None] ^ rows[None]).sum(2) <= 11) & (shared >= 5)
        want = forest_of(n, zip(*(x.tolist() for x in np.nonzero(near))))
        found = [(x, y) for a, b in simhash._bucket_edges(rows, np.array([0]), np.array([n])) for x, y in zip(a.tolist(), b.tolist())]
        assert forest_of(n, found) == want and len(set(want.values())) > n // 40
        assert len(found) < n + simhash._LEADS * n // 10 or n < 100


def test_long_bands_give_near_and_far_pairs_of_all():
    rows = chains(np.random.default_rng(9), 400, 12, 0)
    bits = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2)
    want = forest_of(400, zip(*(x.tolist() for x in np.nonzero(bits <= 18))))
    near, far = [], set()
    for a, b, ok in simhash._band_edges(rows, np.array([0]), np.array([400]), 18, 31):
        if ok:
            near += zip(a.tolist(), b.tolist())
        else:
            far |= set(zip(a.tolist(), b.tolist()))
    assert forest_of(400, near) == want
    assert {tuple(sorted(p)) for p in far} == {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero((bits > 18) & (bits <= 31)))) if i < j and want[i] != want[j]}


def test_pairs_within_eleven_bits_always_meet():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 256, 16, dtype=np.uint8)
        b = a.copy()
        for bit in rng.choice(128, 11, replace=False):
            b[bit // 8] ^= np.uint8(1 << (bit % 8))
        same = a == b
        assert same[simhash.TRIPLES].all(1).any()
        assert simhash._matches(a[None], b[None], simhash.CERTAIN, simhash.LEAST_SHARED).all()


def test_copies_farther_apart_are_found_by_word_overlap(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    while len(want) < 30:
        words = [f"w{x}" for x in rng.choice(100_000, 200, replace=False)]
        copy = words[:182] + [f"v{x}" for x in rng.choice(100_000, 18, replace=False)]
        a, b = (np.frombuffer(x, np.uint8) for x in simhash.Words().fingerprints([" ".join(words), " ".join(copy)]))
        if np.bitwise_count(a ^ b).sum() > simhash.MAX_DISTANCE:  # overlap 0.83
            i = len(rows)
            rows += [(i, " ".join(words)), (i + 1, " ".join(copy)), (i + 2, " ".join(words[:140] + [f"u{x}" for x in rng.choice(100_000, 60, replace=False)]))]
            want[i + 1] = i
    got = {r.doc_id: r.duplicate_of for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got.get(d) == r for d, r in want.items()) >= 28
    assert all(d % 3 == 1 for d in got)  # overlap 0.54 isn't enough


def test_simhash_edge_cases(spark):
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(1, prose), (2, prose + "."), (3, None), (4, ""), (5, "   "), (6, "?!"), (7, "?!"), (8, "something else entirely here"), (None, prose), (2, prose + "."), (9, LONG), (10, LONG + " end"), (11, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 1), (2, 1), (None, 1), (5, 4), (7, 6), (10, 9)], key=str)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8, 9, 11]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_extra_columns(spark):
    df = messy(spark)
    kept = simhash.drop_near_duplicates(df)
    assert kept.schema == df.schema
    assert kept.count() == df.count() - simhash.near_duplicates(df).count()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string, v int, y int, block int")


def classes_of(x, least=0.95):
    """By comparing all pairs: (smallest place of the class, number of links) of every place."""
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 6) >= least
    np.fill_diagonal(near, True)
    root = np.arange(len(x))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(x))])
        if (new == root).all():
            return [(int(r), int(n) - 1) for r, n in zip(root, near.sum(1))]
        root = new


def clustered(seed, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dims))
    chain = np.cumsum(rng.normal(size=(25, dims)) * 0.2, axis=0) + 2 * base[50]
    return np.concatenate([base, base[:30] + rng.normal(size=(30, dims)) * 0.15, base[:5], np.repeat(base[:1], 400, 0) + rng.normal(size=(400, dims)) * 0.02, np.repeat(base[1:2], 300, 0) + rng.normal(size=(300, dims)) * 0.15, chain]).astype(np.float32)


@pytest.mark.parametrize("seed,block", [(0, 512), (1, 64), (2, 7)])
def test_grid_join_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ego, "BLOCK_LEAST", block)
    monkeypatch.setattr(ego, "BLOCK_MOST", block)
    x = clustered(seed)
    df = vectors(spark, [(i, r.tolist(), "a", 1, 1, 1) for i, r in enumerate(x)]).repartition(4)
    got = {r.vec_id: (r.class_id, r.n_links) for r in ego.near_classes(df).collect()}
    want = classes_of(x)
    assert [got[i] for i in range(len(x))] == want
    assert len({c for c, _ in want}) < 80 and sum(n > 300 for _, n in want) > 300


def test_grid_join_query_against_its_sql(spark, tmp_path):
    import duckdb

    from quern.llm import queries

    x = clustered(5, 8)[:200]
    vectors(spark, [(i, r.tolist(), "a", 1, 1, 1) for i, r in enumerate(x)] + [(900, None, "", 0, 0, 0), (901, [0.0, 0.0], "", 0, 0, 0), (902, [1.0, None], "", 0, 0, 0)]).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.OP3_SQL).fetchall()
    got = [tuple(r) for r in queries.op3_embeddings(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(n or 0 for _, _, n in got) > 1000


@pytest.mark.parametrize("own", [True, False])
def test_interval_join_skips_nothing(own):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 6))
    x[:200] = x[0] + rng.normal(size=(200, 6)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(np.floor(x[:, ::-1] / 0.3).T)]
    axes, n = np.eye(6), rng.integers(1, 4, 700)
    near = np.round(x @ x.T, 6) >= 0.95
    split = 700 if own else int(np.median(np.flatnonzero(near.sum(1) > 150)))  # within the dense rows
    eps, sure = (0.1 + 1e-6) ** 0.5 + 1e-6, (0.1 - 2e-9) ** 0.5 - 1e-9
    p = ego.Sequence(x[:split], n[:split], axes)
    if own:
        found, weight = ego.link(p, p, True, 0.95, eps, sure), near * n - np.diag(n)
    else:
        near[:split, :split] = near[split:, split:] = False
        found, weight = ego.link(p, ego.Sequence(x[split:], n[split:], axes), False, 0.95, eps, sure), near * n
    assert found.count.tolist() == weight.sum(1).tolist() and found.count.max() > 100
    root = found.settle()
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(near)))
    assert (root <= np.arange(700)).all()


def test_grid_join_edge_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, [2.0, 0.0, 0.0]), (2, one), (None, one), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0, 0.0]), (12, [1.0, 0.01]), (9, [0.0, 1.0, 0.0]), (10, [float("inf"), 0.0, 0.0]), (None, [0.0, 0.0, 1.0])]
    got = ego.near_classes(vectors(spark, [(*r, "x", 0, 0, 0) for r in rows])).collect()
    unusable = [(i, None, None) for i in (3, 4, 5, 6, 7, 10)]
    want = [(1, 1, 3), (2, 1, 3), (2, 1, 3), (None, 1, 3), (8, 8, 1), (12, 8, 1), (9, 9, 0), (None, None, 0), *unusable]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert ego.near_classes(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in ego.near_classes(vectors(spark, [(1, one, "x", 0, 0, 0)])).collect()] == [(1, 1, 0)]
    assert [tuple(r) for r in ego.near_classes(vectors(spark, [(1, None, "x", 0, 0, 0)])).collect()] == [(1, None, None)]
    with pytest.raises(ValueError):
        ego.near_classes(vectors(spark, []), min_cosine=0)


def naive_cuts(payload: bytes) -> list[int]:
    gear, ends, at = media._gear().tolist(), [], 0
    while at < len(payload):
        end = min(len(payload), at + media.MAX)
        for i in range(at + media.MIN, end + 1):
            h = 0
            for b in payload[max(0, i - 32) : i]:
                h = ((h << 1) + gear[b]) % 2**32
            if h >> (32 - media.BITS) == 0:
                end = i
                break
        ends.append(end)
        at = end
    return ends


def test_chunk_ends_against_a_rolling_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 256, 257, 3000, 20_000):
        p = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.cuts(p, media._gear()) == naive_cuts(p)
    big = rng.integers(0, 256, (1 << 20) + 9000, dtype=np.uint8).tobytes()  # longer than a stretch
    ends = media.cuts(big, media._gear())
    assert ends == naive_cuts(big)
    assert media.cuts(bytes(20_000), media._gear())[-1] == 20_000


def test_equal_passages_give_equal_chunks():
    rng = np.random.default_rng(5)
    body = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    digests = []
    for p in (body, b"some bytes before " * 7 + body):
        e = media.cuts(p, media._gear())
        digests.append({hashlib.sha256(p[a:b]).digest() for a, b in zip([0, *e], e)})
    assert len(digests[0] & digests[1]) >= len(digests[0]) - 2


def test_media_round_trip_and_counts(spark, sf):
    pages = table(spark, sf, "pages")
    rows = media.media_chunks(pages).collect()
    payloads = {r.page_id: r.html.encode() for r in pages.collect()}
    seen: set[bytes] = set()
    new = {}
    for i in sorted(payloads):
        e = media.cuts(payloads[i], media._gear())
        own = [hashlib.sha256(payloads[i][a:b]).digest() for a, b in zip([0, *e], e)]
        new[i] = len(set(own) - seen)
        seen |= set(own)
    assert len(rows) == len(payloads)
    for r in rows:
        assert r.verified and r.sha256 == hashlib.sha256(payloads[r.page_id]).hexdigest() and r.n_bytes == len(payloads[r.page_id])
        assert r.n_new == new[r.page_id] and r.n_chunks == len(r.chunk_digests) == len(r.chunk_ends)
    back = media.reconstruct(media.media_chunks(pages), media.chunk_store(pages))
    assert {r.page_id: bytes(r.payload) for r in back.collect()} == payloads


def test_media_edge_cases(spark):
    long = bytes(range(256)) * 4000
    rows = [(1, b"abc"), (2, b"abc"), (3, None), (4, b""), (1, b"abc"), (None, b"abc"), (5, long)]
    df = spark.createDataFrame([(*r, "m", 1, [b"d"]) for r in rows], "page_id bigint, html binary, media string, key int, digests array<binary>")
    got = media.media_chunks(df).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[3].n_chunks is None and by[3].verified is None and by[4].n_chunks == 0 and by[4].verified and by[5].verified
    assert sorted(r.n_new for r in got if r.n_bytes == 3) == [0, 0, 0, 1]
    assert by[None].n_new == 0
    back = media.reconstruct(media.media_chunks(df), media.chunk_store(df)).collect()
    assert sorted(((r.page_id, None if r.payload is None else bytes(r.payload)) for r in back), key=str) == sorted(rows, key=str)
    empty = df.limit(0)
    assert media.media_chunks(empty).count() == 0 and media.chunk_store(empty).count() == 0
    with pytest.raises(Exception, match="missing"):
        media.reconstruct(media.media_chunks(df), media.chunk_store(df).where("octet_length(payload) > 3")).collect()
