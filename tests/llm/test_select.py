"""Quality classifier, source mixing, shards."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, quality, sharding
from quern.llm.arrow import string_bytes
from quern.session import table

from .common import messy

BIG = "/root/testdata/sf0.01"


def stats_of(text: str) -> list[float]:
    """The statistics, byte by byte."""
    raw = text.encode()
    n = len(raw)
    size = max(n, 1)
    kind = Counter(int(quality._CLASS[b]) for b in raw)
    words = "".join("\n" if b in b" \t\n\r" else chr(b) for b in raw).split("\n")
    words = [w for w in words if w]
    same = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1) if len(words) > 1 else 0.0
    share = lambda c: kind[c] / size
    return [math.log1p(n), share(quality._LOWER), share(quality._UPPER), share(quality._DIGIT), share(quality._LINE), share(quality._POINT), share(quality._SYMBOL), share(quality._BAR), share(quality._HIGH), math.log1p(sum(map(len, words)) / max(len(words), 1)), same, math.log1p(n / (kind[quality._LINE] + 1)) if n else 0.0]


def test_statistics():
    import pyarrow as pa

    texts = ["", "a", "  a b b\n\nB| 1,2", "été été x", " \n", "x" * 5000, "a a a a", "end ", "\tq"]
    raw, offsets = string_bytes(pa.array(texts))
    assert np.allclose(quality.statistics(raw, offsets), [stats_of(t) for t in texts])


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    y, w = rng.normal(size=40), rng.uniform(0.5, 2, 40)
    _, got = quality.isotonic(np.arange(40.0), y, w)
    want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(got, want)


def test_scores_equal_a_direct_ridge_solution(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = quality._rows(docs, "doc_id", "text")
    model = quality.fit(rows, labels, features=32)
    x = {r.id: np.array(r.x) for r in rows.collect()}
    use = labels.select("doc_id", "quality", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)).alias("h")).collect()
    z = model.features(np.stack([x[r.doc_id] for r in use if r.h != 0]))
    y = np.array([float(r.quality) for r in use if r.h != 0])
    every = np.stack(list(x.values()))
    assert np.allclose(model.mean, every.mean(0)) and np.allclose(model.scale, np.where(every.std(0) > 0, every.std(0), 1))
    ridge = np.linalg.solve(z.T @ z / len(y) + 1e-3 * np.diag(np.append(np.ones(32), 0) + 1e-9), z.T @ y / len(y))
    assert np.allclose(model.ridge, ridge, atol=1e-8)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    k = len(quality.STATISTICS)
    m = quality.Model(np.zeros(k), np.ones(k), rng.normal(size=(k, 20_000)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(1), np.zeros(0), np.zeros(0))
    x = rng.normal(size=(6, k))
    z = m.features(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * k))).max() < 0.05


def test_held_out_accuracy(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.classify(docs, labels.where(seen)).join(labels.where(~seen), "doc_id").collect()
    assert len(got) > 100
    assert np.mean([r.keep == (r.quality == 1) for r in got]) >= 0.95
    good = [r.keep for r in got if r.quality == 1]
    assert np.mean(good) >= 0.98  # clean documents stay
    for p in (0.0, 0.5, 1.0):  # calibrated: shares follow the probabilities
        near = [r.quality for r in got if abs(r.probability - p) < 0.1]
        assert len(near) < 20 or abs(np.mean(near) - p) < 0.2


def test_quality_edge_cases(spark):
    df = messy(spark)
    labels = spark.createDataFrame([(1, 1, "z"), (9, 1, "z"), (6, 0, "z"), (5, 0, "z"), (5, 0, "z"), (3, 1, "z"), (99, 1, "z"), (None, 1, "z"), (2, None, "z")], "doc_id bigint, quality int, id string")
    out = quality.classify(df, labels)
    assert out.columns == ["doc_id", "score", "probability", "keep"]
    got = out.collect()
    assert len(got) == df.count()
    null = [r for r in got if r.score is None]
    assert [(r.doc_id, r.probability, r.keep) for r in null] == [(3, None, False)]
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1  # equal texts, equal scores
    kept = quality.keep_good(df, labels)
    assert kept.schema == df.schema
    assert Counter(map(str, (r.doc_id for r in kept.collect()))) == Counter(str(r.doc_id) for r in got if r.keep)
    nothing = labels.limit(0)
    assert quality.classify(df, nothing).where("keep").count() == df.where("text is not null").count()
    assert quality.classify(df.limit(0), labels).count() == 0 and quality.keep_good(df.limit(0), labels).count() == 0


def test_bounded_labels(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(quality._rows(docs, "doc_id", "text"), labels, max_labels=40, features=16)
    assert np.isfinite(model.ridge).all() and model.ridge.any()


def test_solve_meets_targets():
    sizes = {"a": 1000, "b": 100, "c": 10, "none": 0}
    m = mixing.solve(sizes, repetition_limit=2.0)
    assert math.isclose(max(m.epochs.values()), 2.0, rel_tol=1e-9) and math.isclose(sum(m.weights.values()), 1.0) and m.weights["none"] == 0
    want = {s: (t / 1110) ** m.exponent for s, t in sizes.items() if t}
    assert all(math.isclose(m.weights[s], x / sum(want.values())) for s, x in want.items())
    h = mixing.solve(sizes, entropy=0.9)
    assert math.isclose(-sum(w * math.log(w) for w in h.weights.values() if w), 0.9, abs_tol=1e-9)
    low = mixing.solve(sizes, entropy=0.2)  # below the natural shares' entropy
    assert low.exponent > 1 and math.isclose(-sum(w * math.log(w) for w in low.weights.values() if w), 0.2, abs_tol=1e-9)
    for unmet in ({"entropy": 50.0}, {"repetition_limit": 2.0, "budget": 10 * sum(sizes.values())}, {"repetition_limit": 0.5}):
        with pytest.raises(ValueError):
            mixing.solve(sizes, **unmet)
    with pytest.raises(ValueError):  # two largest sources: no exponent tells them apart
        mixing.solve({"a": 5, "b": 5, "c": 1}, entropy=0.5)
    k = mixing.solve(sizes, repetition_limit=3.0, keep_all=True)
    assert min(e for s, e in k.epochs.items() if sizes[s]) >= 1 - 1e-9 and max(k.epochs.values()) <= 3 + 1e-9
    assert mixing.solve({}).budget == 0 and mixing.solve({"a": 0}).weights == {"a": 0.0}


def reference_mix(docs, block_tokens, seed_hashes, target):
    """The mixture document by document. seed_hashes: (h, h2) of each document, and the order of blocks."""
    row_hash, block_order = seed_hashes
    size = defaultdict(int)
    for d in docs:
        size[d[1]] += d[2]
    m = mixing.solve(size, **target)
    out = []
    for s, total in size.items():
        n = max(1, math.ceil(total / block_tokens))
        blocks = defaultdict(list)
        for d in docs:
            if d[1] == s:
                blocks[row_hash[d[0]][0] % n].append(d)
        left, epoch = m.weights[s] * m.budget + 1e-6, 0
        while left >= total - 1e-5:
            out += [(d[0], epoch) for b in blocks.values() for d in b]
            left, epoch = left - total, epoch + 1
        for b in sorted(blocks, key=lambda b: (block_order[epoch, b], b)):
            whole = sum(d[2] for d in blocks[b])
            if whole <= left:
                out += [(d[0], epoch) for d in blocks[b]]
                left -= whole
                continue
            for d in sorted(blocks[b], key=lambda d: row_hash[d[0]][1]):
                if d[2] > left:
                    break
                out.append((d[0], epoch))
                left -= d[2]
            break
    return out, m


@pytest.mark.parametrize("target", [{"repetition_limit": 2.0}, {"repetition_limit": 1.5, "budget": 30_000.0}, {"entropy": 1.2}, {"repetition_limit": 3.0, "keep_all": True}])
def test_mixture_against_one_by_one(spark, sf, target):
    df = table(spark, sf, "documents")
    rows = mixing._rows(df, "doc_id", "source", "text", 11).collect()
    docs = [(r.id, r.src, r.tokens) for r in rows]
    assert {r.id: r.tokens for r in rows} == {r.doc_id: len(r.text.split()) for r in df.collect() if r.text.split()}
    pairs = spark.createDataFrame([(e, b) for e in range(40) for b in range(200)], "epoch bigint, block bigint")
    order = {(r.epoch, r.block): r.o for r in pairs.withColumn("o", F.xxhash64(F.lit(11), "epoch", "block")).collect()}
    want, m = reference_mix(docs, 2000, ({r.id: (r.h, r.h2) for r in rows}, order), target)
    got = mixing.mix(df, block_tokens=2000, **target).collect()
    assert Counter((r.doc_id, r.epoch) for r in got) == Counter(want)
    used = defaultdict(int)
    for r in got:
        used[r.source] += r.tokens
        assert 0 <= r.progress <= 1 + 1e-9
    longest = max(t for _, _, t in docs)
    for s, w in m.weights.items():
        assert w * m.budget - longest <= used[s] <= w * m.budget + 1e-3
    again = mixing.mix_documents(df, block_tokens=2000, **target)
    assert again.schema == df.schema
    assert Counter(r.doc_id for r in again.collect()) == Counter(i for i, _ in want)


def test_mixing_edge_cases(spark):
    df = messy(spark)
    out = mixing.mix(df, keep_all=True)
    assert out.columns == ["doc_id", "source", "tokens", "epoch", "block", "progress"]
    got = out.collect()
    assert {r.source for r in got} == {"s1", "s2", "s3", None}  # a null source is a source
    used = mixing.mix_documents(df, keep_all=True)
    assert used.schema == df.schema
    assert Counter(str(r.doc_id) for r in used.collect()) == Counter(str(r.doc_id) for r in got)
    texts = [r.text for r in used.collect()]
    assert None not in texts and all(t.strip() for t in texts)
    nulls = spark.createDataFrame([(1, "a b c", None), (2, "d e", "x"), (3, None, None)], "doc_id bigint, text string, source string")
    assert {r.source for r in mixing.mix(nulls, keep_all=True).collect()} == {None, "x"}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_shards_against_one_by_one(spark, sf, duck):
    from quern.llm.queries import OP9_SQL

    got = sorted((r.doc_id, r.n_bytes, r.byte_start, r.shard) for r in sharding.shard(table(spark, sf, "documents")).collect())
    assert got == sorted(duck.execute(f"SELECT doc_id, n_bytes, byte_start, shard FROM ({OP9_SQL})").fetchall())
    docs = [(i, len(t.encode())) for i, t in sorted(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))]
    total, at, want = sum(n for _, n in docs), 0, []
    for i, n in docs:
        want.append((i, n, at, min(6, at * 7 // total)))
        at += n
    assert sorted((r.doc_id, r.n_bytes, r.byte_start, r.shard) for r in sharding.shard(table(spark, sf, "documents"), n_shards=7).collect()) == want


def test_sharding_edge_cases(spark, tmp_path):
    df = messy(spark)
    out = sharding.shard(df, n_shards=3)
    assert out.columns == ["doc_id", "n_bytes", "byte_start", "shard"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_bytes))
    assert len(got) == df.count() and got[0].doc_id is None
    at = 0
    for r in got:
        assert r.byte_start == at
        at += r.n_bytes
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    assert sharding.shard(df.limit(0)).count() == 0
    assert {r.shard for r in sharding.shard(df.where("text = ''")).collect()} == {0}
    own = spark.createDataFrame([(i, "x" * (i % 17)) for i in range(100)], "doc_id bigint, text string")
    sharding.write_shards(own, str(tmp_path / "out"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert {r.doc_id: r.shard for r in back.collect()} == {r.doc_id: r.shard for r in sharding.shard(own, n_shards=4).collect()}


def test_shards_are_written_for_unique_ids_only(spark, tmp_path):
    rows = [(1, "a", 5), (2, None, 6), (3, "", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, byte_start int")
    sharding.write_shards(df, str(tmp_path / "a"), n_shards=2)
    assert sorted((r.doc_id, r.text, r.byte_start) for r in spark.read.parquet(str(tmp_path / "a")).collect()) == sorted(rows, key=lambda r: r[0])
    for bad in (df.union(df), df.unionByName(spark.createDataFrame([(None, "x", 1)], df.schema)), df.withColumnRenamed("byte_start", "shard")):
        with pytest.raises(ValueError):
            sharding.write_shards(bad, str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()
