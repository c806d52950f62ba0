"""Numbered rows, appended index parts, blocks of queries, late interaction by both ways, and the inverted-file index."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import ann as A
from quern.operators import ingest as I
from quern.operators import search as S
from quern.operators.index import Index
from quern.sources import files

from .test_index import TEXTS, tables


def test_numbers_of_many_rows_are_those_of_the_order(spark):
    rows = spark.range(400_000).repartition(8).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("g"), "id")
    got = I.numbered(rows.withColumnRenamed("id", "row"), [F.col("g").asc(), F.col("row").desc()]).toPandas()
    want = got.sort_values(["g", "row"], ascending=[True, False])
    assert (want["id"].to_numpy() == np.arange(1, 400_001)).all()
    assert I.numbered(rows.limit(0).withColumnRenamed("id", "row"), [F.col("row").asc()]).count() == 0


def test_index_appends_and_replaces_documents_without_chunks(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    docs, chunks, vectors, posts = tables(files.inline(spark, TEXTS))
    index.add(docs, chunks, vectors, posts)
    once = index.stats()
    bare = docs.limit(1).withColumn("doc_id", F.lit(99).cast("bigint"))
    none = (chunks.limit(0), vectors.limit(0), posts.limit(0))
    index.add(bare, *none)
    assert len(index._manifest()["docs"]) == 2  # appended, the first part is as it was
    index.add(bare, *none)
    assert index.stats()["docs"] == once["docs"] + 1
    index.delete_docs(bare.select("doc_id"))
    assert index.stats() == once
    index.vacuum()
    assert index.stats() == once


def made_vectors(spark, n, dims, seed):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id bigint, v array<double>")


def test_blocks_of_queries_give_what_sent_queries_give(spark):
    x, rows = made_vectors(spark, 400, 8, 1)
    queries = rows.withColumnRenamed("chunk_id", "query_id").where("query_id % 3 = 0")

    def score(r, q):
        return np.round(r @ q.T, 6) + 0.0

    got = [sorted(map(tuple, S.blocks_topk(queries, rows, 5, S._matrix(8), score, size).select("query_id", "chunk_id", "score", "rank").collect())) for size in (1 << 20, 2000)]
    assert got[0] == got[1] and len(got[0]) == 134 * 5
    for q in (0, 3, 399):
        best = np.lexsort((np.arange(400), -np.round(x @ x[q], 6)))[:5]
        assert [c for i, c, _, _ in sorted(got[0], key=lambda r: (r[0], r[3])) if i == q] == best.tolist()
    assert S.blocks_topk(queries.limit(0), rows, 5, S._matrix(8), score).count() == 0


def test_late_interaction_by_both_ways(spark):
    rng = np.random.default_rng(2)
    mats = [rng.normal(size=(int(rng.integers(0, 5)), 4)).tolist() for _ in range(30)]
    queries = spark.createDataFrame([(i, m) for i, m in enumerate(mats[:10])] + [(50, None)], "query_id bigint, tokens array<array<double>>")
    docs = spark.createDataFrame([(i, m) for i, m in enumerate(mats)] + [(60, None)], "chunk_id bigint, tokens array<array<double>>")
    pool = queries.select("query_id").crossJoin(docs.select("chunk_id"))
    got = [{(r.query_id, r.chunk_id): (r.score, r.rank) for r in S.maxsim_topk(queries, docs, pool, 40, query_bytes=size).collect()} for size in (1 << 20, 10)]
    assert got[0] == got[1] and len(got[0]) == 11 * 31
    for i in range(10):
        for j in range(30):
            x, y = np.array(mats[i]), np.array(mats[j])
            assert abs(got[0][i, j][0] - (float((x @ y.T).max(1).mean()) if len(x) and len(y) else 0.0)) < 1e-6


def test_inverted_file_reaches_its_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.repeat(base, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id bigint, v array<double>")
    queries = rows.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = A.build(rows, 16)
    assert index.rows.count() == 2000 and len(index.centroids) == 45
    probes = A.probes_for(queries, index, 10, 0.95)
    assert probes < len(index.centroids)
    found = {}
    for r in A.search(queries, index, 10, probes).collect():
        found.setdefault(r.query_id, set()).add(r.chunk_id)
    hits = [len(found[q] & set(np.lexsort((np.arange(2000), -np.round(x @ x[q], 6)))[:10].tolist())) / 10 for q in range(0, 2000, 20)]
    assert np.mean(hits) >= 0.94
    everything = {(r.query_id, r.chunk_id, r.rank) for r in A.search(queries, index, 10, len(index.centroids)).collect()}
    assert everything == {(r.query_id, r.chunk_id, r.rank) for r in S.dense_topk(queries, rows, 10, 16).collect()}
    assert A.search(queries.limit(0), index, 10, 1).count() == 0
    empty = A.build(rows.limit(0), 16)
    assert A.search(queries, empty, 10, A.probes_for(queries, empty, 10)).count() == 0


def test_line_ids_and_window_ids_never_meet(spark, tmp_path):
    import duckdb

    from quern.plans import text_queries as Q

    # window 0 of the second document had the id of line `line` of the first
    first, line, second = next((a, b * 2048 + 100_000 - a * 1_000_000, b) for a in range(1, 200) for b in range(1, 100_000) if 0 <= b * 2048 + 100_000 - a * 1_000_000 < 40)
    texts = [(first, "\n".join(f"line {i}" for i in range(60))), (second, "\n".join(f"other {i}" for i in range(6)))]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("hydrate_parents", "stitch"):
        got = Q.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 66, (name, line)


def test_a_task_scores_a_bounded_number_of_pairs_at_a_time(spark):
    x, rows = made_vectors(spark, 2500, 4, 5)
    most = 1024 * 1024

    def score(r, q):
        if len(r) * len(q) > most:
            raise MemoryError(f"{len(r)} x {len(q)}")
        return np.round(r @ q.T, 6) + 0.0

    got = S.blocks_topk(rows.withColumnRenamed("chunk_id", "query_id"), rows, 3, S._matrix(4), score).collect()
    want = np.round(x @ x.T, 6)
    assert {(r.query_id, r.chunk_id) for r in got if r.query_id < 50} == {(a, int(b)) for a in range(50) for b in np.lexsort((np.arange(2500), -want[a]))[:3]}
    assert len(got) == 7500


def test_sparse_queries_in_blocks(spark):
    rng = np.random.default_rng(6)
    p = np.unique(rng.integers(0, 60, (3000, 2)) * [5, 1], axis=0)
    w, qs = rng.normal(size=len(p)), np.unique(rng.integers(0, 70, (400, 2)), axis=0)
    posts = spark.createDataFrame([(int(c), f"t{t}", float(x)) for (c, t), x in zip(p, w)], "chunk_id bigint, term string, weight double")
    asked = spark.createDataFrame([(f"q{a}", f"t{t}", 0.5 + a % 3) for a, t in qs.tolist()], "query_id string, term string, weight double")
    universe = posts.select("chunk_id").distinct()
    df, n, want = np.bincount(p[:, 1], minlength=70), len(np.unique(p[:, 0])), {}
    for a, t in qs.tolist():
        for (c, _), x in zip(p[p[:, 1] == t].tolist(), w[p[:, 1] == t]):
            want.setdefault(f"q{a}", {}).setdefault(c, []).append((0.5 + a % 3) * x * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)))
    best = {(q, c) for q, own in want.items() for c in sorted(own, key=lambda c: (-round(sum(own[c]), 6), c))[:4]}
    for size in (1 << 20, 20_000):
        assert {(r.query_id, r.chunk_id) for r in S.sparse_topk(asked, posts, universe, 4, query_bytes=size).collect()} == best


def test_late_interaction_makes_matrices_of_the_pool_on_the_way(spark):
    from quern.functions import encode as E

    model = E.HashEncoder(dense_dim=32, token_dim=16)
    texts = spark.createDataFrame([(i, f"word{i % 7} and word{i % 3} or {'more ' * (i % 5)}") for i in range(40)], "chunk_id bigint, text string")
    rows = E.encode(texts, "chunk_id", "text", model)
    queries = rows.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), "tokens")
    pool = queries.select("query_id").crossJoin(texts.where("chunk_id % 2 = 0").select("chunk_id"))
    want = sorted(map(tuple, S.maxsim_topk(queries, rows, pool, 6).select("query_id", "chunk_id", "score", "rank").collect()))
    for size in (1 << 20, 10):
        got = S.maxsim_topk(queries, texts.withColumnRenamed("text", "tokens"), pool, 6, query_bytes=size, encode=model.tokens)
        assert sorted(map(tuple, got.select("query_id", "chunk_id", "score", "rank").collect())) == want and len(want) == 30
