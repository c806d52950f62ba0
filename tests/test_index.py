"""Sources, ingest, index, both searches and the streams, end to end on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import encode as E
from quern.operators import index as X
from quern.operators import ingest as I
from quern.operators import retrieval as R
from quern.operators import search as S
from quern.sources import files
from quern.streaming import turns as Z

MODEL = E.HashEncoder(128, 32, 64)
TEXTS = [(1, "Direito autoral e contratos de licença no Brasil."), (2, "Gradient descent minimises the loss of a neural network."), (3, "人工智能模型需要大量的训练数据。"), (4, "Receita de bolo de cenoura com cobertura de chocolate.")]


def tables(docs, config=I.Chunking()):
    d = I.documents(docs, source=F.col("source"))
    chunks = I.chunks(d, config)
    own = chunks.where("kind <> 'parent'")
    return d, chunks, I.index_vectors(own, MODEL), E.postings(own, "chunk_id", "ctx")


def corpus(index):
    return R.Corpus(index.table("docs"), index.table("chunks"), index.table("vectors"), index.table("postings"), MODEL)


def long_text(p=3, n=30):
    return "\n\n".join(" ".join(f"Sentence {i} of part {k} speaks about topic {k * 31 + i} in some detail." for i in range(n)) for k in range(p))


@pytest.fixture()
def index(spark, tmp_path):
    x = X.Index(spark, f"file://{tmp_path}/index", {"encoder": MODEL.name, "dims": [MODEL.dense_dim, MODEL.token_dim]})
    x.add(*tables(files.inline(spark, TEXTS)))
    return x


def test_both_searches_find_the_document(spark, index):
    queries = spark.createDataFrame([(1, "contratos de licença"), (2, "training a neural network"), (3, "训练数据"), (4, "bolo de chocolate"), (5, "")], "query_id bigint, text string")
    for run in (R.search_legacy, R.search_v2):
        for mode in ("exact", "full"):
            found = run(queries, corpus(index), R.Config(k=2, mode=mode, binary=mode == "full", diversity_method="none"))
            top = {r.query_id: r.doc_id for r in found.hits.where("rank = 1").collect()}
            assert {q: top[q] for q in (1, 2, 3, 4)} == {1: 1, 2: 2, 3: 3, 4: 4}, (run.__name__, mode)
            assert found.hits.groupBy("query_id").count().where("count > 2").count() == 0
            assert {r.stage for r in found.stages.select("stage").distinct().collect()} >= {"dense", "sparse", "fusion", "final"}
            assert found.views.where("channel = 'sparse'").count() > 0


def test_search_options(spark, index):
    q = spark.createDataFrame([(1, "bolo")], "query_id bigint, text string")
    worst_first = lambda seen: seen.select("query_id", "chunk_id", (-F.col("rank")).alias("rank"))
    base = [r.chunk_id for r in R.search_v2(q, corpus(index), R.Config(k=4, fusion="rrf")).hits.orderBy("rank").collect()]
    turned = [r.chunk_id for r in R.search_v2(q, corpus(index), R.Config(k=4, fusion="rrf"), rerank=worst_first).hits.orderBy("rank").collect()]
    assert turned == base[::-1]
    for method in ("mmr", "dpp", "fermionic"):
        hits = R.search_v2(q, corpus(index), R.Config(k=3, fusion="rrf", diversity_method=method)).hits
        assert hits.count() == 3 and [r.score for r in hits.orderBy("rank").collect()] == [1.0, 0.5, 1 / 3]
    only = R.search_v2(q, corpus(index), R.Config(k=4, filters=S.Filters(doc_ids=(2, 3)))).hits
    assert {r.doc_id for r in only.collect()} == {2, 3}
    wider = R.search_legacy(q, corpus(index), R.Config(k=1, diversity_method="none"), expand=lambda t: ["neural network loss", "gradient descent"]).views
    assert wider.where("channel = 'sparse'").count() >= 1

    def broken(text):
        raise RuntimeError

    assert R.search_v2(q, corpus(index), R.Config(k=1), expand=broken).hits.first().doc_id == 4
    assert "Scan" in R.plan_of(index.table("docs"))


def test_chunks_and_parents(spark):
    docs = files.inline(spark, [(7, long_text()), (8, "tiny"), (9, "  \n ")])
    d = I.documents(docs, source=F.col("source"))
    rows = I.chunks(d, I.Chunking(chunk_tokens=100, overlap=20, parent_tokens=400, tiny_tokens=50)).collect()
    own = sorted((r for r in rows if r.doc_id == 7 and r.kind == "chunk"), key=lambda r: r.pos)
    assert [r.pos for r in own] == list(range(len(own))) and len(own) > 12 and all(r.chunk_id == 7 * 2048 + r.pos for r in own)
    parents = {r.chunk_id: r for r in rows if r.kind == "parent"}
    assert len(parents) == -(-len(own) // 4)
    for r in own:
        p = parents[r.parent_id]
        assert p.pos == r.pos // 4 * 4 and r.text in p.text and r.ctx.startswith("[Sentence 0")
    small = [r for r in rows if r.doc_id == 8]
    assert len(small) == 1 and small[0].ctx == "tiny" and small[0].parent_id is None
    assert not [r for r in rows if r.doc_id == 9]
    with pytest.raises(Exception, match="too many chunks"):
        I.chunks(I.documents(files.inline(spark, [(1, long_text(20, 60))]), source=F.col("source")), I.Chunking(chunk_tokens=5, overlap=1, tiny_tokens=1)).collect()
    s = I.summaries(d, F.lit(" short "), I.Chunking(huge_tokens=100)).collect()
    assert [(r.doc_id, r.pos, r.text, r.kind) for r in s] == [(7, -1, "short", "summary")]
    with pytest.raises(ValueError):
        I.Chunking(chunk_tokens=10, overlap=10)


def test_changes(spark, index):
    assert all(r.n == 0 for r in index.audit().collect())
    before = index.stats()
    index.touch(spark.createDataFrame([(2048,)], "chunk_id bigint"), 5)
    assert {r.chunk_id: r.accessed_turn for r in index.table("chunks").collect()}[2048] == 5
    index.set_meta("k", "1")
    index.set_meta("k", "2")
    assert index.get_meta("k") == "2" and index.get_meta("none") is None
    index.add(*tables(files.inline(spark, [(1, "replaced text")])))  # the same id: replaced
    assert index.stats()["docs"] == before["docs"]
    index.delete_docs(spark.createDataFrame([(2,)], "doc_id bigint"))
    assert index.stats()["docs"] == before["docs"] - 1 and index.table("vectors").where("chunk_id = 4096").count() == 0
    assert all(r.n == 0 for r in index.audit().collect())
    index.delete_chunks(spark.createDataFrame([(3 * 2048,)], "chunk_id bigint"))
    assert index.table("postings").where(F.col("chunk_id") == 3 * 2048).count() == 0
    assert index.vacuum() > 0 and index.stats()["chunks"] == 2
    index.reset()
    assert index.stats()["chunks"] == 0 and index.get_meta("k") == "2"


def test_transactions_and_fingerprint(spark, index):
    with pytest.raises(RuntimeError):
        with index.transaction():
            index.delete_docs(spark.createDataFrame([(1,)], "doc_id bigint"))
            raise RuntimeError
    assert index.stats()["docs"] == 4
    with index.transaction():
        index.set_meta("outer", "1")
        with pytest.raises(RuntimeError):
            with index.transaction():
                index.set_meta("inner", "1")
                raise RuntimeError
    assert index.get_meta("outer") == "1" and index.get_meta("inner") is None
    with pytest.raises(ValueError):
        X.Index(spark, index.path, {"encoder": "other"})
    bare = X.Index(spark, index.path + "-bare")
    bare.add(*tables(files.inline(spark, TEXTS[:1])))
    with pytest.raises(ValueError):
        X.Index(spark, bare.path, {"encoder": "hash"})
    spark.range(3).write.parquet(f"{bare.path}/docs/odd")
    bare._publish({**bare._manifest(), "docs": "docs/odd"})
    with pytest.raises(ValueError):
        bare.table("docs")


def test_sources(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.txt").write_text("first")
    (tmp_path / "a/b/two.md").write_bytes(b"se\xffcond")
    (tmp_path / "a/skip.png").write_bytes(b"x")
    got = files.read_folder(spark, str(tmp_path / "a")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.source.rsplit("/", 1)[1], r.text) for r in got] == [(1, "two.md", "se�cond"), (2, "one.txt", "first")]
    beir = tmp_path / "beir"
    (beir / "qrels").mkdir(parents=True)
    (beir / "corpus.jsonl").write_text(json.dumps({"_id": "d1", "title": "T", "text": "words"}))
    (beir / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "ask"}))
    (beir / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    c, q, r = files.read_beir(spark, str(beir))
    assert c.first().doc_id == "d1" and q.first().text == "ask" and tuple(r.first()) == ("q1", "d1", 2.0)
    made = files.synthetic_corpus(spark, 40).orderBy("doc_id").collect()
    assert len({x.text for x in made}) == 30 and all(made[i].text == made[i - 1].text for i in range(3, 40, 4))


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", Z.STATE_STORE)
    source = tmp_path / "in"
    rows = [(c, t, f"t{c}-{t}") for c in (1, 2) for t in range(5)]
    spark.createDataFrame(rows[:3] + rows[5:7], "conv_id bigint, turn int, text string").write.parquet(str(source / "1"))

    def run():
        stream = spark.readStream.schema("conv_id bigint, turn int, text string").option("recursiveFileLookup", "true").parquet(str(source))
        Z.numbered_turns(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame(rows[3:5] + rows[7:], "conv_id bigint, turn int, text string").write.parquet(str(source / "2"))
    run()  # state goes on where it stopped
    got = {(r.conv_id, r.turn_no): (r.text, r.summary) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {(c, n) for c in (1, 2) for n in range(1, 6)}
    assert got[1, 4] == ("t1-3", "t1-2\n---\nt1-3") and got[2, 5] == ("t2-4", None)


def test_stream_into_an_index(spark, tmp_path):
    index = X.Index(spark, f"file://{tmp_path}/index")
    for n, part in enumerate((TEXTS[:2], TEXTS[1:])):
        spark.createDataFrame([(i, "stream", t) for i, t in part], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema("doc_id bigint, source string, text string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        Z.index_documents(stream, index, str(tmp_path / "state"), MODEL).awaitTermination()
        assert index.stats()["docs"] == (2, 4)[n]
    assert all(r.n == 0 for r in index.audit().collect())


def test_last_access_over_a_stream(spark, tmp_path):
    for n, rows in enumerate(([(1, 3), (2, 1)], [(1, 2), (2, 9)])):
        spark.createDataFrame(rows, "chunk_id bigint, turn_no int").write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("chunk_id bigint, turn_no int").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    Z.last_access(stream).writeStream.format("memory").queryName("accesses").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.chunk_id: r.accessed_turn for r in spark.table("accesses").collect()} == {1: 3, 2: 9}
