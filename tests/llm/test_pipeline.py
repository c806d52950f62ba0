"""The pipeline: its stages against brute force, and the driver's entry."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
corpus_pipeline = pytest.importorskip("corpus_pipeline") if (ROOT / "corpus_pipeline.py").exists() else pytest.skip("no pipeline", allow_module_level=True)

from quern.llm import bpe, mixing, quality  # noqa: E402
from quern.llm import queries as llm_queries  # noqa: E402
from quern.session import table  # noqa: E402

from .common import messy  # noqa: E402
from .test_dedup import brute_groups  # noqa: E402


def test_stages_against_brute_force(spark, sf, tmp_path):
    import base64

    import tiktoken

    docs = table(spark, sf, "documents")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        if i < 3:
            assert out.schema == table(spark, sf, "documents").schema
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append((before, docs.collect()))

    labels = {r.doc_id: r for r in pq.read_table(f"{sf}/labels.parquet").to_pandas().itertuples()}
    before, after = kept[0]
    decided = {r.doc_id: r.keep for r in quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()}
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if decided[r.doc_id])
    known = [(r.doc_id in {x.doc_id for x in after}) == (labels[r.doc_id].quality == 1) for r in before if r.doc_id in labels]
    assert np.mean(known) >= 0.95

    before, after = kept[1]
    rows = sorted(before, key=lambda r: r.doc_id)
    want = {rows[i].doc_id for i, r in brute_groups([r.text for r in rows]).items() if i == r}
    assert Counter(r.doc_id for r in after) == Counter(want)  # each group's first, once

    before, after = kept[2]
    size = Counter()
    for r in before:
        size[r.source] += len(r.text.split())
    m = mixing.solve(size, repetition_limit=2.0, keep_all=True)
    times = Counter(r.doc_id for r in after)
    assert set(times) == {r.doc_id for r in before if r.text.split()}  # clean documents stay
    assert max(times.values()) <= 2
    used = Counter()
    for r in after:
        used[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in before)
    assert all(w * m.budget - longest <= used[s] <= w * m.budget + 1 for s, w in m.weights.items())

    before, after = kept[3]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCAB, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r.doc_id, tuple(r.tokens)) for r in after) == Counter((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in before)
    assert all(r.round_trip for r in after)

    whole = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in after)


def test_stages_on_messy_rows(spark, sf):
    docs = messy(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert i == 3 or out.schema == docs.schema
        assert stage(spark, docs.limit(0), sf).count() == 0
        out.count()


def test_one_query_for_each_operator(spark, sf):
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names[-1] == "pipeline" and set(entry.oracle_sql()) <= set(names)
    for name, sql in llm_queries.oracle_sql().items():
        assert sql and name in names
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.good_documents, corpus_pipeline.distinct_documents, corpus_pipeline.mixed_documents, corpus_pipeline.encoded_documents]


def test_every_query_runs_and_agrees_with_its_sql(spark, sf, duck):
    for name, f in llm_queries.queries().items():
        got = f(spark, sf)
        sql = llm_queries.oracle_sql().get(name)
        if sql:
            assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(duck.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({sql})").fetchall()), name
        else:
            of = "pages" if name in ("op2_html", "op4_media", "op10_urls") else "documents"
            n, all_ = got.count(), table(spark, sf, of).count()
            assert 0 < n < all_ if name == "op1_simhash" else n >= all_ / 2 if name == "op6_mixing" else n == all_, name


def test_library_works_without_the_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sparse_topk' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql(); import quern.operators.retrieval, quern.streaming.turns, quern.sources.files"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
