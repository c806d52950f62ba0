"""Search, fusion, diversity, hydration, memory and evaluation against plain Python and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import diversity as D
from quern.operators import evaluate as V
from quern.operators import fusion as U
from quern.operators import hydrate as H
from quern.operators import memory as M
from quern.operators import retrieval as R
from quern.operators import search as S

RANKED = "query_id bigint, channel string, chunk_id bigint, score double, rank int"


def ranked(spark, **channels):
    return spark.createDataFrame([(1, c, i, float(s), n + 1) for c, items in channels.items() for n, (i, s) in enumerate(items)], RANKED)


def order(df):
    return [(r.chunk_id, r.score) for r in df.orderBy("query_id", "rank").collect()]


def test_rrf_known_values(spark):
    got = order(U.rrf_fuse(ranked(spark, dense=[(2, 1), (1, 0.5)], sparse=[(1, 3)]), {}, 10))
    assert [i for i, _ in got] == [1, 2] and math.isclose(got[0][1], 1 / 62 + 1 / 61) and math.isclose(got[1][1], 1 / 61)
    got = dict(order(U.rrf_fuse(ranked(spark, dense=[(1, 3), (1, 2), (2, 1)]), {}, 10)))
    assert math.isclose(got[1], 1 / 61) and math.isclose(got[2], 1 / 63)  # a repeated candidate takes up a rank
    assert [i for i, _ in order(U.rrf_fuse(ranked(spark, a=[(9, 2), (2, 1)], b=[(2, 2), (9, 1)]), {}, 10))] == [2, 9]


def naive_quantum(channels, weights, strength):
    norm, phase = {}, {}
    for c, items in channels.items():
        s = [x for _, x in items]
        lo, hi = min(s), max(s)
        norm[c] = {i: 1.0 if hi - lo < 1e-12 else (x - lo) / (hi - lo) for i, x in items}
        phase[c] = {i: math.pi * n / (len(items) - 1) if len(items) > 1 else 0.0 for n, (i, _) in enumerate(items)}
    out = {}
    for i in {i for items in channels.values() for i, _ in items}:
        a = [(math.sqrt(weights.get(c, 1) * norm[c][i]), phase[c][i]) for c in channels if norm[c].get(i, 0) > 0]
        classical = sum(x * x for x, _ in a)
        wave = sum(2 * a[k][0] * a[j][0] * math.cos(a[k][1] - a[j][1]) for k in range(len(a)) for j in range(k))
        out[i] = (classical, wave, classical + strength * wave)
    return out


@pytest.mark.parametrize("strength", [0.0, 0.7, 1.0])
def test_quantum_against_pairwise_sums(spark, strength):
    rng = np.random.default_rng(3)
    channels = {c: sorted(((int(i), float(x)) for i, x in zip(rng.choice(30, 12, replace=False), rng.normal(size=12))), key=lambda p: -p[1]) for c in "abc"}
    weights = {"a": 1.0, "b": 0.8, "c": 0.9}
    got = {r.chunk_id: (r.classical, r.interference, r.score) for r in U.quantum_fuse(ranked(spark, **channels), weights, 99, strength).collect()}
    want = naive_quantum(channels, weights, strength)
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(got[i], want[i], atol=1e-12)


def test_quantum_known_values(spark):
    got = U.quantum_fuse(ranked(spark, a=[(2, 1.0), (1, 1.0 - 5e-13)]), {}, 9).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(1, 1.0), (2, 1.0)]
    top = U.quantum_fuse(ranked(spark, a=[(1, 1.0), (2, 0.0)], b=[(1, 2.0)]), {}, 9).orderBy("rank").first()
    assert top.chunk_id == 1 and top.per_channel == {"a": 1.0, "b": 1.0} and top.channels == ["a", "b"]
    big = U.quantum_fuse(ranked(spark, a=[(1, 1e308), (2, -1e308)]), {}, 9).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in big] == [(1, 1.0), (2, 0.0)]  # the worst candidate stays, with nothing
    odd = ranked(spark, a=[(1, float("nan")), (2, 2.0), (2, 1.0), (3, 1.0)])
    assert [r.chunk_id for r in U.quantum_fuse(odd, {}, 9).orderBy("rank").collect()] == [2, 3]
    assert U.quantum_fuse(ranked(spark, a=[(1, 1)]).limit(0), {}, 9).count() == 0
    with pytest.raises(ValueError):
        U.fuse(odd, {}, 5, method="other")
    with pytest.raises(ValueError):
        U.weight_of({"a": -1.0})


def test_coherence(spark):
    r = ranked(spark, peak=[(1, 1.0), (2, 0.01), (3, 0.005), (4, 0.0)], flat=[(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)], two=[(1, 2.0), (2, 1.0)])
    kappa = {x.channel: x.kappa for x in U.coherence(U.normalized(r)).collect()}
    assert kappa["peak"] > 0.9 and kappa["flat"] == 0 and kappa["two"] == 0
    w = {x.channel: x.weight for x in U.weighted(U.normalized(r), {}, 1.0).select("channel", "weight").distinct().collect()}
    assert w == {"peak": 1.0, "flat": 0.0, "two": 0.0}


def test_blend_union_reconcile(spark):
    fused = spark.createDataFrame([(1, i, n + 1) for n, i in enumerate([1, 2, 3])], "query_id bigint, chunk_id bigint, rank int")
    late = spark.createDataFrame([(1, 3, 1), (1, 2, 2)], fused.schema)
    assert [r.chunk_id for r in U.structural_blend(fused, late).orderBy("rank").collect()] == [3, 2, 1]
    ten = spark.createDataFrame([(1, i, i) for i in range(1, 11)], fused.schema)
    assert [r.chunk_id for r in U.structural_blend(ten, spark.createDataFrame([(1, 10, 1)], fused.schema)).orderBy("rank").limit(2).collect()] == [10, 1]
    assert [r.chunk_id for r in U.candidate_union(ranked(spark, a=[(5, 2), (6, 1)], b=[(7, 2), (5, 1)]), 2).orderBy("place").collect()] == [5, 7]
    assert [r.chunk_id for r in U.reconcile(fused, spark.createDataFrame([(1, 3, 1), (1, 99, 2), (1, 3, 3)], fused.schema)).orderBy("rank").collect()] == [3, 1, 2]


def test_selection_known_values():
    e1, e2 = [1.0, 0.0], [0.0, 1.0]
    rel, v = np.array([1.0, 0.9, 0.8]), [e1, e1, e2]
    assert D.choose(rel, v, 2, "mmr", 0.5) == [0, 2] and D.choose(rel, v, 3, "mmr", 1.0) == [0, 1, 2]
    assert D.choose(np.array([1.0, 0.99, 0.9]), v, 2, "dpp") == [0, 2]
    for bad in ([e1, None, e2], [e1, [0.0, 0.0], e2], [e1, [float("nan"), 1.0], e2], [e1, [1.0], e2]):
        assert D.choose(rel, bad, 2, "mmr") == [0, 1] and D.choose(rel, bad, 2, "dpp") == [0, 1]
    assert D.choose(rel, [e1, None, e2], 3, "fermionic") == D.choose(rel, [e1, [0.0, 0.0], e2], 3, "fermionic")
    assert D.choose(rel, v, 2, "none") == [0, 1] and D.fermionic(rel, np.array(v), 2, 0.0) == [0, 1]


def test_selection_against_determinants():
    rng = np.random.default_rng(5)
    for _ in range(30):
        unit = rng.normal(size=(6, 4))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        rel = np.sort(rng.uniform(0.2, 1, 6))[::-1]
        kernel = rel[:, None] * rel[None] * D.shifted_cosine(unit)
        assert np.linalg.eigvalsh(kernel).min() > -1e-12
        chosen = []
        for _ in range(3):
            chosen.append(max((i for i in range(6) if i not in chosen), key=lambda i: np.linalg.det(kernel[np.ix_([*chosen, i], [*chosen, i])])))
        assert D.dpp(rel, unit, 3) == chosen
        gram, share, picked = unit @ unit.T, (rel - rel.min()) / (rel.max() - rel.min()), []
        for _ in range(3):
            vol = lambda i: np.linalg.det(gram[np.ix_([*picked, i], [*picked, i])]) / (np.linalg.det(gram[np.ix_(picked, picked)]) if picked else 1)  # noqa: B023, E731
            picked.append(max((i for i in range(6) if i not in picked), key=lambda i: 0.65 * 2 * math.log(max(share[i], 1e-12)) + 0.35 * math.log(max(vol(i), 1e-12))))
        assert D.fermionic(rel, unit, 3, 0.35) == picked
        best = []
        for _ in range(3):
            best.append(max((i for i in range(6) if i not in best), key=lambda i: 0.5 * rel[i] - (0.5 * max(gram[i, j] for j in best) if best else 0)))
        assert D.mmr(rel, unit, 3, 0.5) == best


def test_clusters_are_spread(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(4):
        centre = rng.normal(size=16)
        near = centre + rng.normal(size=(4, 16)) * 0.01
        near /= np.linalg.norm(near, axis=1, keepdims=True)
        rows += [(1, c * 4 + j, 0, 1.0 - 0.01 * (c * 4 + j), near[j].tolist()) for j in range(4)]
    rows = [(q, i, n + 1, s, v) for n, (q, i, _, s, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, rank int, score double, v array<double>")
    for method in ("mmr", "dpp", "fermionic"):
        got = D.diversify(df, 4, method, **({"diversity": 0.5} if method == "fermionic" else {})).collect()
        assert len({r.chunk_id // 4 for r in got}) == 4 and sorted(r.rank for r in got) == [1, 2, 3, 4], method


POSTS = [(10, 1, 1.0), (20, 1, 0.5), (10, 2, 1.0), (30, 2, 2.0), (20, 3, 1.5), (30, 3, 0.25), (10, 4, 1.0), (20, 99, 7.0)]


def test_sparse_scores(spark):
    posts = spark.createDataFrame(POSTS, "term bigint, chunk_id bigint, weight double")
    universe = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "chunk_id bigint")
    query = {10: 1.5, 999: 4.0, 20: -0.75, 30: 0.5}
    q = spark.createDataFrame([(7, t, w) for t, w in query.items()], "query_id bigint, term bigint, weight double")
    df = {10: 3, 20: 2, 30: 2}
    want = {}
    for t, c, w in POSTS:
        if c != 99:
            want[c] = want.get(c, 0) + query[t] * w * math.log(1 + (4 - df[t] + 0.5) / (df[t] + 0.5))
    got = order(S.sparse_topk(q, posts, universe, 10))
    assert [i for i, _ in got] == sorted(want, key=lambda i: (-round(want[i], 6), i)) and all(abs(s - want[i]) < 1e-6 for i, s in got)
    assert any(s < 0 for _, s in got)
    tie = spark.createDataFrame([(7, 10, 1.0)], q.schema)
    assert [i for i, _ in order(S.sparse_topk(tie, posts, universe, 10))] == [1, 2, 4]
    scoped = order(S.sparse_topk(q, posts, universe, 10, scope=universe.where("chunk_id > 2")))
    assert scoped == [x for x in got if x[0] > 2]  # the scope doesn't change the IDF
    assert S.sparse_topk(q.limit(0), posts, universe, 10).count() == 0


def test_dense_in_parts_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[200:] = x[:100]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    d, q = spark.createDataFrame(rows, "chunk_id bigint, v array<double>"), spark.createDataFrame(rows[:50], "query_id bigint, v array<double>")
    s = np.round(x[:50] @ x.T, 6)
    want = {(a, int(b)) for a in range(50) for b in np.lexsort((np.arange(300), -s[a]))[:7]}
    assert {(r.query_id, r.chunk_id) for r in S.dense_topk(q, d.repartition(5), 7, 8).collect()} == want
    monkeypatch.setattr(S, "QUERY_BYTES", 1000)  # several passes
    assert {(r.query_id, r.chunk_id) for r in S.dense_topk(q, d, 7, 8).collect()} == want
    assert S.dense_topk(q.limit(0), d, 7, 8).count() == 0 and S.dense_topk(q, d.limit(0), 7, 8).count() == 0


def test_band_mode_falls_back(spark):
    from quern.functions import vectors as X

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id bigint, v array<double>").select("chunk_id", "v", X.sign_words(F.col("v"), 64).alias("sig"), X.quantize(F.col("v")).alias("codes"))
    q = base.limit(20).select(F.col("chunk_id").alias("query_id"), "sig", F.col("v").alias("dense"))
    full = {(r.query_id, r.chunk_id) for r in S.two_phase_topk(q, base, 5, 1, mode="full").collect()}
    banded = {(r.query_id, r.chunk_id) for r in S.two_phase_topk(q, base, 5, 1, mode="bands", band_count=8).collect()}
    assert len(full & banded) >= 0.5 * len(full) and all((i, i) in banded for i, in q.select("query_id").collect())
    assert {(r.query_id, r.chunk_id) for r in S.two_phase_topk(q, base, 5, 1).collect()} == full  # auto: a small index is compared whole


def test_filters(spark):
    chunks = spark.createDataFrame([(1, 1, 9, "chunk"), (2, 1, None, "parent"), (3, 2, 9, "turn"), (4, None, None, "chunk")], "chunk_id bigint, doc_id bigint, parent_id bigint, kind string")
    docs = spark.createDataFrame([(1, "a", '{"k": 1, "s": "1", "b": true, "n": null}'), (2, "b", "not json")], "doc_id bigint, source string, metadata string")
    ids = lambda f: sorted(r.chunk_id for r in S.in_scope(chunks, f, docs).collect())
    assert ids(S.Filters()) == [1, 3, 4] and ids(S.Filters(kinds=("parent",))) == [2]
    assert ids(S.Filters(doc_ids=(1,))) == [1] and ids(S.Filters(parent_ids=(9,))) == [1, 3] and ids(S.Filters(sources=("b",))) == [3]
    for value, hit in (({"k": 1}, [1]), ({"k": "1"}, []), ({"s": "1"}, [1]), ({"s": 1}, []), ({"b": True}, [1]), ({"b": 1}, []), ({"n": None}, [1]), ({"x": None}, []), ({"k": 1, "s": "1"}, [1]), ({"k": 2}, [])):
        assert ids(S.Filters(metadata=value)) == hit, value
    for bad in ({"kinds": ("other",)}, {"doc_ids": tuple(range(101))}, {"metadata": {"a'b": 1}}):
        with pytest.raises(ValueError):
            S.Filters(**bad)
    assert [r.chunk_id for r in S.lookup(chunks, [3, 77, 1, 3]).collect()] == [3, 1]


def test_hydration(spark):
    chunks = spark.createDataFrame([(1, 1, None, "chunk", 0, "before"), (2, 1, 9, "chunk", 1, "middle"), (3, 1, None, "chunk", 2, "after"), (9, 1, None, "parent", 0, "window"), (8, 2, 9, "chunk", 0, "other")], "chunk_id bigint, doc_id bigint, parent_id bigint, kind string, pos int, text string")
    hits = spark.createDataFrame([(1, 2, 1), (1, 8, 2), (1, 55, 3)], "query_id bigint, chunk_id bigint, rank int")
    wide = H.with_parents(hits, chunks)
    assert {r.chunk_id: r.wide for r in wide.collect()} == {2: "window", 8: "other"}  # a parent of another document doesn't count
    assert {r.chunk_id: r.wide for r in H.stitched(wide, chunks, 1).collect()} == {2: "before middle after", 8: "other"}
    first = spark.createDataFrame([(1, 55, 1), (1, 2, 2), (1, 8, 3)], hits.schema)
    assert [(r.chunk_id, r.rank) for r in H.backfilled(first, chunks, 1).collect()] == [(2, 1)]


def test_budget_takes_wide_narrow_or_nothing(spark):
    rows = [(1, 1, 1, "a" * 40, "a" * 400), (1, 2, 2, "b" * 40, "b" * 400), (1, 3, 3, "c" * 4000, "c" * 8000), (1, 4, 4, "d" * 40, "d" * 40)]
    got = M.within_budget(spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, rank int, text string, wide string"), 130).orderBy("rank").collect()
    assert [(r.chunk_id, len(r.chosen), r.used) for r in got] == [(1, 400, 100), (2, 40, 110), (4, 40, 120)]


def test_memory(spark):
    said = spark.createDataFrame([(1, 0, "system", "x"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "user", "u3"), (1, 5, "assistant", None)], "conv_id bigint, turn int, role string, text string")
    turns = M.record_turns(said)
    got = turns.orderBy("turn_no").collect()
    assert [(r.turn_no, r.text) for r in got] == [(1, "[user] u1\n[assistant] a1"), (2, "[user] u2\n[assistant] "), (3, "[user] u3\n[assistant] ")]
    assert math.isclose(got[0].importance, 0.35 + got[0].n_tokens / 1500)
    calls = M.consolidate(turns, lambda old, texts: f"{old}+{len(texts)}", 1).first()
    assert calls.upto == 3 and calls.summary == "None+1+1+1"

    def fails(old, texts):
        raise RuntimeError

    assert M.consolidate(turns, fails, 1).count() == 0
    hits = spark.createDataFrame([(1, 1, "turn", 5, 9, 0.5, 2.0, 1), (1, 2, "turn", 5, None, 0.5, 2.0, 2), (1, 3, "chunk", None, None, None, 1.0, 3)], "query_id bigint, chunk_id bigint, kind string, turn_no int, accessed_turn int, importance double, score double, rank int")
    score = {r.chunk_id: r.memory_score for r in M.rescore(hits, F.lit(10)).collect()}
    assert np.allclose([score[1], score[2], score[3]], [1 + 0.35 * 0.5 ** (1 / 40) + 0.125, 1 + 0.35 * 0.5 ** (5 / 40) + 0.125, 0.5 + 0.175 + 0.125], atol=1e-6)


def test_context_of_a_small_corpus_is_all_of_it(spark):
    chunks = spark.createDataFrame([(1, "chunk", "one two", 1, None), (2, "turn", "three", 1, 1), (3, "parent", "window", 1, None)], "chunk_id bigint, kind string, text string, n_tokens int, turn_no int")
    hits = spark.createDataFrame([(5, 1, "chunk", None, None, 0.5, 1.0, 1, "one two", "one two wide"), (5, 2, "turn", 1, None, 0.5, 0.9, 2, "three", "three")], "query_id bigint, chunk_id bigint, kind string, turn_no int, accessed_turn int, importance double, score double, rank int, text string, wide string")
    turns = spark.createDataFrame([(1, 1, 2, "three")], "conv_id bigint, turn_no int, chunk_id bigint, text string")
    whole = M.build_context(chunks, hits, turns, F.lit(1)).orderBy("rank").collect()
    assert [r.chosen for r in whole] == ["one two", "three"]
    searched = M.build_context(chunks, hits, turns, F.lit(1), small=0).collect()
    assert [(r.part, r.chosen) for r in searched] == [("recent", "three"), ("memory", "one two wide")]  # the recent turn goes in as it is


def test_metrics(spark):
    run = lambda ids: spark.createDataFrame([("q", d, n + 1) for n, d in enumerate(ids)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2.0), ("q", "c", 1.0), ("q", "z", 0.0)], "query_id string, doc_id string, grade double")
    m = V.metrics(run("abc"), qrels, (2, 3), 3, 3).first()
    assert m.recall_at_2 == 0.5 and m.recall_at_3 == 1.0 and m.mrr_at_3 == 1.0
    assert abs(m.ndcg_at_3 - (3 + 1 / math.log2(4)) / (3 + 1 / math.log2(3))) < 1e-6
    again = V.metrics(run("xxa"), qrels, (2,), 2, 2).first()
    assert (again.recall_at_2, again.mrr_at_2, again.ndcg_at_2) == (0, 0, 0)
    none = V.metrics(run("abc"), qrels.where("grade = 0")).first()
    assert none.recall_at_5 is None and none.mrr_at_20 is None and none.ndcg_at_10 is None
    missing = V.metrics(run("abc").limit(0), qrels).first()
    assert missing.recall_at_5 == 0 and missing.ndcg_at_10 == 0
    facts = spark.createDataFrame([("a", "f1"), ("b", "f2")], "doc_id string, fact string")
    need = spark.createDataFrame([("q", "f1"), ("q", "f2")], "query_id string, fact string")
    assert V.coverage(run("aab"), facts, need, 2).first().coverage == 0.5
    prints = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "r")], "doc_id string, fingerprint string")
    assert abs(V.duplicate_rate(run("abc"), prints, 3).first().duplicate_rate - 1 / 3) < 1e-6
    assert V.duplicate_rate(run("dd"), prints, 2).first().duplicate_rate == 1 and V.duplicate_rate(run("a"), prints).first().duplicate_rate == 0
    table = spark.createDataFrame([(1.0, None), (0.0, 3.0)], "x double, y double")
    assert {r.metric: (r["mean"], r.support) for r in V.macro(table, ["x", "y"]).collect()} == {"x": (0.5, 2), "y": (3.0, 1)}


def test_bootstrap(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=200)
    rows = [(i, float(x), float(x + 0.5 + rng.normal() * 0.1)) for i, x in enumerate(a)] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "query_id bigint, a double, b double")
    r = V.paired_bootstrap(df, 2000).first()
    assert r.n == 200 and r.low < r.delta < r.high and abs(r.delta - 0.5) < 0.05 and r.high - r.low < 0.05
    assert V.paired_bootstrap(df, 2000).first() == r and V.paired_bootstrap(df.limit(0)).count() == 0
    c = V.clustered_percentile(df.select((F.col("query_id") % 20).alias("c"), "b"), "c", "b", 0.5, 300).first()
    assert c.low <= c.point <= c.high


def test_protocol_and_reports(tmp_path):
    p = V.Protocol()
    with pytest.raises(ValueError):
        p.run("test", {"k": 1}, ["q"])
    p.run("validation", {"k": 1}, ["v"])
    assert p.run("test", {"k": 1}, ["q"]) != p.run("calibration", {"k": 1}, ["q"])
    with pytest.raises(ValueError):
        p.run("test", {"k": 2}, ["q"])
    V.write_report({"b": 1, "a": 2.5}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().index('"a"') < 10
    with pytest.raises(ValueError):
        V.write_report({"x": float("nan")}, str(tmp_path / "r.json"))
    assert len(list(tmp_path.iterdir())) == 1
    assert V.throughput(5, 1.0)["reasons"] == ["too few queries"] and V.throughput(100, 2.0) == {"qps": 50.0, "eligible": True, "reasons": []}


def test_settings(spark):
    spark.conf.set("quern.k", "7")
    try:
        assert R.Config.of(spark).k == 7 and R.Config.of(spark, "v2", k=3).k == 3
    finally:
        spark.conf.unset("quern.k")
    assert R.Config.of(spark).diversity_method == "fermionic" and R.Config.of(spark, "v2").fusion == "rrf"
    for bad in ({"k": 101}, {"k": True}, {"fusion": "x"}, {"diversity": 2.0}):
        with pytest.raises(ValueError):
            R.Config(**bad)
