"""HTML extraction and URL filter."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from quern.llm import html, urls
from quern.session import table


def naive_content(page: str) -> list[str]:
    """Path by path and neighbour by neighbour."""
    nodes = html.text_nodes(page)
    if not nodes:
        return []
    by = defaultdict(list)
    for p, t in nodes:
        by[p].append(t)
    chars = {p: sum(map(len, ts)) / len(ts) for p, ts in by.items()}
    marks = {p: sum(len(html._MARKS.findall(t)) for t in ts) / len(ts) for p, ts in by.items()}

    def smoothed(ratio, i):
        near = [(math.exp(-0.5 * (j - i) ** 2), ratio[nodes[j][0]]) for j in range(max(0, i - 2), min(len(nodes), i + 3))]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused = [smoothed(chars, i) * smoothed(marks, i) for i in range(len(nodes))]
    value = {p: np.mean([f for f, (q, _) in zip(fused, nodes) if q == p]) for p in by}
    if max(value.values()) > 0:
        good = {p for p in by if value[p] >= 0.5 * np.std(fused) - 1e-9}
    else:
        plain = {p: np.mean([smoothed(chars, i) for i, (q, _) in enumerate(nodes) if q == p]) for p in by}
        good = {p for p in by if plain[p] >= 0.5 * max(plain.values()) - 1e-9}
    return [t for p, t in nodes if p in good]


def test_extract_against_path_by_path(spark, sf):
    pages = table(spark, sf, "pages")
    sources = {r.page_id: r.html for r in pages.collect()}
    got = html.extract(pages).collect()
    assert len(got) == len(sources)
    for r in got:
        assert r.text == "\n".join(naive_content(sources[r.page_id]))
        assert r.n_nodes == len(html.text_nodes(sources[r.page_id]))


def test_extract_keeps_the_article(sf):
    import re

    kept = lost = other = 0
    for page in pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist():
        article = Counter(t for _, t in html.text_nodes(re.search(r"<article.*</article\s*>", page, re.S).group()))
        found = Counter(html.content(page)[0])
        size = lambda c: sum(len(t) * n for t, n in c.items())
        kept, lost, other = kept + size(article & found), lost + size(article - found), other + size(found - article)
    assert kept / (kept + lost) >= 0.95 and kept / (kept + other) >= 0.95


def test_text_nodes():
    page = "<html><head><title>T</title></head><body>a<p>b &amp; c<p>d<br>e<div>f<script>var x='<p>no</p>'</script></div><ul><li>1<li>2</ul><!-- no --><b title='>'>g</b></x>h<table><tr><td>i<td>j<tr><td>k</table>"
    assert html.text_nodes(page) == [
        ("html/body", "a"), ("html/body/p", "b & c"), ("html/body/p", "d"), ("html/body/p", "e"), ("html/body/div", "f"), ("html/body/ul/li", "1"), ("html/body/ul/li", "2"),
        ("html/body/b", "g"), ("html/body", "h"), ("html/body/table/tr/td", "i"), ("html/body/table/tr/td", "j"), ("html/body/table/tr/td", "k"),
    ]
    assert html.text_nodes("a < b and <unclosed") == [("", "a < b and <unclosed")]


def test_extract_edge_cases(spark):
    deep = "<div>" * 3000 + "deep words, here." + "</div>" * 3000
    rows = [(1, None), (2, ""), (3, "   "), (4, "<p></p>"), (5, "plain words"), (5, "plain words"), (None, "<p>Some text, with marks.</p>"), (6, deep), (7, "<p>" + "Long text, yes. " * 50_000 + "</p><nav>x</nav>"), (8, "<a>x</a><a>y</a><p>words without any mark at all</p>")]
    df = spark.createDataFrame([(*r, "u", "clash", 1) for r in rows], "page_id bigint, html string, url string, text string, n_nodes int")
    out = html.extract(df)
    assert out.columns == ["page_id", "text", "n_nodes", "n_content"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.page_id].append(r)
    assert got[1][0].text is None and got[1][0].n_nodes is None
    assert all(got[i][0].text == "" and got[i][0].n_content == 0 for i in (2, 3, 4))
    assert [r.text for r in got[5]] == ["plain words"] * 2
    assert got[None][0].text == "Some text, with marks." and got[6][0].text == "deep words, here."
    assert len(got[7][0].text) > 700_000 and got[8][0].text == "words without any mark at all"
    assert html.extract(df.limit(0)).count() == 0


def all_splits(run):
    for cuts in itertools.product((False, True), repeat=len(run) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        yield [run[a:b] for a, b in zip(at, at[1:])]


def test_viterbi_against_all_splits():
    counts = {"free": 50, "bets": 20, "bet": 30, "s": 2, "cheap": 9, "pills": 8, "the": 100, "rapist": 1, "therapist": 4, "a": 60, "now": 12, "here": 10, "nowhere": 3}
    model = urls.Segmenter(counts)

    def cost(parts):
        return sum(model.cost[w] if w in model.cost else model.unknown + len(w) * model.letter for w in parts)

    for run in ("freebets", "cheappills", "therapist", "nowhere", "freexyzbets", "zzz", "abets", "qfree", "thea"):
        best = min(cost(p) for p in all_splits(run))
        assert math.isclose(cost(model.words(run)), best), run
    assert model.words("freebets") == ["free", "bets"] and model.words("freexyzbets") == ["free", "xyz", "bets"]


def test_host_and_path():
    assert urls.host_and_path("https://user:pw@WWW.Free-Bets.example.com:8080/a/b?q=1#f") == ("www.free-bets.example.com", "/a/b")
    assert urls.host_and_path("example.com/x") == ("example.com", "/x")
    assert urls.host_and_path("") == ("", "") and urls.host_and_path("http://") == ("", "")


def test_scores_against_direct_bayes(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in urls.score_urls(pages).collect()}
    counts = {r.w: r["count"] for r in urls.word_counts(pages, "html", "url").collect()}
    model = urls.Segmenter(counts)
    rows = []
    for r in pages.select("page_id", "url").collect():
        plain, host, path = model.tokens(r.url)
        rows.append((r.page_id, [w if w in model.cost or w == "<num>" else "<unk>" for w in host + path], bool(set(urls.SEEDS) & set(plain))))
    words = {c: Counter(w for _, ws, bad in rows if bad == c for w in ws) for c in (True, False)}
    v = len(words[True] | words[False]) + 1
    n = Counter(bad for _, _, bad in rows)
    assert n[True] and n[False]
    for i, ws, _ in rows:
        s = math.log((n[True] + 0.5) / (n[False] + 0.5))
        for w in ws:
            s += math.log((words[True][w] + 0.5) / (words[True].total() + 0.5 * v)) - math.log((words[False][w] + 0.5) / (words[False].total() + 0.5 * v))
        assert math.isclose(got[i].score, s, rel_tol=1e-9, abs_tol=1e-9) and got[i].blocked == (s > 0)
    for i, _, bad in rows:  # hosts with a seed are blocked, others aren't
        assert got[i].blocked == bad


def test_joined_names_are_found(spark):
    texts = "cheap pills here and free bets there with casino games, the garden club meets"
    rows = [(i, u, texts) for i, u in enumerate(["http://cheap-pills.example.com/buy"] * 5 + ["http://garden-club.example.org/meets"] * 20 + ["http://cheappills.example.net/buy", "http://gardenclub.example.net/meets"])]
    got = {r.page_id: r for r in urls.score_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[25].host_words[:2] == ["cheap", "pills"] and got[25].blocked
    assert got[26].host_words[:2] == ["garden", "club"] and not got[26].blocked


def test_rare_words_and_seeds_count_in_a_large_vocabulary(spark):
    def word(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    filler = " ".join(w for w in map(word, range(30_000)) for _ in range(2)) + " " + " ".join(w + "q" for w in map(word, range(30_000)) for _ in range(2))
    pages = [("http://zebrafish-viagra.example.com/buy", "zebrafish"), ("http://zebrafishviagra.example.net/buy", ""), ("http://garden-club.example.org/meets", filler)]
    rows = [(i, u, t) for i, (u, t) in enumerate(pages)]
    got = {r.page_id: r for r in urls.score_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].host_words[:2] == ["zebrafish", "viagra"]
    assert got[1].score > got[2].score


def test_url_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "http://casino.example.com/", ""), (3, "http://casino.example.com/", ""), (None, "http://fine.example.com/a", "fine words"), (4, "http://" + "a" * 20_000 + ".com/", None), (5, "not a url", ""), (6, "http://пример.рф/страница", "страница")]
    df = spark.createDataFrame([(*r, 1.5, "c", True) for r in rows], "page_id bigint, url string, html string, score double, words string, label boolean")
    out = urls.score_urls(df)
    assert out.columns == ["page_id", "url", "host_words", "score", "blocked"]
    got = out.collect()
    assert len(got) == len(rows)
    null = [r for r in got if r.url is None]
    assert null[0].score is None and null[0].host_words is None and not null[0].blocked
    twice = [r for r in got if r.page_id == 3]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].blocked
    clean = urls.score_urls(df.where("page_id <> 3 or page_id is null")).collect()
    assert not any(r.blocked for r in clean)
    assert urls.score_urls(df.limit(0)).count() == 0


def test_long_words_single_letters_and_other_scripts_are_in_the_model(spark):
    long, twin = "donaudampfschifffahrtsgesellschaft", "donaudampfschifffahrtsgesell"
    texts = f"{long} {long} {twin} alle neun 网 店 网 plan b plan b x"
    urls_ = [f"http://neun{long}.example.com/x", f"http://{twin}plan.example.com/", "http://网店.example.com/", "http://planb.example.com/", "http://casino-" + long + ".example.org/"]
    rows = [(i, u, texts) for i, u in enumerate(urls_)]
    got = {r.page_id: r.host_words for r in urls.score_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0][:2] == ["neun", long] and got[1][:2] == [twin, "plan"] and got[2][:2] == ["网", "店"] and got[3][:2] == ["plan", "b"]


def test_labels_take_the_seeds_place_and_score_held_out_urls(spark):
    rng = random.Random(5)
    bad, good = ["loan", "cash", "fast", "win"], ["garden", "school", "river", "museum"]
    rows, told = [], []
    for i in range(400):
        unwanted = i % 2 == 0
        u = "http://" + "".join(rng.sample(bad if unwanted else good, 2)) + f".example.com/p{i}"
        rows.append((i, u, " ".join(bad + good)))
        if i < 200:
            told.append((u, unwanted))
    labels = spark.createDataFrame([*told, (None, True), ("http://nowhere.example.com", None)], "url string, unwanted boolean")
    got = {r.page_id: r.blocked for r in urls.score_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"), labels=labels).collect()}
    assert sum(got[i] == (i % 2 == 0) for i in range(200, 400)) >= 198
