"""Text and encoder functions against plain Python."""

import re
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import encode as E
from quern.functions import text as T
from quern.functions import vectors as V

TEXTS = ["", " ", "Plain text. Two sentences!", "Valor 13. 243 total.\n\n\n\nNext  para\t\there.", "日本語テキスト。二つ目！ mixed 漢字 words", "5.1.2 is a section. 3.14 too", "...", "ﬁne ½ Ａ", "été déjà\n\nça", "a b", "x" * 70, "line one\nline two", "No stop", "Q? A! … B", "汉a字b", "snake_case 42nd", "？！"]


def evaluated(spark, column, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def tokens_of(t):
    cjk = len(re.findall(T.CJK, t))
    return cjk + max(1, (len(t) - cjk) // 4) if t else 0


def sentences_of(t):
    t = re.compile(r"(?<=\d)[.](?=\d)").sub("", t)
    out = []
    for p in filter(None, (p.strip() for p in t.split("\n\n"))):
        own = [s.strip() for s in re.findall(rf"[^{T.STOPS}\n]+[{T.STOPS}]*\s*", p) if s.strip()]
        out += own or [p]
    return [s.replace("", ".") for s in out]


def words_of(t):
    out = []
    for w in re.findall(r"\w+", t.lower()):
        c = re.findall(T.CJK, w)
        out += [p for p in re.split(T.CJK, w) if p] + c + [a + b for a, b in zip(c, c[1:])]
    return out


def grams_of(t, lo, hi):
    t = " " + re.sub(r"\s+", " ", t.lower()) + " "
    return [t[i : i + n] for n in range(lo, hi + 1) for i in range(len(t) - n + 1)]


def test_normalize(spark):
    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        t = re.compile(r"(\d)[.]\s+(\d\d\d)(?!\d)").sub(lambda m: f"{m[1]}.{m[2]}", t)
        return re.sub(r"\n\n\n+", "\n" * 2, re.sub("[\t ]+", " ", t)).strip()

    assert evaluated(spark, T.normalize(F.col("t"))) == [plain(t) for t in TEXTS]
    assert evaluated(spark, T.normalize(F.col("t")), [None]) == [None]


def test_estimates_sentences_words_ngrams(spark):
    assert evaluated(spark, T.estimate_tokens(F.col("t"))) == [tokens_of(t) for t in TEXTS]
    assert evaluated(spark, T.sentences(F.col("t"))) == [sentences_of(t) for t in TEXTS]
    assert evaluated(spark, T.words(F.col("t"))) == [words_of(t) for t in TEXTS]
    assert [E.word_list(t) for t in TEXTS] == [words_of(t) for t in TEXTS]
    assert evaluated(spark, T.char_ngrams(F.col("t"))) == [grams_of(t, 3, 5) for t in TEXTS]


def test_titles_contexts_digests(spark):
    title = T.default_title(F.col("t"))
    assert evaluated(spark, title) == [" ".join(t[:60].split("\n")) + "…" * (len(t) > 60) for t in TEXTS]
    assert evaluated(spark, T.context(F.lit("T"), F.col("t"), F.lit(True)), ["has T", "none"]) == ["has T", "[T] none"]
    assert evaluated(spark, T.context(F.lit("T"), F.col("t"), F.lit(False)), ["has T"]) == ["[T] has T"]
    long = "".join(chr(97 + i % 26) for i in range(25_003))
    want = "\n[...]\n".join(long[i * (len(long) // 8) : i * (len(long) // 8) + 2500] for i in range(8))
    assert evaluated(spark, T.digest(F.col("t")), [long, "short"]) == [want, "short"]
    assert evaluated(spark, T.numbered(F.split("t", ","), 3), ["abcd,e"]) == ["[1] abc\n\n[2] e"]
    a, b = evaluated(spark, T.fingerprint(F.col("t")), ["  A  b\n", "a B"])
    assert a == b


def test_packing():
    assert T.pack(list("abcde"), [3] * 5, 9, 3) == ["a b c", "c d e"]
    assert T.pack(list("abc"), [1, 20, 1], 9, 3) == ["a", "a b", "c"]

    def slow(parts, sizes, target, overlap):
        out, cur = [], []
        for p in zip(parts, sizes):
            if cur and sum(s for _, s in cur) + p[1] > target:
                out.append(cur)
                keep = []
                for q in cur[::-1]:
                    if sum(s for _, s in keep) + q[1] > overlap:
                        break
                    keep = [q, *keep]
                cur = keep
            cur = [*cur, p]
        return [" ".join(t for t, _ in c) for c in [*out, cur] if c]

    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 12, rng.integers(1, 30)).tolist()
        parts = [f"s{i}" for i in range(len(sizes))]
        target, overlap = int(rng.integers(5, 30)), int(rng.integers(0, 5))
        assert T.pack(parts, sizes, target, overlap) == slow(parts, sizes, target, overlap)
    assert T.pack([], [], 5, 1) == [] and T.pack([" "], [1], 5, 1) == []


def test_long_document_has_chunks_and_small_one_is_whole(spark):
    text = "\n\n".join(" ".join(f"Sentence {i} of paragraph {p} says something new." for i in range(40)) for p in range(12))
    big, small = evaluated(spark, T.chunks(T.sentences(F.col("t"))), [text, "One only."])
    assert len(big) > 3 and small == ["One only."]


def slow_vector(text, dims, lo, hi, prefix):
    v = np.zeros(dims)
    for g in grams_of(text, lo, hi):
        h = zlib.crc32((prefix + g).encode("utf-8", "surrogatepass"))
        v[h % dims] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=25), min_size=1, max_size=4))
def test_hashed_vectors(texts):
    got = E.hashed_vectors(texts, 64, 3, 5)
    assert np.allclose(got, [slow_vector(t, 64, 3, 5, "") for t in texts], atol=1e-6)
    assert np.allclose(E.hashed_vectors(texts, 32, 2, 4, b"t:"), [slow_vector(t, 32, 2, 4, "t:") for t in texts], atol=1e-6)


def test_encode_table_and_postings(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None), (4, "日本語 été")], "chunk_id bigint, ctx string")
    model = E.HashEncoder(64, 16, 2)
    rows = {r.chunk_id: r for r in E.encode(df, "chunk_id", "ctx", model).collect()}
    assert set(rows) == {1, 2, 4} and np.allclose(rows[1].dense, slow_vector("alpha beta alpha", 64, 3, 5, ""), atol=1e-6)
    assert len(rows[1].tokens) == 2 and np.allclose(rows[1].tokens[1], slow_vector("beta", 16, 2, 4, "t:"), atol=1e-6)
    assert rows[2].tokens == [[0.0] * 16]
    posts = {(r.chunk_id, r.term): r.weight for r in E.postings(df, "chunk_id", "ctx").collect()}
    assert posts[1, zlib.crc32(b"w:alpha")] == 1 + np.log(2) and posts[4, zlib.crc32("w:été".encode())] == 1.0
    with pytest.raises(ValueError):
        E.make_encoder("unknown")
    assert E.make_encoder("unknown", fallback=True).name == "hash"


def test_signatures(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=1024)
    rows = [base, base + rng.normal(size=1024) * 0.1, rng.normal(size=1024)]
    rows = [(i, (r / np.linalg.norm(r)).astype(np.float32).tolist()) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "i int, v array<float>").select("i", "v", E.signature(F.col("v"), 1024).alias("s"), V.quantize(F.col("v")).alias("q"))
    got = df.orderBy("i").collect()
    ham = lambda a, b: sum(bin((x ^ y) % 2**64).count("1") for x, y in zip(a.s, b.s))
    assert len(got[0].s) == 16 and ham(got[0], got[1]) < 80 < 400 < ham(got[0], got[2])
    planes = E.hyperplanes(E.SEED, 1024, 1024)
    bits = np.packbits(np.array(rows[0][1], np.float32) @ planes >= 0)
    assert np.array(got[0].s, ">i8").tobytes() == bits.tobytes()
    codes = np.array(got[0].q) / 127
    assert codes @ np.array(rows[0][1]) / np.linalg.norm(codes) > 0.99
    bands = df.select(V.bands(F.col("s")).alias("b")).first().b
    assert bands == [(i << 8) | int(bits[i]) for i in range(16)]
    assert df.select(V.hamming(F.col("s"), F.col("s")).alias("h")).first().h == 0


def test_token_signatures(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(3, 128)).astype(np.float32)
    df = spark.createDataFrame([(1, m.tolist()), (2, [])], "i int, m array<array<float>>").select("i", E.token_signatures(F.col("m"), 128).alias("s"))
    got = {r.i: r.s for r in df.collect()}
    want = np.packbits(m @ E.hyperplanes(E.SEED ^ 0x5D, 128, 128) >= 0, axis=1).view(">i8")
    assert got[1] == want.tolist() and got[2] == []


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0], [[1.0, 0.0], [0.0, 1.0]], [[0.6, 0.8]], [0.0, 0.0])], "a array<double>, b array<double>, q array<array<double>>, d array<array<double>>, z array<double>")
    r = df.select(V.dot(F.col("a"), F.col("b")), V.maxsim(F.col("q"), F.col("d")), V.unit(F.col("z")), V.sign_words(F.col("b"), 2), V.weighted_sum(F.array("a", "b")), V.maxsim(F.col("q"), F.array().cast("array<array<double>>"))).first()
    assert r[0] == 1.0 and abs(r[1] - 0.7) < 1e-12 and r[2] == [0.0, 0.0] and r[3] == [-(2**63)] and r[5] == 0.0
    assert np.allclose(r[4], np.array([4, 1]) / np.sqrt(17))


def test_numbered_keeps_6500_characters(spark):
    assert evaluated(spark, T.numbered(F.split("t", ",")), ["a" * 6500 + "," + "b" * 6501]) == ["[1] " + "a" * 6500 + "\n\n[2] " + "b" * 6500]
