"""Byte-level BPE and prefix token counts, against another implementation of the same vocabulary."""

import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import bpe, tokens
from quern.session import table

from .common import LONG, messy


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCAB, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocab_of(open(bpe.DEFAULT_VOCAB, "rb").read())


def encoded(texts, codec):
    out, n = tokens._encode(texts, codec)
    ends = n.cumsum()
    return [out[e - k : e].tolist() for e, k in zip(ends, n)]


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n\n a \t b", "don't we'll I've", "été déjà ça", "日本語 テキスト", "🙂🙂 🙂", "aaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "    x", "1234567 890", "a\r\nb", "\0a\0 b\0", "'s 's're 're", "<|endoftext|>", "ab" * 700, "é ‍", "!?!?  !!"]


def test_encoding_of_odd_texts(reference, vocab):
    codec = bpe.Codec(vocab)
    assert encoded(ODD, codec) == [reference.encode_ordinary(t) for t in ODD]
    assert encoded(ODD[::-1], codec) == [reference.encode_ordinary(t) for t in ODD[::-1]]  # chunks known by now


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'abeinrst")), max_size=60), max_size=5))
def test_encoding_of_any_text(reference, vocab, texts):
    assert encoded(texts, bpe.Codec(vocab)) == [reference.encode_ordinary(t) for t in texts]


def test_encoding_with_full_dictionary(reference, vocab, monkeypatch):
    monkeypatch.setattr(bpe.Codec, "CAP", 3)
    codec = bpe.Codec(vocab)
    for _ in range(2):
        for t in ODD:
            assert encoded([t], codec) == [reference.encode_ordinary(t)]


def test_encode_table(spark, sf, reference):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.encode(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.tokens == reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(r.tokens) and r.n_bytes == len(texts[r.doc_id].encode()) and r.round_trip
    back = tokens.decode(tokens.encode(docs)).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_encode_edge_cases(spark, reference):
    df = messy(spark)
    out = tokens.encode(df)
    assert out.columns == ["doc_id", "tokens", "n_tokens", "n_bytes", "round_trip"]
    got = out.collect()
    assert len(got) == df.count()
    want = sorted((str(r.doc_id), None if r.text is None else reference.encode_ordinary(r.text)) for r in df.select("doc_id", "text").collect() if r.text is not None)
    assert sorted((str(r.doc_id), r.tokens) for r in got if r.tokens is not None) == want
    null = [r for r in got if r.tokens is None]
    assert len(null) == 1 and null[0].doc_id == 3 and null[0].n_tokens is None and null[0].round_trip is None
    assert all(r.round_trip for r in got if r.tokens is not None)
    assert tokens.encode(df.limit(0)).count() == 0 and tokens.decode(out.limit(0)).count() == 0


def test_decode_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, [], "t"), (3, [10995], "t")], "doc_id bigint, tokens array<int>, text string")
    got = {r.doc_id: r.text for r in tokens.decode(df).collect()}
    assert got[1] is None and got[2] == "" and isinstance(got[3], str)
    with pytest.raises(Exception):
        tokens.decode(spark.createDataFrame([(1, [60_000])], "doc_id bigint, tokens array<int>")).collect()


def test_round_trip_flag_sees_other_bytes(vocab):
    import numpy as np

    codec = bpe.Codec(vocab)
    t, n = tokens._encode(["abc def", "xyz"], codec)
    raw = np.frombuffer(b"abc defxyZ", np.uint8)
    assert tokens._decodes_to(t, n, raw, np.array([0, 7, 10]), codec).tolist() == [True, False]


def counts(text, reference):
    return [len(reference.encode_ordinary(text[:i])) for i in range(1, len(text) + 1)]


def prefix_rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in tokens.prefix_token_counts(df, budgets=(3, 20)).collect()}


def test_prefix_counts(spark, sf, reference):
    texts = [r.text[:1500] for r in table(spark, sf, "documents").orderBy("doc_id").limit(40).collect()] + ODD
    got = prefix_rows(spark, texts)
    for i, t in enumerate(texts):
        want = counts(t, reference)
        assert got[i].prefix_tokens == want, t[:50]
        assert got[i].n_tokens == (want[-1] if want else 0)
        for b in (3, 20):
            assert got[i][f"chars_within_{b}"] == max((k + 1 for k, c in enumerate(want) if c <= b), default=0)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'abeinrstlv")), max_size=40))
def test_prefix_counts_of_any_text(reference, vocab, text):
    codec = bpe.Codec(vocab, prefixes=True)
    ids, per = codec.ids_of([text])
    flat, n = bpe.gather(codec.flat, codec.start, codec.count, ids)
    totals = codec.total[ids]
    import numpy as np

    assert (flat + np.repeat(np.cumsum(totals) - totals, n)).tolist() == counts(text, reference)


def test_prefix_questions_and_edge_cases(spark):
    df = messy(spark)
    out = tokens.prefix_token_counts(df)
    asked = out.select("doc_id", "n_tokens", "prefix_tokens", tokens.tokens_of_prefix(F.col("prefix_tokens"), 5).alias("five"), tokens.tokens_of_prefix(F.col("prefix_tokens"), 10**6).alias("all"), tokens.longest_prefix(F.col("prefix_tokens"), 256).alias("fit"), "chars_within_256")
    rows = asked.collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.prefix_tokens is None:
            assert r.doc_id == 3 and r.n_tokens is None and r.five is None and r.fit is None
            continue
        assert r.fit == r.chars_within_256
        assert r["all"] == r.n_tokens if r.prefix_tokens else r["all"] == 0
        assert r.five == (r.prefix_tokens[min(5, len(r.prefix_tokens)) - 1] if r.prefix_tokens else 0)
    assert max(len(r.prefix_tokens or []) for r in rows) == len(LONG)
    assert tokens.prefix_token_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.prefix_token_counts(df, pattern=r"\S+|\s+")
