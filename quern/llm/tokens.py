"""Operators 5 (token counts) and 7 (byte-level BPE encoding and decoding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_importable
from .arrow import kept, lists, over_pieces, string_bytes
from .bpe import DEFAULT_VOCAB, PATTERN, Codec, gather, sums, vocab_of

#: Bytes of text that are encoded at a time: new words of a larger piece share the steps of a replay.
ENCODE_BYTES = 2_000_000


def _codec(content: Broadcast, pattern: str, prefixes: bool) -> Codec:
    """The Python worker's codec; it lives as long as the worker, so later tasks find the chunks of earlier ones."""
    data = content.value
    return kept(("bpe", hash(data), pattern, prefixes), lambda: Codec(vocab_of(data), pattern, prefixes))


def read_vocab(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file (below 2 MB for any public vocabulary of 50,000 tokens; its size doesn't depend on the data), broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encode(texts: list[str], codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    ids, per = codec.ids_of(texts)
    tokens, n = gather(codec.flat, codec.start, codec.count, ids)
    return tokens, sums(n, per)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, pattern: str = PATTERN, check: bool = True) -> DataFrame:
    """Byte-level BPE tokens of every text, by corpus-level merge replay.

    Each task collects the words of its texts that it hasn't seen, and replays all merges over them in rank order
    with an inverted index from token pair to positions (bpe.Vocab.replay); texts are then put together from
    the words' tokens. Words don't depend on each other, so tasks need no exchange; there is no shuffle.

    Returns (id_col, tokens ARRAY<INT>, n_tokens INT, n_bytes INT, round_trip BOOLEAN), one row for each row of df.
    round_trip: the tokens, decoded, are the text's bytes (null when check is off).
    A null text has null in every column but the id; an empty one has no tokens and a true round_trip. Repeated
    rows are each encoded; null ids are kept; other columns of df, whatever their names, are ignored; an empty
    table gives an empty result. Texts of any length are encoded whole.
    """
    spark = ensure_importable(df.sparkSession)
    content = read_vocab(spark, vocab)
    id_type = df.schema[id_col].dataType

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(content, pattern, False)
        null = np.asarray(batch.column(1).is_null())
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        tokens, n = _encode(texts, codec)
        raw, offsets = string_bytes(batch.column(1))
        good = _decodes_to(tokens, n, raw, offsets, codec) if check else np.zeros(len(n), bool)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), lists(tokens, n, null), pa.array(n.astype(np.int32), mask=null), pa.array(np.diff(offsets).astype(np.int32), mask=null), pa.array(good, mask=null if check else np.ones(len(n), bool))],
            names=["_id", "tokens", "n_tokens", "n_bytes", "round_trip"],
        )

    out = df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text")).mapInArrow(over_pieces(piece, 1, ENCODE_BYTES), f"_id {id_type.simpleString()}, tokens array<int>, n_tokens int, n_bytes int, round_trip boolean")
    return out.withColumnRenamed("_id", id_col)


def _decodes_to(tokens: np.ndarray, n: np.ndarray, raw: np.ndarray, offsets: np.ndarray, codec: Codec) -> np.ndarray:
    v = codec.vocab
    back, sizes = gather(v.flat, v.starts, v.lengths.astype(np.int64), tokens)
    same_size = sums(sizes, n) == np.diff(offsets)
    if same_size.all() and np.array_equal(back, raw):
        return same_size
    ends = np.cumsum(sums(sizes, n))
    starts = ends - sums(sizes, n)
    return np.array([bool(s) and np.array_equal(back[a:b], raw[x:y]) for s, a, b, x, y in zip(same_size, starts, ends, offsets[:-1], offsets[1:])])


def decode(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """The text of every token list: (id_col, text STRING).

    Null lists give null, empty lists the empty text. Bytes that aren't UTF-8 (a list may be cut within a
    character) become U+FFFD. A token that isn't in the vocabulary, and a null in a list, is an error.
    """
    spark = ensure_importable(df.sparkSession)
    content = read_vocab(spark, vocab)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocab_of(content.value).token_bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [None if x is None else b"".join([names[i] for i in x]).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    out = df.select(df[id_col].alias("_id"), df[tokens_col].cast("array<int>").alias("_tokens")).mapInArrow(run, f"_id {id_type.simpleString()}, text string")
    return out.withColumnRenamed("_id", id_col)


def prefix_token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, pattern: str = PATTERN, budgets: tuple[int, ...] = (256, 1024)) -> DataFrame:
    """The exact token count of every prefix of every text, by dynamic programming over the words' prefixes.

    Returns (id_col, n_tokens INT, prefix_tokens ARRAY<INT>, chars_within_B INT for each budget B), one row for each
    row of df. Element i (from 1) of prefix_tokens is the number of tokens of the first i characters, encoded on their own.
    chars_within_B is the length of the longest prefix of at most B tokens. `tokens_of_prefix` and `longest_prefix`
    answer later questions from the array alone. Only the pattern PATTERN is supported: prefixes of a word under
    another pattern may split otherwise.

    A null text has nulls; an empty one 0, an empty array and 0 characters. Repeated rows and null ids are kept;
    other columns are ignored; an empty table gives an empty result. Nothing is cut or sampled; no shuffle.
    """
    if pattern != PATTERN:
        raise ValueError("prefix counts are exact for the default pattern only")
    spark = ensure_importable(df.sparkSession)
    content = read_vocab(spark, vocab)
    id_type = df.schema[id_col].dataType

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(content, pattern, True)
        null = np.asarray(batch.column(1).is_null())
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        ids, per = codec.ids_of(texts)
        flat, n = gather(codec.flat, codec.start, codec.count, ids)
        totals = codec.total[ids]
        size, whole = sums(n, per), sums(totals, per)
        before = np.cumsum(totals) - totals - np.repeat(np.cumsum(whole) - whole, per)
        counts = flat + np.repeat(before.astype(np.int32), n)
        columns = [batch.column(0), pa.array(whole.astype(np.int32), mask=null), lists(counts, size, null)]
        starts = np.cumsum(size) - size
        for b in budgets:
            within = np.flatnonzero(counts <= b)
            last = np.searchsorted(within, starts + size) - 1
            cut = np.where((last >= 0) & (len(within) > 0), within[np.maximum(last, 0)] - starts + 1 if len(within) else 0, 0)
            columns.append(pa.array(np.maximum(cut, 0).astype(np.int32), mask=null))
        return pa.RecordBatch.from_arrays(columns, names=["_id", "n_tokens", "prefix_tokens", *[f"chars_within_{b}" for b in budgets]])

    schema = f"_id {id_type.simpleString()}, n_tokens int, prefix_tokens array<int>" + "".join(f", chars_within_{b} int" for b in budgets)
    return df.select(df[id_col].alias("_id"), df[text_col].cast("string").alias("_text")).mapInArrow(over_pieces(piece, 1, ENCODE_BYTES), schema).withColumnRenamed("_id", id_col)


def tokens_of_prefix(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` characters (all of a shorter text; 0 for 0 and less)."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(prefix_tokens))
    return F.when(prefix_tokens.isNull(), None).when(n < 1, F.lit(0)).otherwise(F.try_element_at(prefix_tokens, n))


def longest_prefix(prefix_tokens: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens. Counts aren't monotone (a word's end can merge what was two
    tokens), so it looks for the last count within the budget."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    back = F.array_position(F.transform(F.reverse(prefix_tokens), lambda x: x <= b), True)
    return F.when(back > 0, F.size(prefix_tokens) - back + 1).when(prefix_tokens.isNotNull(), F.lit(0)).cast("int")
