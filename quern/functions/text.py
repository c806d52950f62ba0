"""Text expressions: normalisation, token estimates, sentences, words, n-grams, chunks.

All are built-in expressions that stay in the JVM, but for NFKC and the packing of sentences, which have no built-in form.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Han, kana, Hangul and compatibility ideographs.
CJK = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]"
WORD = r"[\p{L}\p{N}_]+"
#: Marks that end a sentence, in many scripts.
STOPS = r"…\.!?。！？।॥؟۔၊။։።"
_GUARD = ""
_EDGES = r"(?U)^\s+|\s+$"


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition; ASCII texts pass through as they are."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def tidy(text: Column) -> Column:
    """normalize without NFKC: numbers broken after a thousands point are joined, blanks collapse, at most one empty line."""
    joined = F.regexp_replace(text, r"(\d)\.(?U:\s+)(\d{3})(?!\d)", "$1.$2")
    return strip(F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n\n\n+", "\n\n"))


def normalize(text: Column) -> Column:
    return tidy(nfkc(text))


def estimate_tokens(text: Column) -> Column:
    """One token for each CJK character, and one for four others (1 at least); 0 for an empty text."""
    cjk = F.regexp_count(text, F.lit(CJK))
    rest = F.floor((F.length(text) - cjk) / F.lit(4))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(cjk + F.greatest(F.lit(1), rest)).cast("int")


def sentences(text: Column) -> Column:
    """Sentences in order; blank lines always end one, points between digits never do. A paragraph of marks alone is a sentence."""
    guarded = F.regexp_replace(text, r"(?<=\d)\.(?=\d)", _GUARD)
    found = rf"(?U)[^{STOPS}\n]+[{STOPS}]*\s*"

    def parts(paragraph: Column) -> Column:
        own = F.filter(F.transform(F.regexp_extract_all(paragraph, F.lit(found), F.lit(0)), strip), lambda s: s != "")
        return F.when(F.size(own) > 0, own).otherwise(F.array(paragraph))

    paragraphs = F.filter(F.transform(F.split(guarded, "\n\n"), strip), lambda p: p != "")
    return F.transform(F.flatten(F.transform(paragraphs, parts)), lambda s: F.replace(s, F.lit(_GUARD), F.lit(".")))


def words(text: Column) -> Column:
    """Lower-case words; CJK stretches give their characters and the pairs of neighbours instead."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def split(word: Column) -> Column:
        chars = F.regexp_extract_all(word, F.lit(CJK), F.lit(0))
        pairs = F.when(F.size(chars) > 1, F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.filter(F.split(word, CJK), lambda x: x != ""), chars, pairs)

    return F.when(text.rlike(CJK), F.flatten(F.transform(plain, split))).otherwise(plain)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams of the text in lower case between two blanks, white space collapsed, shorter ones first."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)\s+", " "), F.lit(" "))

    def grams(chars: Column) -> Column:
        def of(n: Column) -> Column:
            return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), of))

    # the characters are a variable of an outer function, so that they are made once: time is in proportion to the text
    return F.element_at(F.transform(F.array(F.split(padded, "")), grams), 1)


def default_title(text: Column) -> Column:
    """The first 60 characters on one line, with an ellipsis if there are more."""
    return F.concat(F.translate(F.substring(text, 1, 60), "\n", " "), F.when(F.length(text) > 60, F.lit("…")).otherwise(F.lit("")))


def context(title: Column, text: Column, whole: Column) -> Column:
    """What is encoded: the text with its title before it; a whole document that holds its title stands alone."""
    bare = (F.length(title) == 0) | (F.instr(text, title) > 0)
    return F.when(whole & bare, text).otherwise(F.concat(F.lit("["), title, F.lit("] "), text))


def digest(text: Column, budget: int = 20_000, windows: int = 8) -> Column:
    """A long text as evenly spaced windows over its whole length."""
    step = F.floor(F.length(text) / F.lit(windows)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(text, i * step + 1, F.lit(budget // windows)))
    return F.when(F.length(text) <= budget, text).otherwise(F.array_join(cut, "\n[...]\n"))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed."""
    return F.sha2(F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " "))), 256)


def numbered(texts: Column, longest: int = 6500) -> Column:
    """Texts, cut to a length, as one numbered text."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(t, F.lit(1), F.lit(longest)))), "\n\n")


def pack(parts: list[str], sizes: list[int], target: int, overlap: int) -> list[str]:
    """Sentences joined to chunks of about target tokens; a chunk begins with the last sentences of the one before, up to overlap tokens."""
    found: list[str] = []
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > target:
            found.append(" ".join(parts[begin:at]))
            first, begin, held = begin, at, 0
            while begin > first and held + sizes[begin - 1] <= overlap:
                begin -= 1
                held += sizes[begin]
        held += size
    if parts:
        found.append(" ".join(parts[begin:]))
    return [c for c in found if c.strip()]


def chunks(parts: Column, target: int = 400, overlap: int = 60) -> Column:
    """The chunks of a text's sentences, in order. Sentences and their sizes come from the JVM; only the packing, a sequential fold, is Python's."""

    @F.pandas_udf("array<string>")
    def packed(parts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else pack(list(p), [int(x) for x in n], target, overlap) for p, n in zip(parts, sizes)])

    return packed(parts, F.transform(parts, estimate_tokens))
