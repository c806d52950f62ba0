"""Vector expressions over ARRAY<DOUBLE> and LONG words of bits; all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(doubles(a), lambda x: F.when(n > 0, x / n).otherwise(x))


def quantize(vector: Column) -> Column:
    """Elements in [-1, 1] as whole numbers up to 127, halves to even."""
    return F.transform(doubles(vector), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x * 127, 0))).cast("tinyint"))


def dequantize(codes: Column) -> Column:
    return F.transform(codes, lambda x: x.cast("double") / F.lit(127.0))


def sign_words(vector: Column, bits: int) -> Column:
    """Signs (1 for x >= 0) as LONG words of 64 bits, the first element in the highest bit."""

    def word(at: int) -> Column:
        part = F.slice(doubles(vector), at + 1, 64)
        return F.aggregate(F.transform(part, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - i).cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.array(*[word(at) for at in range(0, bits, 64)])


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two arrays of LONG words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bands(words: Column, count: int = 16) -> Column:
    """The first bytes of the signature, each with its position in the upper bits, so that bytes of two places are never equal."""

    def band(i: int) -> Column:
        byte = F.shiftrightunsigned(words[i // 8], 56 - 8 * (i % 8)).bitwiseAND(F.lit(255)).cast("int")
        return byte + F.lit(i << 8)

    return F.array(*[band(i) for i in range(count)])


def maxsim(query: Column, doc: Column) -> Column:
    """Mean over the query's token vectors of their greatest dot product with one of the document's; 0 where either has none."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), total).otherwise(F.lit(0.0))


def binary_maxsim(query: Column, doc: Column, bits: int = 128) -> Column:
    """maxsim of token signatures (arrays of LONG words): 1 - 2 h / bits for the least Hamming distance h."""
    best = F.transform(query, lambda q: F.lit(1.0) - F.lit(2.0) * F.array_min(F.transform(doc, lambda d: hamming(q, d))) / F.lit(bits))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), total).otherwise(F.lit(0.0))


def weighted_sum(vectors: Column) -> Column:
    """Sum of an array of vectors, at length 1."""
    first = F.transform(vectors[0], lambda x: F.lit(0.0))
    return unit(F.aggregate(vectors, first, lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y)))
