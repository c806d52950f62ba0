"""Rows that operators must stand: nulls, empty and long texts, repeated rows, and columns named like the operators' own."""

LONG = " ".join(f"word{i % 7919} ünd,\n" for i in range(60_000))

MESSY = ("id", "row", "fp", "key", "x", "h", "h2", "src", "q_doc", "q_h", "tokens", "epoch", "block", "cut", "total", "score", "keep", "root", "node", "_text", "_id", "place", "a.b")

_PROSE = "The quick brown fox jumps over the lazy dog while seven wise wizards brew potent mixtures for their guests tonight. "


def messy_rows():
    texts = [_PROSE, _PROSE, None, "", "  \n ", "?!", LONG, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.", _PROSE + "Really", "a", "1 2 3", _PROSE]
    sources = ["s1", "s1", None, "s2", "s1", "s2", None, "s3", "s1", "s3", "s2", "s1"]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 9, 10, 10, 1]
    return [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]


def messy(spark):
    df = spark.createDataFrame(messy_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(MESSY)])
