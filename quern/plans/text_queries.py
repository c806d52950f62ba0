"""Queries of the text, ingest and hydration operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import text as T
from ..operators import evaluate as V
from ..operators import hydrate as H
from ..operators import ingest as I
from ..session import table

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TIDY = r"regexp_replace(regexp_replace(regexp_replace({}, '([0-9])\.\s+([0-9]{{3}})([^0-9]|$)', '\1.\2\3', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', e'\n\n', 'g')"
_NORMAL = _STRIP.format(_TIDY.format("text"))
_CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"


def _tokens_sql(t: str) -> str:
    cjk = f"len(regexp_extract_all({t}, '{_CJK}'))"
    return f"CAST(CASE WHEN length({t}) = 0 THEN 0 ELSE {cjk} + greatest(1, (length({t}) - {cjk}) // 4) END AS INTEGER)"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def text_normalize(spark, sf):
    return _documents(spark, sf).select("doc_id", T.normalize(F.col("text")).alias("text"))


def token_estimate(spark, sf):
    return _documents(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("n_tokens"))


def sentence_split(spark, sf):
    return _documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


_SENTENCES = rf"""
WITH g AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, e'\n\n'), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS ps FROM g),
s AS (SELECT doc_id, flatten(list_transform(ps, lambda x: CASE WHEN x SIMILAR TO '[{T.STOPS}\s]*' THEN [x] ELSE
  list_filter(list_transform(regexp_extract_all(x, '[^{T.STOPS}\n]+[{T.STOPS}]*\s*'), lambda y: {_STRIP.format("y")}), lambda y: y <> '') END)) AS ss FROM p),
n AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS x FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, replace(x, chr(57344), '.') AS sentence FROM n
"""


def token_stats(spark, sf):
    words = _documents(spark, sf).select("doc_id", F.explode(T.words(F.col("text"))).alias("term"))
    return words.groupBy("term", "doc_id").count().groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("tf"))


def sparse_encode(spark, sf):
    own = E.postings(_documents(spark, sf), "doc_id", "text", hashed=False)
    return own.withColumn("weight", F.round("weight", 6))


_WORDS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents"


def hash_postings(spark, sf):
    return E.postings(_documents(spark, sf), "doc_id", "text")


def hash_encode(spark, sf):
    return E.encode(_documents(spark, sf), "doc_id", "text")


def index_signatures(spark, sf):
    rows = _documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("ctx"))
    return I.index_vectors(rows).drop("dense", "tokens")


def ngram_stats(spark, sf):
    grams = _documents(spark, sf).select(F.explode(T.char_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def titles(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text", T.default_title(F.col("text")).alias("title"))
    return docs.select("doc_id", "title", T.context(F.col("title"), F.col("text"), F.lit(True)).alias("ctx"))


def digests(spark, sf):
    return _documents(spark, sf).select("doc_id", T.digest(F.col("text")).alias("digest"))


def exact_duplicates(spark, sf):
    prints = _documents(spark, sf).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_PRINT = r"sha256(lower(" + _STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')") + "))"


def numbered_blocks(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", T.numbered(F.transform("t", lambda x: x["text"]), 6500).alias("block"))


def ingest_chunks(spark, sf):
    docs = I.documents(_documents(spark, sf), source=F.col("source"))
    return I.chunks(docs)


def ingest_documents(spark, sf):
    return I.documents(_documents(spark, sf), source=F.col("source")).select("doc_id", "source", "title", "n_tokens")


def numbered_ids(spark, sf):
    return I.numbered(_documents(spark, sf).select("doc_id", "source"), [F.col("source").asc(), F.col("doc_id").desc()])


def _lines(spark, sf):
    """Lines of the documents as chunks with places, and their parent windows."""
    rows = _documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("text <> ''")
    # far from the lines' own ids, however many documents there are
    parent = F.lit(1 << 62) + F.col("doc_id") * 1_000_000 + F.floor(F.col("pos") / 4).cast("bigint")
    own = rows.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("chunk_id"), "doc_id", parent.alias("parent_id"), F.lit("chunk").alias("kind"), "pos", "text")
    windows = H.parent_windows(rows).select(parent.alias("chunk_id"), "doc_id", F.lit(None).cast("bigint").alias("parent_id"), F.lit("parent").alias("kind"), "pos", "text")
    return own, windows


_LINES = """
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents),
c AS (SELECT doc_id * 1000000 + pos AS chunk_id, doc_id, pos, pos // 4 AS g, text FROM l WHERE text <> ''),
w AS (SELECT doc_id, g, string_agg(text, ' ' ORDER BY pos) AS text FROM c GROUP BY doc_id, g)
"""


def parent_windows(spark, sf):
    own, _ = _lines(spark, sf)
    return H.parent_windows(own).withColumn("pos", F.col("pos").cast("int"))


def _line_hits(own: DataFrame) -> DataFrame:
    return own.select(F.lit(1).alias("query_id"), "chunk_id", F.lit(1.0).alias("score"))


def hydrate_parents(spark, sf):
    own, windows = _lines(spark, sf)
    return H.with_parents(_line_hits(own), own.unionByName(windows)).select("chunk_id", "text", "wide")


def stitch(spark, sf):
    own, windows = _lines(spark, sf)
    every = own.unionByName(windows)
    return H.stitched(H.with_parents(_line_hits(own), every), every, 1).select("chunk_id", "wide")


def hash_sample(spark, sf):
    """A sample: its size is what the operator is for."""
    return V.hash_sample(_documents(spark, sf), "doc_id", 50, "7").select("doc_id", "source")


QUERIES = {
    f.__name__: f
    for f in (text_normalize, token_estimate, sentence_split, token_stats, sparse_encode, hash_postings, hash_encode, index_signatures, ngram_stats, titles, digests, exact_duplicates, numbered_blocks, ingest_chunks, ingest_documents, numbered_ids, parent_windows, hydrate_parents, stitch, hash_sample)
}

_TITLE = "replace(substring({0}, 1, 60), chr(10), ' ') || CASE WHEN length({0}) > 60 THEN '…' ELSE '' END"

SQL = {
    "text_normalize": f"SELECT doc_id, {_NORMAL} AS text FROM documents",
    "token_estimate": f"SELECT doc_id, {_tokens_sql('text')} AS n_tokens FROM documents",
    "sentence_split": _SENTENCES,
    "token_stats": f"WITH w AS ({_WORDS}) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY term",
    "sparse_encode": f"WITH w AS ({_WORDS}) SELECT doc_id, term, round(1 + ln(count(*)), 6) AS weight FROM w GROUP BY doc_id, term",
    "ngram_stats": r"""
WITH p AS (SELECT doc_id, string_split(' ' || regexp_replace(lower(text), '\s+', ' ', 'g') || ' ', '') AS c FROM documents),
x AS (SELECT doc_id, unnest(c) AS a, generate_subscripts(c, 1) AS i FROM p),
w AS (SELECT a || lead(a, 1) OVER o || lead(a, 2) OVER o AS g3, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT g3 AS gram FROM w UNION ALL SELECT g3 || d FROM w UNION ALL SELECT g3 || d || e FROM w)
SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram""",
    "titles": f"""
WITH d AS (SELECT doc_id, text, {_TITLE.format("text")} AS title FROM documents)
SELECT doc_id, title, CASE WHEN length(title) = 0 OR contains(text, title) THEN text ELSE '[' || title || '] ' || text END AS ctx FROM d""",
    "digests": """
SELECT doc_id, CASE WHEN length(text) <= 20000 THEN text
  ELSE array_to_string(list_transform(range(8), lambda i: substring(text, CAST(i * (length(text) // 8) + 1 AS BIGINT), 2500)), chr(10) || '[...]' || chr(10)) END AS digest FROM documents""",
    "exact_duplicates": f"WITH f AS (SELECT doc_id, {_PRINT} AS fingerprint FROM documents) SELECT fingerprint, count(*) AS n, min(doc_id) AS first_id FROM f GROUP BY fingerprint HAVING count(*) > 1",
    "numbered_blocks": """
WITH t AS (SELECT conv_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || substring(text, 1, 6500) AS x FROM conversations)
SELECT conv_id, string_agg(x, chr(10) || chr(10) ORDER BY turn) AS block FROM t GROUP BY conv_id""",
    "ingest_documents": f"WITH d AS (SELECT doc_id, source, {_NORMAL} AS text FROM documents) SELECT doc_id, source, {_TITLE.format('text')} AS title, {_tokens_sql('text')} AS n_tokens FROM d WHERE text <> ''",
    "numbered_ids": "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id DESC) AS id FROM documents",
    "parent_windows": f"WITH {_LINES} SELECT doc_id, CAST(g * 4 AS INTEGER) AS pos, text FROM w",
    "hydrate_parents": f"WITH {_LINES} SELECT chunk_id, c.text, w.text AS wide FROM c JOIN w USING (doc_id, g)",
    "stitch": f"WITH {_LINES} SELECT a.chunk_id, string_agg(b.text, ' ' ORDER BY b.pos) AS wide FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 1 AND a.pos + 1 GROUP BY a.chunk_id",
    "hash_sample": "SELECT doc_id, source FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 50",
}
