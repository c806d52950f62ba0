"""Sources of documents and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that hold no text.
SKIPPED = ("png", "jpg", "jpeg", "gif", "pdf", "zip", "db", "npy", "pyc")
MOST_BYTES = 16 << 20


def inline(spark: SparkSession, texts: list[tuple[int, str]], source: str = "inline") -> DataFrame:
    """(doc_id, source, text)."""
    return spark.createDataFrame([(i, source, t) for i, t in texts], "doc_id bigint, source string, text string")


def read_folder(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, text) of the files below path, ids from 1 in order of their paths. Files without text by their name are skipped, and
    larger ones than MOST_BYTES are an error; bytes that aren't UTF-8 become U+FFFD."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = reader.load(path).where(~suffix.isin(*SKIPPED))
    content = F.when(F.col("length") > MOST_BYTES, F.raise_error(F.concat(F.lit("file too large: "), F.col("path"))).cast("binary")).otherwise(F.col("content"))

    @F.arrow_udf("string")
    def text(blobs):
        import pyarrow as pa

        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in blobs.to_pylist()], pa.string())

    from ..operators.ingest import numbered

    paths = numbered(files.select("path"), [F.col("path").asc()])
    return files.withColumn("text", text(content)).join(paths, "path").select(F.col("id").alias("doc_id"), F.col("path").alias("source"), "text")


def read_beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc_id, title, text), queries (query_id, text) and qrels (query_id, doc_id, grade) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").withColumnRenamed("_id", "doc_id")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").withColumnRenamed("_id", "query_id")
    qrels = spark.read.option("sep", "\t").option("header", "true").schema("query_id string, doc_id string, grade double").csv(f"{path}/qrels/{split}.tsv")
    return corpus, queries, qrels


def synthetic_corpus(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(doc_id, source, text, topic, code): made-up documents; every fourth repeats the one before it."""
    base = F.when(F.col("id") % 4 == 3, F.col("id") - 1).otherwise(F.col("id"))
    topics = F.array(*[F.lit(t) for t in ("storage", "network", "billing", "safety", "travel", "archive")])
    rows = spark.range(n).withColumn("_b", base)
    topic = F.element_at(topics, (F.pmod("_b", F.lit(6)) + 1).cast("int"))
    code = F.concat(F.lit("C-"), F.lpad(F.pmod(F.xxhash64(F.lit(seed), "_b"), F.lit(1_000_000)).cast("string"), 6, "0"))
    limit = F.pmod(F.xxhash64(F.lit(seed + 1), "_b"), F.lit(900)) + 100
    text = F.concat(F.lit("Rule "), code, F.lit(" on "), topic, F.lit(". Requests up to "), limit.cast("string"), F.lit(" units are granted within "), (F.pmod("_b", F.lit(29)) + 1).cast("string"), F.lit(" days."))
    return rows.select(F.col("id").alias("doc_id"), F.lit("synthetic").alias("source"), text.alias("text"), topic.alias("topic"), code.alias("code"))
