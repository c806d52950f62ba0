"""The corpus pipeline: quality, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but the last return the columns of documents. The
stages' handling of nulls, empty texts, repeated rows, empty tables and clashing columns is that of the operators they call. A row
with a null text doesn't pass the quality stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, quality, simhash, tokens
from quern.session import ensure_checkpoint_dir, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies."""
    return simhash.drop_near_duplicates(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them: the budget is the least that uses every document once, and small sources come up to twice."""
    return mixing.mix_documents(docs, repetition_limit=2.0, keep_all=True)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, round_trip) of every row."""
    return tokens.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("mixing sources to target weights", mixed_documents),
    ("byte-level BPE encoding and decoding", encoded_documents),
]

#: A trained classifier and fingerprints can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage is written as Parquet to the shared checkpoint folder and read again; the folder of a stage
    goes when the next one is written, so that one of them is left for the result to read."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
            if i:
                before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{i - 1}")
                before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
