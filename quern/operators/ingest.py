"""Documents to chunks, parents and index tables, as one DataFrame pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import text as T
from ..functions import vectors as V
from ..session import checkpointed

#: Chunks of a document; ids are doc_id x this + place, so they keep the order of documents and places. Parents and summaries have ids of their own.
MOST_CHUNKS = 512
_SLOTS = 2048


@dataclass(frozen=True)
class Chunking:
    chunk_tokens: int = 400
    overlap: int = 60
    parent_tokens: int = 1600
    tiny_tokens: int = 500
    huge_tokens: int = 12_000

    def __post_init__(self):
        if not 0 <= self.overlap < self.chunk_tokens:
            raise ValueError("overlap must be smaller than chunk_tokens and not negative")

    @property
    def per_parent(self) -> int:
        return max(1, self.parent_tokens // self.chunk_tokens)


def chunk_id(doc_id: Column, slot: Column) -> Column:
    return doc_id.cast("bigint") * _SLOTS + slot


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: Column | None = None, title: Column | None = None) -> DataFrame:
    """(doc_id, source, title, text, n_tokens) of every row whose text is more than white space, normalised; a document without a title gets one."""
    text = T.normalize(F.col(text_col).cast("string"))
    out = df.select(F.col(id_col).alias("doc_id"), (source if source is not None else F.lit("inline")).alias("source"), (title if title is not None else F.lit("")).alias("title"), text.alias("text"))
    out = out.where("text is not null and text <> ''")
    return out.withColumns({"title": F.when(F.length(F.coalesce("title", F.lit(""))) > 0, F.col("title")).otherwise(T.default_title(F.col("text"))), "n_tokens": T.estimate_tokens(F.col("text"))})


def chunks(docs: DataFrame, config: Chunking = Chunking(), prefix: Column | None = None) -> DataFrame:
    """(chunk_id, doc_id, parent_id, kind, pos, text, ctx, n_tokens, importance) of documents' rows: chunks and their parent windows.

    A small document is one chunk without a parent. More than MOST_CHUNKS chunks in a document are an error. prefix: an expression over the documents' columns, a text to stand
    between title and chunk, such as a model's words on the document.
    """
    # one pass, no exchange: a document's chunks and windows are made from one array; each step is a column, so that nothing is computed twice
    rows = docs.withColumn("_whole", F.col("n_tokens") <= config.tiny_tokens)
    rows = rows.withColumn("_s", F.when(~F.col("_whole"), T.sentences(F.col("text"))))
    rows = rows.withColumn("_packed", T.chunks(F.col("_s"), config.chunk_tokens, config.overlap))
    rows = rows.withColumn("_p", F.when(F.col("_whole"), F.array("text")).otherwise(F.col("_packed")))
    rows = rows.withColumn("_p", F.when(F.size("_p") > MOST_CHUNKS, F.raise_error(F.concat(F.lit("too many chunks in document "), F.col("doc_id").cast("string"))).cast("array<string>")).otherwise(F.col("_p")))
    n, per = F.size("_p"), config.per_parent
    none = F.lit(None).cast("bigint")

    def row(slot: Column, parent: Column, kind: str, pos: Column, text: Column) -> Column:
        return F.struct(chunk_id(F.col("doc_id"), slot).alias("chunk_id"), parent.alias("parent_id"), F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), text.alias("text"))

    def window(i: Column) -> Column:
        return chunk_id(F.col("doc_id"), MOST_CHUNKS + F.floor(i / per))

    own = F.transform("_p", lambda t, i: row(i, F.when(~F.col("_whole"), window(i)).cast("bigint"), "chunk", i, t))
    parents = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / per).cast("int")), lambda g: row(MOST_CHUNKS + g, none, "parent", g * per, F.array_join(F.slice("_p", g * per + 1, F.lit(per)), " ")))
    every = F.when(F.col("_whole") | (n < 1), own).otherwise(F.concat(own, parents))
    flat = rows.select("doc_id", "title", "_whole", *([] if prefix is None else [prefix.alias("_prefix")]), F.inline(every))
    body = F.col("text") if prefix is None else F.when(F.col("_whole"), F.col("text")).otherwise(F.concat("_prefix", F.lit("\n"), F.col("text")))
    ctx = F.when(F.col("kind") == "chunk", T.context(F.col("title"), body, F.col("_whole")))
    return flat.select("chunk_id", "doc_id", "parent_id", "kind", "pos", "text", ctx.alias("ctx"), T.estimate_tokens(F.col("text")).alias("n_tokens"), F.lit(0.5).alias("importance"))


def summaries(docs: DataFrame, summary: Column, config: Chunking = Chunking()) -> DataFrame:
    """A summary chunk (pos -1) for every huge document; summary is the caller's expression over the documents' columns, such as a model over functions.text.digest."""
    huge = docs.where(F.col("n_tokens") >= config.huge_tokens).withColumn("_s", F.trim(summary)).where("_s is not null and _s <> ''")
    return huge.select(
        chunk_id(F.col("doc_id"), F.lit(_SLOTS - 1)).alias("chunk_id"), "doc_id", F.lit(None).cast("bigint").alias("parent_id"), F.lit("summary").alias("kind"), F.lit(-1).alias("pos"), F.col("_s").alias("text"),
        F.concat(F.lit("[summary of "), F.col("title"), F.lit("] "), F.col("_s")).alias("ctx"), T.estimate_tokens(F.col("_s")).alias("n_tokens"), F.lit(0.5).alias("importance"),
    )


def index_vectors(searchable: DataFrame, encoder: E.Encoder | None = None, signatures: bool = True) -> DataFrame:
    """(chunk_id, dense, tokens, sig, codes, constellation) of chunks (chunk_id, ctx); the last three only with signatures."""
    model = encoder or E.HashEncoder()
    out = E.encode(searchable, "chunk_id", "ctx", model)
    if not signatures:
        return out
    return out.withColumns({"sig": E.signature(F.col("dense"), model.dense_dim), "codes": V.quantize(F.col("dense")), "constellation": E.token_signatures(F.col("tokens"), model.token_dim)})


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with id: 1, 2, ... in the order given. The sorted partitions are written once, so that counts and rows are of the same partitions; only one count
    for each partition meets on the driver. Rows that are equal in the order come in any order among themselves."""
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition and, below it, 33 bits of the place there
    parts = checkpointed(sorted_).withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)})
    before, so_far = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect()):
        before.append((part, so_far))
        so_far += n
    starts = spark.createDataFrame(before, "_part bigint, _before bigint")
    return parts.join(F.broadcast(starts), "_part").withColumn("id", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
