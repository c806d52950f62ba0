"""Streams: documents appended to an index, and numbered conversation turns with a rolling window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import encode as E
from ..operators import index as X
from ..operators import ingest as I
from ..session import ensure_importable

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def index_documents(stream: DataFrame, index: X.Index, checkpoint: str, encoder: E.Encoder | None = None, config: I.Chunking = I.Chunking(), available_now: bool = True) -> StreamingQuery:
    """Adds each micro-batch (doc_id, source, text) to the index as one change. A batch that is run again after a failure replaces what it wrote, since documents of the same id are replaced."""
    model = encoder or E.HashEncoder()

    def add(batch: DataFrame, _: int) -> None:
        docs = I.documents(batch, source=F.col("source"))
        chunks = I.chunks(docs, config)
        own = chunks.where("kind <> 'parent'")
        index.add(docs, chunks, I.index_vectors(own, model), E.postings(own, "chunk_id", "ctx"))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class _Turns(StatefulProcessor):
    """State of a conversation: the number of its last turn, and the texts since its last full window."""

    def __init__(self, every: int, summarize: Callable[[list[str]], str]):
        self.every, self.summarize = every, summarize

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n int")
        self.window = handle.getValueState("window", "texts array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = self.last.get()[0] if self.last.exists() else 0
        held = list(self.window.get()[0]) if self.window.exists() else []
        frame = pd.concat(list(rows)).sort_values("turn")
        out = []
        for r in frame.itertuples(index=False):
            n += 1
            held.append(r.text)
            summary = None
            if n % self.every == 0:
                summary, held = self.summarize(held), []
            out.append((key[0], n, r.text, summary))
        self.last.update((n,))
        self.window.update((held,))
        yield pd.DataFrame(out, columns=["conv_id", "turn_no", "text", "summary"])

    def close(self) -> None:
        pass


def numbered_turns(stream: DataFrame, every: int = 12, summarize: Callable[[list[str]], str] | None = None) -> DataFrame:
    """(conv_id, turn_no, text, summary) of a stream (conv_id, turn, text): turns numbered from 1 in a conversation; every `every`th has the window's summary,
    by default its texts joined. Needs the RocksDB state store (STATE_STORE); state is a number and less than `every` texts for each conversation."""
    ensure_importable(stream.sparkSession)
    fold = summarize or (lambda texts: "\n---\n".join(texts))
    rows = stream.select("conv_id", F.col("turn").cast("int").alias("turn"), "text")
    kind = stream.schema["conv_id"].dataType.simpleString()
    return rows.groupBy("conv_id").transformWithStateInPandas(_Turns(every, fold), outputStructType=f"conv_id {kind}, turn_no int, text string, summary string", outputMode="Append", timeMode="None")


def last_access(stream: DataFrame) -> DataFrame:
    """(chunk_id, accessed_turn): the last turn in which each chunk was used, kept up to date over a stream (chunk_id, turn_no); write it in update mode."""
    return stream.groupBy("chunk_id").agg(F.max("turn_no").alias("accessed_turn"))
