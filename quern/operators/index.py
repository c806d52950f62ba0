"""The index: tables of Parquet files in a folder, with a manifest that names the current version of each.

A change writes new files beside the old ones and then replaces the manifest in one step, so readers see all of a change or
none of it, and a lost executor or a failed job leaves the index as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "meta": "key string, value string",
    "docs": "doc_id bigint, source string, title string, n_tokens int, metadata string",
    "chunks": "chunk_id bigint, doc_id bigint, parent_id bigint, kind string, pos int, text string, ctx string, n_tokens int, importance double, turn_no int, accessed_turn int",
    "vectors": "chunk_id bigint, dense array<float>, tokens array<array<float>>, sig array<bigint>, codes array<tinyint>, constellation array<array<bigint>>",
    "postings": "chunk_id bigint, term bigint, weight double",
}
_OWNED = ("vectors", "postings")


def fingerprint(spec: dict) -> str:
    """SHA-256 of what the index was built with, as canonical JSON."""
    return hashlib.sha256(json.dumps(spec, allow_nan=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


# -- changes as functions on tables; the index applies them and writes the results --


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new; rows with the same keys are replaced. Of several new rows with the same keys the last in order of all columns stays."""
    rest = [F.col(c).desc_nulls_last() for c in new.columns if c not in keys]
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))).where("_n = 1").drop("_n") if rest else new.dropDuplicates(keys)
    return old.join(once.select(*keys), keys, "left_anti").select(*old.columns).unionByName(once.select(*old.columns))


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)


def cleared_parents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks whose parent_id is null where the parent (gone: chunk_id) is deleted."""
    lost = gone.select(F.col("chunk_id").alias("_g")).distinct()
    out = chunks.join(lost, F.col("parent_id") == F.col("_g"), "left").withColumn("parent_id", F.when(F.col("_g").isNull(), F.col("parent_id")))
    return out.select(*chunks.columns)


def touched(chunks: DataFrame, used: DataFrame, turn: Column) -> DataFrame:
    """chunks whose accessed_turn is turn where used (chunk_id) names them."""
    now = used.select("chunk_id").distinct().withColumn("_used", F.lit(True))
    return chunks.join(now, "chunk_id", "left").withColumn("accessed_turn", F.when(F.col("_used"), turn.cast("int")).otherwise(F.col("accessed_turn"))).select(*chunks.columns)


#: Parts of a table that are appended before it is written anew.
MOST_PARTS = 64


def orphans(children: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """(relation, n): rows of children whose key isn't null and isn't in parents."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti").agg(F.lit(name).alias("relation"), F.count("*").alias("n"))


def _parts(at: str | list[str] | None) -> list[str]:
    """Folders of a table by its manifest's entry."""
    return [] if at is None else [at] if isinstance(at, str) else list(at)


class Index:
    """Tables of SCHEMAS in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, spec: dict | None = None):
        """spec: what vectors are made with (encoder, dimensions, ...). An index with another spec, and one with rows but no spec, won't open."""
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._base = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._pending: dict[str, str] | None = None
        self._fs.mkdirs(self._base)
        if spec is not None:
            own, held = fingerprint(spec), self.get_meta("fingerprint")
            if held is None and self._manifest().get("chunks") and not self.table("chunks").isEmpty():
                raise ValueError("the index has chunks but no fingerprint")
            if held is not None and held != own:
                raise ValueError("the index was built with another encoder or dimensions")
            if held is None:
                self.set_meta("fingerprint", own)

    # -- storage

    def _manifest(self) -> dict[str, str]:
        if self._pending is not None:
            return self._pending
        return json.loads(self._text("manifest.json") or "{}")

    def _text(self, name: str) -> str | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, manifest: dict[str, str]) -> None:
        jvm = self.spark.sparkContext._jvm
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{uuid.uuid4().hex}.json")
        stream = self._fs.create(fresh)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        options = jvm.org.apache.hadoop.fs.Options.Rename
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json"), array)

    @contextmanager
    def transaction(self):
        """Changes inside become visible together at the end, or not at all if one fails. An inner transaction that fails undoes its own changes only."""
        outer = self._pending
        self._pending = dict(self._manifest())
        try:
            yield self
        except BaseException:
            self._pending = outer
            raise
        done, self._pending = self._pending, outer
        if outer is None:
            self._publish(done)
        else:
            self._pending = done

    def table(self, name: str) -> DataFrame:
        """The table as it is now; one whose columns aren't those expected is an error."""
        at = self._manifest().get(name)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.parquet(*[f"{self.path}/{x}" for x in _parts(at)])
        want = StructType.fromDDL(SCHEMAS[name])
        if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in want]:
            raise ValueError(f"table {name} has the columns {df.schema.simpleString()}")
        return df

    def _written(self, name: str, df: DataFrame) -> str:
        want = StructType.fromDDL(SCHEMAS[name])
        have = set(df.columns)
        rows = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
        if name == "postings":  # rows of a term stand together: statistics of the files skip those without it
            rows = rows.repartition("term").sortWithinPartitions("term", "chunk_id")
        at = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{at}")
        return at

    def write(self, name: str, df: DataFrame) -> None:
        """df in the table's place."""
        at = self._written(name, df)
        with self.transaction():
            self._pending[name] = at

    def append(self, name: str, df: DataFrame) -> None:
        """df after the table's rows, which aren't read; a table of more than MOST_PARTS parts is written anew as one."""
        parts = _parts(self._manifest().get(name))
        if len(parts) >= MOST_PARTS:
            self.write(name, self.table(name).unionByName(df))
            return
        at = self._written(name, df)
        with self.transaction():
            self._pending[name] = [*parts, at]

    # -- content

    def get_meta(self, key: str) -> str | None:
        row = self.table("meta").where(F.col("key") == key).first()
        return row["value"] if row else None

    def set_meta(self, key: str, value: str) -> None:
        self.write("meta", upserted(self.table("meta"), self.spark.createDataFrame([(key, value)], SCHEMAS["meta"]), ["key"]))

    def add(self, docs: DataFrame, chunks: DataFrame, vectors: DataFrame, postings: DataFrame) -> None:
        """Documents with their chunks, vectors and postings, all or nothing; those of the same id are replaced. New rows are appended; tables are written again
        only where documents are replaced."""
        with self.transaction():
            self.delete_docs(docs.select("doc_id"))
            for name, rows in (("docs", docs), ("chunks", chunks), ("vectors", vectors), ("postings", postings)):
                want = [f.name for f in StructType.fromDDL(SCHEMAS[name])]
                fitting = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in want])
                self.append(name, fitting)

    def _drop_chunks(self, gone: DataFrame) -> None:
        self.write("chunks", cleared_parents(without(self.table("chunks"), gone, "chunk_id"), gone))
        for name in _OWNED:
            self.write(name, without(self.table(name), gone, "chunk_id"))

    def delete_docs(self, doc_ids: DataFrame) -> None:
        """The documents (doc_id) with all that belongs to them; a document needn't have chunks. Tables without a row of theirs stay as they are."""
        with self.transaction():
            ids = doc_ids.select("doc_id")
            if not self.table("docs").join(ids, "doc_id", "left_semi").isEmpty():
                self.write("docs", without(self.table("docs"), ids, "doc_id"))
            gone = self.table("chunks").join(ids, "doc_id", "left_semi").select("chunk_id")
            if not gone.isEmpty():
                self._drop_chunks(gone)

    def delete_chunks(self, chunk_ids: DataFrame) -> None:
        with self.transaction():
            self._drop_chunks(chunk_ids)

    def touch(self, chunk_ids: DataFrame, turn: int) -> None:
        self.write("chunks", touched(self.table("chunks"), chunk_ids, F.lit(turn)))

    def reset(self) -> None:
        """Without documents and chunks; meta stays."""
        with self.transaction():
            for name in SCHEMAS:
                if name != "meta":
                    self._pending.pop(name, None)

    def audit(self) -> DataFrame:
        """(relation, n) of rows whose counterpart is missing; all n are 0 in a sound index."""
        chunks, docs = self.table("chunks"), self.table("docs")
        parents = chunks.select(F.col("chunk_id").alias("parent_id"))
        out = orphans(chunks, docs, "doc_id", "chunk without document").unionByName(orphans(chunks, parents, "parent_id", "chunk without parent"))
        for name in _OWNED:
            out = out.unionByName(orphans(self.table(name), chunks, "chunk_id", f"{name} without chunk"))
        return out

    def stats(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in SCHEMAS}

    def vacuum(self) -> int:
        """Deletes the files of former versions; returns how many folders went."""
        live, gone = {x for at in self._manifest().values() for x in _parts(at)}, 0
        for name in SCHEMAS:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f"{name}/{s.getPath().getName()}" not in live:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone
