"""The corpus store: documents, chunks and links in buckets of Parquet files.

A table is cut into buckets by document. A write makes new files for the
buckets it touches only, then a manifest that names the files of every bucket,
and last a pointer with the next number; readers take the manifest of the
largest number, so they see all of a write or nothing, and at no time nothing
at all. A document's id hangs on its URL and content, a chunk's on its document
and place, so a write that is repeated changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions.urls import page_of

BUCKETS = 64


class Store:
    """Tables under one folder that driver and executors share (any file system Spark can write)."""

    tables = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "link_candidates": schemas.LINKS}
    #: The column with a row's document, which names its bucket.
    owner = {"documents": "document_id", "chunks": "document_id", "link_candidates": "source_document_id"}

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> str | None:
        """The name of the newest pointer: a number of 12 digits and a manifest."""
        fs, path = self._fs()
        folder = path(f"{self.root}/pointers")
        if not fs.exists(folder):
            return None
        return max((f.getPath().getName() for f in fs.listStatus(folder) if not f.getPath().getName().startswith((".", "_"))), default=None)

    def _manifest(self, version: str | None) -> dict:
        if version is None:
            return {"buckets": self.buckets, "files": {t: {} for t in self.tables}}
        name = version.split(".", 1)[1]
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{name}", wholetext=True).first()[0])

    def bucket_of(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self._manifest(self.version())["buckets"])).cast("int")

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or some of its buckets, as of the newest write."""
        files = self._manifest(self.version())["files"][name]
        keep = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.root}/data/{v}/{name}/bucket={b}" for b, vs in sorted(files.items()) for v in vs if keep is None or b in keep]
        if not paths:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(*paths)

    def write(self, frames: dict[str, DataFrame], buckets: Iterable[int] | None = None, append: Iterable[str] = ()) -> str:
        """Replaces tables, or these buckets of them, by the rows given; the pointer moves last. Tables that aren't given stay as they are; those in ``append`` keep their rows."""
        before = self.version()
        manifest = self._manifest(before)
        n = manifest["buckets"]
        v = f"v-{uuid.uuid4().hex[:12]}"
        fs, path = self._fs()
        for name, df in frames.items():
            rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.tables[name]))
            rows = rows.withColumn("bucket", F.pmod(F.xxhash64(self.owner[name]), F.lit(n)).cast("int"))
            order = ["bucket", "chunk_level"] if name == "chunks" else ["bucket"]
            rows.repartition("bucket").sortWithinPartitions(*order).write.mode("error").partitionBy("bucket").parquet(f"{self.root}/data/{v}/{name}")
            out = path(f"{self.root}/data/{v}/{name}")
            new = {f.getPath().getName().split("=", 1)[1]: [v] for f in fs.listStatus(out) if f.getPath().getName().startswith("bucket=")}
            old = manifest["files"][name]
            if name in append:
                manifest["files"][name] = {b: old.get(b, []) + new.get(b, []) for b in {*old, *new}}
            else:
                gone = set(old) if buckets is None else {str(b) for b in buckets}
                manifest["files"][name] = {b: x for b, x in old.items() if b not in gone} | new
        self._put(f"manifests/{v}", json.dumps(manifest))
        number = 1 + (int(before.split(".", 1)[0]) if before else 0)
        self._put(f"pointers/.{v}", v)
        # a rename fails where another writer has taken the number, so none overwrites what it hasn't read
        if any(f.getPath().getName().startswith(f"{number:012d}.") for f in fs.listStatus(path(f"{self.root}/pointers"))) or not fs.rename(path(f"{self.root}/pointers/.{v}"), path(f"{self.root}/pointers/{number:012d}.{v}")):
            raise OSError("the pointer couldn't be moved")
        return v

    def _put(self, name: str, text: str) -> None:
        fs, path = self._fs()
        out = fs.create(path(f"{self.root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()


def prepared(pages: DataFrame) -> DataFrame:
    """Pages as documents: canonical ``source_url``, id from URL and content; a page that comes twice counts by its newest fetch."""
    p = pages.withColumn("source_url", page_of()).where("source_url is not null")
    p = p.groupBy("source_url").agg(F.max_by(F.struct(*(c for c in p.columns if c != "source_url")), F.struct("fetched_at", "content_hash", "url")).alias("r")).select("source_url", "r.*")
    if "depth" not in p.columns:
        p = p.withColumn("depth", F.lit(0))
    return p.withColumn("document_id", F.sha2(F.concat_ws("|", "source_url", "content_hash"), 256))


def changes(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(pages' columns, action, old_document_id): ``insert``, ``replace`` or ``unchanged`` by the hash of the content."""
    new = prepared(pages)
    old = documents.select("source_url", F.col("document_id").alias("old_document_id"), F.col("content_hash").alias("old_hash"))
    action = F.when(F.col("old_document_id").isNull(), "insert").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("replace")
    return new.join(old, "source_url", "left").withColumn("action", action).drop("old_hash")


def without_documents(table: DataFrame, gone: DataFrame, column: str = "document_id") -> DataFrame:
    """A table without the rows of some documents: the cascade of a delete."""
    return table.join(gone.select(F.col("old_document_id").alias(column)).where(F.col(column).isNotNull()).distinct(), column, "left_anti").select(*table.columns)


def new_links(docs: DataFrame) -> DataFrame:
    """Links of documents, one for each target, not enriched yet."""
    one = docs.select(F.col("document_id").alias("source_document_id"), "source_url", F.explode(F.array_distinct("links")).alias("target_url"), F.col("fetched_at").alias("discovered_at"), "depth")
    return one.select(
        F.sha2(F.concat_ws("|", "source_document_id", "target_url"), 256).alias("id"), "source_document_id", "source_url", "target_url",
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), "discovered_at", F.lit(None).cast("timestamp").alias("enriched_at"), "depth",
    )


def missing_urls(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested urls (url) that the corpus hasn't under their canonical address (no fragment)."""
    r = requested.select(F.regexp_replace("url", "#.*$", "").alias("source_url")).where("source_url <> ''").distinct()
    return r.join(documents.select("source_url"), "source_url", "left_anti").withColumnRenamed("source_url", "url")


def document_ids(urls: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, source_url) of documents at some urls (url)."""
    return documents.join(urls.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_semi").select("document_id", "source_url")
