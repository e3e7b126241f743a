"""Keeping a corpus current: batch upserts and the same as the sink of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corvane.config import EngineConfig
from corvane.functions.providers import Embedder, Tokenizer
from corvane.operators.chunking import chunks_of
from corvane.session import cut_lineage
from corvane.sources.pages import normalized
from corvane.sources.store import Store, changes, new_links, without_documents


def upsert(store: Store, pages: DataFrame, config: EngineConfig = EngineConfig(), tokenizer: Tokenizer | None = None, embedder: Embedder | None = None) -> dict[str, int]:
    """Pages into a store: unchanged content is left alone, changed documents replace their chunks and links, all in one version.

    Only the buckets of the documents that change are read again and written.

    Gives the number of pages inserted, replaced and unchanged. An empty batch
    and one without changes write nothing.
    """
    todo = cut_lineage(changes(normalized(pages), store.read("documents")))
    counts = {r.action: r["count"] for r in todo.groupBy("action").count().collect()}
    write = todo.where("action <> 'unchanged'")
    if counts.get("insert", 0) + counts.get("replace", 0):
        gone = write.select("old_document_id")
        new = write.withColumn("indexed_at", F.current_timestamp())
        # at most as many as the store has buckets
        touched = [r.b for r in write.select(F.explode(F.array_compact(F.array(F.col("old_document_id"), F.col("document_id")))).alias("d")).select(store.bucket_of(F.col("d")).alias("b")).distinct().collect()]
        docs, chunks, links = (store.read(t, touched) for t in ("documents", "chunks", "link_candidates"))
        store.write(
            {
                "documents": without_documents(docs, gone).unionByName(new.select(*docs.columns)),
                "chunks": without_documents(chunks, gone).unionByName(chunks_of(write, config, tokenizer, embedder)),
                "link_candidates": without_documents(links, gone, "source_document_id").unionByName(new_links(write).select(*links.columns)),
            },
            touched,
        )
    return {a: counts.get(a, 0) for a in ("insert", "replace", "unchanged")}


def sink(store: Store, config: EngineConfig = EngineConfig()) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: a batch that comes again changes nothing, as unchanged content is left alone."""

    def one(batch: DataFrame, batch_id: int) -> None:
        upsert(store, batch, config)

    return one


def stream_into(store: Store, pages: DataFrame, checkpoint: str, config: EngineConfig = EngineConfig()) -> DataStreamWriter:
    """A writer that keeps a store current with a stream of pages; not started yet."""
    return pages.writeStream.foreachBatch(sink(store, config)).option("checkpointLocation", checkpoint)
