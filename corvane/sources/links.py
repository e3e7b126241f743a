"""The page graph: link candidates and what enriches them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(links: DataFrame) -> DataFrame:
    """One row for each (source document, target): the enriched one, then the first discovered; rows delivered twice count once."""
    order = F.struct(F.col("enriched_at").isNull(), F.col("discovered_at"), F.col("id"))
    return links.groupBy("source_document_id", "target_url").agg(F.min_by(F.struct(*links.columns), order).alias("r")).select("r.*")


def enrich(links: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """The links after a map of some documents' pages: (links' columns, touched).

    ``found`` (source_document_id, target_url, title, description, at). A
    document with any enriched link is left as it is. Of the others, a link
    that isn't enriched takes the found title and description where given, and
    the time; a target without a link becomes one, with the document's depth.
    Found rows without target are skipped, repeats count once; found documents
    that aren't known give no links.
    """
    base = once(links)
    done = base.where("enriched_at is not null").select("source_document_id").distinct()
    f = found.where("target_url is not null and source_document_id is not null").groupBy("source_document_id", "target_url").agg(F.min(F.struct("title", "description", "at")).alias("f"))
    f = f.join(done, "source_document_id", "left_anti")
    doc = documents.select(F.col("document_id").alias("source_document_id"), F.col("source_url").alias("doc_url"), F.col("depth").alias("doc_depth"))
    f = f.join(doc, "source_document_id")
    b = base.select("source_document_id", "target_url", F.struct(*base.columns).alias("b"))
    both = b.join(f, ["source_document_id", "target_url"], "full")
    new = F.col("f").isNotNull()
    return both.select(
        F.coalesce("b.id", F.sha2(F.concat_ws("|", "source_document_id", "target_url"), 256)).alias("id"),
        "source_document_id",
        F.coalesce("b.source_url", "doc_url").alias("source_url"),
        "target_url",
        F.coalesce("f.title", "b.title").alias("title"),
        F.coalesce("f.description", "b.description").alias("description"),
        F.coalesce("b.discovered_at", "f.at").alias("discovered_at"),
        F.when(new, F.col("f.at")).otherwise(F.col("b.enriched_at")).alias("enriched_at"),
        F.coalesce("b.depth", "doc_depth").alias("depth"),
        new.alias("touched"),
    )


def candidates(links: DataFrame, documents: DataFrame | None = None, exclude: DataFrame | None = None, enriched_only: bool = False) -> DataFrame:
    """Links of some documents whose targets aren't excluded, oldest first; equal times by target and id."""
    out = links
    if documents is not None:
        out = out.join(documents.select(F.col("document_id").alias("source_document_id")).distinct(), "source_document_id", "left_semi")
    if enriched_only:
        out = out.where("enriched_at is not null")
    if exclude is not None:
        out = out.join(exclude.select(F.col("url").alias("target_url")), "target_url", "left_anti")
    return out.select(*links.columns).orderBy("discovered_at", "target_url", "id")


def in_degree(links: DataFrame) -> DataFrame:
    """(target_url, in_degree): how many documents link to a target."""
    return links.where("target_url is not null").groupBy("target_url").agg(F.countDistinct("source_document_id").alias("in_degree"))
