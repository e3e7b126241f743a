"""Fetched pages: matching, normalising, batches in the order of the request.

A page source is a table of pages or anything that gives one; the default
reads the delivery log.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.urls import page_of


class PageSource(Protocol):
    def pages(self, spark: SparkSession) -> DataFrame:
        """Rows (url, source_url, title, description, language, status_code, published_time, modified_time, markdown, html, links, fetched_at)."""


class TablePages:
    """Pages from a Parquet table; of several fetches of a page the newest."""

    def __init__(self, path: str) -> None:
        self.path = path

    def pages(self, spark: SparkSession) -> DataFrame:
        return newest_fetch(spark.read.parquet(self.path))


def newest_fetch(fetches: DataFrame) -> DataFrame:
    """One row a page (``source_url``, or ``url`` where missing): the newest fetch; equal times: the larger ``fetch_id``."""
    row = F.struct(*fetches.columns)
    order = F.struct(F.col("fetched_at"), F.col("fetch_id")) if "fetch_id" in fetches.columns else F.struct(F.col("fetched_at"), F.col("url"))
    return fetches.withColumn("page", page_of()).where("page is not null").groupBy("page").agg(F.max_by(row, order).alias("r")).select("r.*")


def match_key(url: Column) -> Column:
    """A URL without query, fragment and parameters; a slash at the end doesn't count, the root keeps it. Scheme and host as written; null for null."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)?", 1)
    path = F.regexp_replace(F.regexp_replace(F.substr(bare, F.length(head) + 1), r";[^/]*$", ""), r"/+$", "")
    return F.concat(head, F.when(path == "", "/").otherwise(path))


def doc_type(content_type: Column, pages: Column, source_url: Column, url: Column) -> Column:
    """``pdf`` by content type, then by a number of pages, then by the path's suffix; ``html`` otherwise."""
    path = lambda u: F.lower(F.regexp_replace(F.coalesce(u, F.lit("")), r"[?#].*$", ""))
    by = F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf") | (F.coalesce(pages, F.lit(0)) > 0) | path(source_url).endswith(".pdf") | path(url).endswith(".pdf")
    return F.when(by, "pdf").otherwise("html")


def clean_links(links: Column) -> Column:
    """Links without fragments, empty ones and repeats, in their order; null as empty."""
    bare = F.transform(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "#.*$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x.isNotNull() & (x != "")))


def content_hash(markdown: Column) -> Column:
    """SHA-256 of the text; empty for null and empty texts."""
    return F.when(F.length(F.coalesce(markdown, F.lit(""))) > 0, F.sha2(markdown, 256)).otherwise(F.lit(""))


def normalized(pages: DataFrame) -> DataFrame:
    """Pages with cleaned links, their type and the hash of their content; missing columns are null, extra ones stay."""
    has = lambda c, kind: F.col(c) if c in pages.columns else F.lit(None).cast(kind)
    out = pages
    for c in ("source_url", "title", "description", "language", "published_time", "modified_time", "html"):
        out = out.withColumn(c, has(c, "string"))
    return (
        out.withColumn("status_code", has("status_code", "int"))
        .withColumn("links", clean_links(has("links", "array<string>")))
        .withColumn("content_hash", content_hash(F.col("markdown")))
        .withColumn("doc_type", doc_type(has("content_type", "string"), has("num_pages", "int"), has("source_url", "string"), F.col("url")))
    )


def ingest(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of a batch in the order of the request: (position, requested_url, and the page's columns, null where it failed).

    ``requested`` (position, requested_url). Pages match by :func:`match_key`;
    several requests of one key take its pages in turn, by url and time. Pages
    of no request are left out; :func:`fill_unmatched` puts them into the failed
    places, as a service that redirects gives pages under other addresses.
    """
    in_key = Window.partitionBy("match_key")
    r = requested.withColumn("match_key", match_key(F.col("requested_url"))).withColumn("turn", F.row_number().over(in_key.orderBy("position")))
    p = pages.withColumn("match_key", match_key(page_of())).withColumn("turn", F.row_number().over(in_key.orderBy("url", "fetched_at")))
    return r.join(p, ["match_key", "turn"], "left").drop("match_key", "turn")


def fill_unmatched(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """(position, requested_url, url): what :func:`ingest` matches, then leftover pages to leftover places, both in order.

    Places and leftovers are numbered over the batch, so a batch is meant to
    be one request of a service (thousands of URLs), not a corpus.
    """
    got = ingest(requested, pages.select("url", "source_url", "fetched_at"))
    over = Window.orderBy("position")
    empty = got.where("url is null").select("position", "requested_url").withColumn("n", F.row_number().over(over))
    taken = got.where("url is not null").select("url")
    left = pages.select("url").join(taken, "url", "left_anti").distinct().withColumn("n", F.row_number().over(Window.orderBy("url")))
    return got.where("url is not null").select("position", "requested_url", "url").unionByName(empty.join(left, "n", "left").select("position", "requested_url", "url"))


def discover_links(page: str, links: DataFrame, exclude: DataFrame, limit: int = 500) -> DataFrame:
    """(url, title, description): targets of one page that aren't excluded, each once, by url; at most ``limit`` as asked."""
    mine = links.where((F.col("source_url") == page) & F.col("target_url").isNotNull())
    one = mine.groupBy("target_url").agg(F.min(F.struct("discovered_at", "title", "description")).alias("r"))
    return one.join(exclude.select(F.col("url").alias("target_url")), "target_url", "left_anti").select(F.col("target_url").alias("url"), "r.title", "r.description").orderBy("url").limit(limit)


def site_map(pages: DataFrame, links: DataFrame, at: Column, limit: int = 100) -> DataFrame:
    """A map of documents' pages from a table of pages: (source_document_id, target_url, title, description, at), at most ``limit`` a document, by address."""
    known = newest_fetch(pages).select(page_of().alias("target_url"), "title", "description").where("target_url is not null and (title is not null or description is not null)").dropDuplicates(["target_url"])
    of = links.select("source_document_id", "target_url").distinct().join(known, "target_url")
    order = Window.partitionBy("source_document_id").orderBy("target_url")
    return of.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select("source_document_id", "target_url", "title", "description", at.alias("at"))


def payload_items(payload: object, limit: int | None = None) -> list[object]:
    """The items of a page source's answer: a list, a mapping or an object with ``data`` or ``links``; anything else is an error. Items that are null are left out."""
    found = payload
    for name in ("data", "links"):
        if isinstance(payload, dict) and payload.get(name) is not None:
            found = payload[name]
            break
        if not isinstance(payload, (dict, list, tuple, str, bytes)) and getattr(payload, name, None) is not None:
            found = getattr(payload, name)
            break
    if not isinstance(found, (list, tuple)):
        raise ValueError(f"a page source gave {type(payload).__name__}, which holds no items")
    return [x for x in found if x is not None][:limit]
