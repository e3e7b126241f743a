"""Which links to follow: relevance of path, title and description, in-degree, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ascii_tokens, jaccard
from corvane.sources.links import enrich, once

#: The weights of the five signals.
WEIGHTS = {"url_path": 0.15, "title": 0.40, "description": 0.30, "in_degree": 0.05, "depth": 0.10}


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")


def parent_urls(url: Column) -> Column:
    """Addresses above a page, nearest first, at least one segment deep; of the root and of pages under it none."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.concat(head, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def scored(candidates: DataFrame, queries: DataFrame, ingested: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """(query_id, candidates' columns, signals, score, rank) of every candidate for each query of a stated set.

    ``queries`` (query_id, query, key_concepts), at most a few hundred rows,
    which go to the candidates; ``degrees`` (target_url, in_degree), missing
    ones as 0. Targets in ``ingested`` (url) are left out. Equal scores: by
    target, then id.
    """
    c = candidates
    if ingested is not None:
        c = c.join(ingested.select(F.col("url").alias("target_url")).distinct(), "target_url", "left_anti")
    c = c.join(degrees, "target_url", "left") if degrees is not None else c.withColumn("in_degree", F.lit(0))
    c = c.withColumn("_path", ascii_tokens(path_of(F.col("target_url")))).withColumn("_title", ascii_tokens(F.coalesce("title", F.lit("")))).withColumn("_desc", ascii_tokens(F.coalesce("description", F.lit(""))))
    q = queries.where("query is not null").limit(1001).collect()
    if len(q) > 1000:
        raise ValueError("at most 1,000 queries in a batch")
    asked = candidates.sparkSession.createDataFrame([(r.query_id, r.query, list(r.key_concepts)) for r in q], queries.select("query_id", "query", "key_concepts").schema)
    pairs = c.crossJoin(F.broadcast(asked.withColumn("_q", ascii_tokens(F.col("query")))))
    s = pairs.select(
        "query_id", *candidates.columns,
        jaccard(F.col("_path"), F.col("key_concepts")).alias("s_url_path"), jaccard(F.col("_title"), F.col("_q")).alias("s_title"), jaccard(F.col("_desc"), F.col("_q")).alias("s_description"),
        F.least(F.lit(1.0), F.coalesce("in_degree", F.lit(0)) / 5).alias("s_in_degree"), F.greatest(F.lit(0.0), 1 - F.coalesce("depth", F.lit(0)) * F.lit(0.2).cast("double")).alias("s_depth"),
    )
    total = sum((F.col(f"s_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return s.withColumn("score", total)


def best(scores: DataFrame, n: int, least: float) -> DataFrame:
    """Each query's first ``n`` candidates by score; none of a query whose best is below ``least``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "target_url", "id")
    out = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.withColumn("_top", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("_top") >= least).drop("_top")


def first_candidates(links: DataFrame, documents: DataFrame, ingested: DataFrame, n: int, found: DataFrame | None = None) -> DataFrame:
    """The first ``n`` links of the documents at some addresses: (place, id, target_url, title, description, depth).

    ``ingested`` (url): what one run has taken in, a few hundred at most, so
    it goes to the links. ``found``: a map of those documents' pages (as for
    :func:`corvane.sources.links.enrich`), which gives titles and new links.
    Addresses that are ingested themselves are left out; of one target the
    first discovered stands (equal times: the smaller id).
    """
    url = F.broadcast(ingested.select(F.col("url")).where("url is not null").distinct())
    own = documents.join(url.withColumnRenamed("url", "source_url"), "source_url", "left_semi")
    few = links.join(F.broadcast(own.select(F.col("document_id").alias("source_document_id")).distinct()), "source_document_id", "left_semi")
    few = once(few).select(*links.columns) if found is None else enrich(few, found, own).drop("touched")
    few = few.join(url.withColumnRenamed("url", "target_url"), "target_url", "left_anti").where("target_url is not null")
    one = few.groupBy("target_url").agg(F.min_by(F.struct("id", "title", "description", "depth", "discovered_at"), F.struct("discovered_at", "id")).alias("r")).select("target_url", "r.*")
    place = Window.orderBy("discovered_at", "target_url")
    return one.orderBy("discovered_at", "target_url").limit(n).select(F.row_number().over(place).alias("place"), "id", "target_url", "title", "description", "depth")


def selected(links: DataFrame, documents: DataFrame, seed: str, new_depth: int, query: str, concepts: list[str], ingested: list[str], to_score: int, n: int, least: float, found: DataFrame | None = None) -> list[str]:
    """Targets to fetch next for one query, best first.

    The links of the documents taken in so far come in the order they were
    discovered, enriched by a map of their pages; then the seed's parent
    addresses; of one target the first; only the first ``to_score`` are scored.
    In-degree is taken after that, so it is that of one source.
    """
    spark = links.sparkSession
    done = spark.createDataFrame([(u,) for u in ingested], "url string")
    rows = [tuple(r)[1:] for r in first_candidates(links, documents, done, to_score, found).orderBy("place").collect()]
    above = spark.range(1).select(parent_urls(F.lit(seed)).alias("p")).first()[0]
    known = {r[1] for r in rows} | set(ingested)
    rows += [(f"parent:{u}", u, None, None, new_depth) for u in above if u not in known]
    if not rows:
        return []
    held = spark.createDataFrame(rows[:to_score], "id string, target_url string, title string, description string, depth int")
    ask = spark.createDataFrame([(0, query, concepts)], "query_id int, query string, key_concepts array<string>")
    degree = held.select("target_url", F.lit(1).alias("in_degree"))
    return [r.target_url for r in best(scored(held, ask, degrees=degree), n, least).orderBy("rank").collect()]
