"""Neighbours of hits, union of sub-queries, near-duplicates, the final budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import space_tokens


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1, least: float = 0.3) -> DataFrame:
    """Parents next to hits: (query_id, chunk_id, document_id, chunk_index, score 0, is_locality_expanded, surface, selected_text, …).

    ``hits`` (query_id, chunk_id, document_id, chunk_index, score): those of at
    least ``least`` have neighbours up to ``radius`` places away in their
    document; hits themselves aren't neighbours. The places are listed and
    joined by equality, not by a range; they are few (the hits of a batch of
    queries times the radius), so they go to the parents.
    """
    near = hits.where(F.col("score") >= least).select("query_id", "document_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - radius), F.col("chunk_index") + radius)).alias("chunk_index")).distinct()
    parents = chunks.where("chunk_level = 'parent'")
    html = F.coalesce(F.col("html_text"), F.lit("")) != ""
    rows = parents.join(F.broadcast(near), ["document_id", "chunk_index"]).dropDuplicates(["query_id", "chunk_id"]).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return rows.select(
        "query_id", "chunk_id", "document_id", "chunk_index", F.lit(0.0).alias("score"), F.lit(True).alias("is_locality_expanded"),
        F.when(html, "html").otherwise("markdown").alias("surface"), F.when(html, F.col("html_text")).otherwise(F.col("chunk_text")).alias("selected_text"),
        "chunk_text", "section_heading", "source_url", "title", "depth", "char_start", "char_end", "token_start", "token_end",
    )


def union_by_chunk(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Of rows with one chunk the best (equal scores: the first), at the place of the first: (key, ord, and the rows' columns)."""
    cols = [c for c in rows.columns if c not in (key, "ord")]
    best = rows.groupBy(key, "chunk_id").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*cols), F.struct(F.col("score"), -F.col("ord"))).alias("r"))
    return best.select(key, "ord", "r.*")


def without_near_duplicates(rows: DataFrame, ceiling: float = 0.85, key: str = "query_id", text: str = "selected_text") -> DataFrame:
    """Rows in their order (``ord``) without those whose words agree with a kept row's to more than ``ceiling``; 1 or more keeps all.

    A key's rows are the results of one query (at most a few hundred), so the
    walk runs over one small group. Rows without words agree with none.
    """
    if ceiling >= 1:
        return rows

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ord", "chunk_id"])
        kept: list[set[str]] = []
        keep = []
        for words in part["words"]:
            w = set(words)
            clash = any(len(s := w & k) > ceiling * (len(w) + len(k) - len(s)) for k in kept if len(w) >= ceiling * len(k) and len(k) >= ceiling * len(w)) if w else False
            keep.append(not clash)
            if w and not clash:
                kept.append(w)
        return part.loc[keep, [key, "chunk_id", "ord"]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, "chunk_id", "ord"))
    given = rows.select(key, "chunk_id", "ord", space_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    ids = given.groupBy(key).applyInPandas(walk, kinds)
    return rows.join(ids, [key, "chunk_id", "ord"], "left_semi").select(*rows.columns)


def prefix_budget(rows: DataFrame, budget: int, key: str = "query_id", score: str = "score") -> DataFrame:
    """Rows by score up to the first that overflows; the best row always; 0 or less is no limit. Adds ``rank``; equal scores in their order."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "ord")
    out = rows.withColumn("rank", F.row_number().over(w)).withColumn("_used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = F.lit(True) if budget <= 0 else (F.col("_used") <= budget) | (F.col("rank") == 1)
    return out.where(keep).drop("_used")


def merged(rows: DataFrame, ceiling: float, budget: int, key: str = "query_id") -> DataFrame:
    """Union, near-duplicates out in the order of arrival, then the budget by score."""
    return prefix_budget(without_near_duplicates(union_by_chunk(rows, key), ceiling, key), budget, key)
