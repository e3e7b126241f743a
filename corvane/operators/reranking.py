"""Reranking: what goes in, the pass-through order, and providers in Arrow batches."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import EngineConfig
from corvane.functions.providers import Reranker
from corvane.functions.text import without_markup


def passage() -> Column:
    """A chunk's text for reranking: without markup, with its images' context after it."""
    context = F.coalesce("image_context_text", F.lit(""))
    return F.when(context != "", F.concat(without_markup(F.col("selected_text")), F.lit("\n\n[Image context]\n"), "image_context_text")).otherwise(without_markup(F.col("selected_text")))


def passing(rows: DataFrame, floor: float, similarity: str = "raw_similarity") -> DataFrame:
    """Rows whose similarity is unknown or at least ``floor``; of a query without any, its best row (equal scores: smaller id)."""
    ok = F.col(similarity).isNull() | (F.col(similarity) >= floor)
    w = Window.partitionBy("query_id")
    out = rows.withColumn("_any", F.max(ok.cast("int")).over(w)).withColumn("_best", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")))
    return out.where(ok | ((F.col("_any") == 0) & (F.col("_best") == 1))).drop("_any", "_best")


def top_by_score(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each query by score; equal scores: smaller id."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("_r") <= n).drop("_r")


def pass_through(rows: DataFrame, n: int, index: str = "position") -> DataFrame:
    """(…, reranked_score, confidence, reranked_rank): the given scores, or falling by place where there are none; no confidence."""
    count = F.count("*").over(Window.partitionBy("query_id"))
    out = rows.withColumn("reranked_score", F.coalesce(F.col("score"), 1 - (F.col(index) - 1) / count)).withColumn("confidence", F.lit(None).cast("double"))
    out = out.withColumn("reranked_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranked_score"), index)))
    return out.where(F.col("reranked_rank") <= n)


def rerank(rows: DataFrame, provider: Reranker | None, config: EngineConfig = EngineConfig(), query: str = "query") -> DataFrame:
    """Rows (query_id, query, chunk_id, score, position, selected_text, image_context_text, …) in the order a provider gives them.

    Without a provider, and for a query at which it fails, the pass-through
    order holds. A query's rows (at most ``rerank_top_n``) are one group.
    """
    few = top_by_score(rows, config.rerank_top_n)
    if provider is None:
        return pass_through(few, config.rerank_top_n)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        try:
            got = provider.rerank(part["query"].iloc[0], part["passage"].tolist())
        except Exception as e:  # a provider that fails must not fail the answer
            warnings.warn(f"the reranker failed, its place keeps the given order: {e!r}", stacklevel=1)
            got = [(i, s, None) for i, s in enumerate(part["score"])]
        return pd.DataFrame([(part["query_id"].iloc[i], part["chunk_id"].iloc[i], float(s), c) for i, s, c in got], columns=["query_id", "chunk_id", "reranked_score", "confidence"])

    kind = rows.schema["query_id"].dataType.simpleString()
    given = few.select("query_id", F.col(query).alias("query"), "chunk_id", "position", "score", passage().alias("passage"))
    scores = given.groupBy("query_id").applyInPandas(one, f"query_id {kind}, chunk_id string, reranked_score double, confidence double")
    out = few.join(scores, ["query_id", "chunk_id"])
    return out.withColumn("reranked_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranked_score"), "position")))
