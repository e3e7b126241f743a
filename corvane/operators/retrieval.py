"""Retrieval: vector search over children, parents by their best child, token budgets, full context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import EngineConfig
from corvane.functions.text import keeps_html, token_span
from corvane.functions.vectors import depth_multiplier, search


def once(chunks: DataFrame) -> DataFrame:
    """Chunks without those delivered twice (rows of one id are equal)."""
    return chunks.dropDuplicates(["chunk_id"])


def scoped(chunks: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Chunks of some pages (source_url); without pages to choose from, of all."""
    if sources is None:
        return chunks
    return chunks.join(sources.select("source_url").where("source_url is not null").distinct(), "source_url", "left_semi").select(*chunks.columns)


def corpus_counts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row (total_documents, total_parent_chunks, parent_tokens); tokens of parents whose span is known."""
    parents = once(chunks.where("chunk_level = 'parent'")).agg(F.count("*").alias("total_parent_chunks"), F.coalesce(F.sum(F.col("token_end") - F.col("token_start")), F.lit(0)).cast("bigint").alias("parent_tokens"))
    return documents.agg(F.count("*").alias("total_documents")).crossJoin(parents)  # one row each


def mode_of(parent_tokens: Column, config: EngineConfig, budget: int | None = None, override: str | None = None) -> Column:
    """``full_context`` where all parents fit the threshold, else ``chunk``; an override wins."""
    if override:
        return F.lit(override)
    return F.when(parent_tokens <= config.threshold(config.budget(budget)), "full_context").otherwise("chunk")


def child_search(chunks: DataFrame, queries: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, chunk_id, similarity): each query's most similar children above the floor, at most ``top_k_children``, exact."""
    children = chunks.where("chunk_level = 'child'")
    hits = search(children, queries, config.top_k_children, config.similarity_floor, most_queries=config.max_queries)
    return hits.select("query_id", F.col("id").alias("chunk_id"), F.least(F.greatest("similarity", F.lit(0.0)), F.lit(1.0)).alias("similarity"))


def parent_scores(hits: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, parent_id, score, raw_similarity): for each parent its best child, lowered by depth. Children without a parent count for nothing.

    ``hits`` are at most ``max_queries`` times ``top_k_children`` ids, so they
    go to the chunks and no chunk is shuffled; one delivered twice changes no maximum.
    """
    child = chunks.where("chunk_level = 'child' and parent_id is not null").select("chunk_id", "parent_id", "depth")
    score = F.col("similarity") * depth_multiplier(F.coalesce("depth", F.lit(0)), config.depth_decay_rate, config.depth_floor)
    best = child.join(F.broadcast(hits), "chunk_id").groupBy("query_id", "parent_id").agg(F.max(F.struct(score.alias("score"), F.col("similarity").alias("raw_similarity"))).alias("b"))
    return best.select("query_id", "parent_id", "b.score", "b.raw_similarity")


def first_fit(rows: Column, budget: int, tokens: str = "tokens") -> Column:
    """The rows of a sorted array that a walk keeps: one that would overflow is left out and smaller ones are tried on; the first is always kept."""
    empty = F.filter(rows, lambda x: F.lit(False))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), empty.alias("kept"))
    fits = lambda s, x: (F.size(s["kept"]) == 0) | (s["used"] + x[tokens] <= budget)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x[tokens]).cast("bigint").alias("used"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)
    return F.aggregate(rows, start, step, lambda s: s["kept"])


def within_budget(scored: DataFrame, budget: int) -> DataFrame:
    """Rows (query_id, parent_id, score, raw_similarity, tokens) that the first-fit walk in the order of score keeps, with ``rank``.

    At most ``top_k_children`` parents a query come in, so a query is a small
    group. Equal scores: smaller id first.
    """
    row = F.struct((-F.col("score")).alias("m"), "parent_id", "raw_similarity", F.col("tokens").cast("bigint").alias("tokens"))
    kept = scored.groupBy("query_id").agg(first_fit(F.array_sort(F.collect_list(row)), budget).alias("kept"))
    out = kept.select("query_id", F.posexplode("kept").alias("rank", "r"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "r.parent_id", (-F.col("r.m")).alias("score"), "r.raw_similarity", "r.tokens")


def surfaces() -> tuple[Column, Column]:
    """(surface, selected_text): the HTML of rich chunks that have some, else the text."""
    rich = keeps_html() & (F.coalesce(F.col("html_text"), F.lit("")) != "")
    return F.when(rich, "html").otherwise("markdown").alias("surface"), F.when(rich, F.col("html_text")).otherwise(F.col("chunk_text")).alias("selected_text")


def by_source(rows: DataFrame, rank: str = "rank") -> DataFrame:
    """Adds ``source_order`` and ``position``: sources in the order of their first row, chunks of a source by index."""
    first = F.min(rank).over(Window.partitionBy("query_id", "source_url"))
    out = rows.withColumn("first", first)
    out = out.withColumn("source_order", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first")))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("source_order", "chunk_index", "chunk_id"))).drop("first")


def retrieve_chunks(chunks: DataFrame, queries: DataFrame, config: EngineConfig = EngineConfig(), budget: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Chunk mode for a batch of queries: search, parents, budget, order; one job whatever the number of queries.

    Gives (query_id, position, rank, score, raw_similarity, surface,
    selected_text and the parents' columns).
    """
    c = scoped(chunks, sources)
    scores = parent_scores(child_search(c, queries, config), c, config)
    parents = c.where("chunk_level = 'parent'")
    # scores and what is kept of them are as few as the hits: they go to the parents, and repeats are dropped after that
    sized = parents.select(F.col("chunk_id").alias("parent_id"), token_span().alias("tokens")).join(F.broadcast(scores), "parent_id").dropDuplicates(["query_id", "parent_id"])
    kept = within_budget(sized, config.budget(budget)).withColumnRenamed("parent_id", "chunk_id")
    rows = parents.join(F.broadcast(kept), "chunk_id").dropDuplicates(["query_id", "chunk_id"]).select("query_id", "rank", "score", "raw_similarity", "tokens", *surfaces(), *parents.columns)
    return by_source(rows)


def full_context(chunks: DataFrame, config: EngineConfig = EngineConfig(), budget: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """All parents by depth, page and index as far as the first-fit walk takes them: (position, tokens, surface, selected_text, parents' columns).

    Only places and token counts come to the driver, partition by partition in
    order, and no more once nothing can fit; so a corpus of any size can be
    asked for, although the mode is meant for small ones.
    """
    most = config.budget(budget)
    parents = once(scoped(chunks.where("chunk_level = 'parent'"), sources)).withColumn("tokens", token_span())
    least = parents.agg(F.min("tokens")).first()[0]
    used, kept = 0, []
    if least is not None:
        for r in parents.select("depth", "source_url", "chunk_index", "chunk_id", "tokens").orderBy("depth", "source_url", "chunk_index", "chunk_id").toLocalIterator():
            if not kept or used + r.tokens <= most:
                kept.append((r.chunk_id, len(kept) + 1))
                used += r.tokens
            if used + max(1, least) > most:
                break
    place = chunks.sparkSession.createDataFrame(kept, "chunk_id string, position int")
    return parents.join(place, "chunk_id").select("position", "tokens", F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("raw_similarity"), *surfaces(), *chunks.columns)


def citation(start: Column, end: Column) -> Column:
    """The words of a chunk between two places of its document; null where they aren't inside the chunk or hold nothing."""
    ok = (start >= F.col("char_start")) & (end <= F.col("char_end")) & (start < end) & (end - F.col("char_start") <= F.length("chunk_text"))
    text = F.substr(F.col("chunk_text"), (start - F.col("char_start") + 1).cast("int"), (end - start).cast("int"))
    return F.when(ok, F.nullif(text, F.lit("")))


def summary(rows: DataFrame) -> DataFrame:
    """(query_id, is_empty, top_score, sources) of retrieved rows; sources in the order of their first chunk."""
    first = rows.groupBy("query_id", "source_url").agg(F.min("position").alias("p"), F.max("score").alias("s"))
    return first.groupBy("query_id").agg((F.count("*") == 0).alias("is_empty"), F.max("s").alias("top_score"), F.transform(F.array_sort(F.collect_list(F.struct("p", "source_url"))), lambda x: x["source_url"]).alias("sources"))
