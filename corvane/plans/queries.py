"""The queries of the engine's own operators and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.config import EngineConfig
from corvane.functions import brief as briefs
from corvane.functions import html_text, text, urls
from corvane.functions.vectors import cosine, depth_multiplier
from corvane.operators import analysis, chunking, evaluation, expansion, merging, reranking, retrieval
from corvane.plans.engine import Corpus, Engine, status
from corvane.session import table
from corvane.sources import links as link_ops
from corvane.sources import pages, store

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = EngineConfig()
#: Queries in words, for operators that need a stated set.
ASKED = ("how to configure a parser", "gradient boosting vs random forests", "pros and cons of shared caches", "what is a tokenizer", "compress and merge tables for archives", "how does a cache work and when should it be flushed")


def _asked(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(ASKED, 1)), "query_id int, query string")
    return analysis.analyze(rows).select("query_id", "query", "key_concepts")


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    """The stated set of queries: every fiftieth vector of ``embeddings``."""
    return table(spark, root, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# sources


def s2_ingest_batch(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "normalized_documents")
    asked = log.select(F.col("fetch_id").alias("position"), F.col("url").alias("requested_url"))
    return pages.ingest(asked, pages.newest_fetch(log).drop("fetch_id")).select("position", "requested_url", "url", "content_hash")


def s4_match_key(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "normalized_documents").select("fetch_id", pages.match_key(F.col("url")).alias("match_key"))


def s6_doc_type(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "normalized_documents").select("fetch_id", pages.doc_type(F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("source_url"), F.col("url")).alias("found_type"))


def s7_links(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "normalized_documents").select("fetch_id", pages.clean_links(F.col("links")).alias("clean_links"))


def s8_normalized(spark: SparkSession, root: str) -> DataFrame:
    return pages.normalized(table(spark, root, "normalized_documents")).select("fetch_id", urls.page_of().alias("page"), "content_hash", F.size("links").alias("n_links"))


def s9_discover(spark: SparkSession, root: str) -> DataFrame:
    """Links of the page with the least address that aren't in the corpus."""
    links, docs = table(spark, root, "link_candidates"), table(spark, root, "indexed_documents")
    page = links.agg(F.min("source_url")).first()[0]
    return pages.discover_links(page, links, docs.select(F.col("source_url").alias("url")))


def s10_enrich(spark: SparkSession, root: str) -> DataFrame:
    """A map of the pages at depth 0: every link of theirs has the last part of its address as title."""
    links, docs = table(spark, root, "link_candidates"), table(spark, root, "indexed_documents")
    last = F.regexp_extract("target_url", "([^/]+)/?$", 1)
    mapped = links.join(docs.where("depth = 0").select(F.col("document_id").alias("source_document_id")), "source_document_id", "left_semi")
    found = mapped.select("source_document_id", "target_url", last.alias("title"), F.concat(F.lit("On "), "source_url").alias("description"), F.col("discovered_at").alias("at"))
    return link_ops.enrich(links, found, docs).select("source_document_id", "target_url", "title", "description", "touched")


def s11_candidates(spark: SparkSession, root: str) -> DataFrame:
    links, docs = table(spark, root, "link_candidates"), table(spark, root, "indexed_documents")
    return link_ops.candidates(link_ops.once(links), docs, docs.select(F.col("source_url").alias("url"))).select("id", "target_url", F.unix_micros("discovered_at").alias("discovered_us"))


def s16_upsert_actions(spark: SparkSession, root: str) -> DataFrame:
    log, docs = table(spark, root, "normalized_documents"), table(spark, root, "indexed_documents")
    return store.changes(log, docs).select("source_url", "content_hash", "action")


def s15_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that stay when the documents that changed are replaced."""
    log, docs = table(spark, root, "normalized_documents"), table(spark, root, "indexed_documents")
    gone = store.changes(log, docs).where("action = 'replace'")
    return store.without_documents(table(spark, root, "chunks"), gone).groupBy("chunk_level").agg(F.count("*").alias("rows"), F.countDistinct("document_id").alias("documents"))


def s18_document_ids(spark: SparkSession, root: str) -> DataFrame:
    links, docs = table(spark, root, "link_candidates"), table(spark, root, "indexed_documents")
    return store.document_ids(links.select(F.col("source_url").alias("url")), docs)


def s19_missing_urls(spark: SparkSession, root: str) -> DataFrame:
    links, docs = table(spark, root, "link_candidates"), table(spark, root, "indexed_documents")
    return store.missing_urls(links.select(F.col("target_url").alias("url")), docs)


# chunking


def c9_chunks(spark: SparkSession, root: str) -> DataFrame:
    docs = store.prepared(pages.normalized(table(spark, root, "normalized_documents")))
    return chunking.chunks_of(docs, CONFIG)


def c9_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the chunks of every page, counted over all of them."""
    docs = store.prepared(pages.normalized(table(spark, root, "normalized_documents"))).where("markdown is not null and trim(markdown) <> ''")
    c = chunking.chunks_of(docs, CONFIG).select("chunk_id", "document_id", "parent_id", "chunk_level", "chunk_index", "chunk_text", "char_start", "char_end", "token_start", "token_end", F.size("embedding").alias("dims"), F.array(*schemas.FLAGS, "has_image").alias("flags"))
    parent = c.where("chunk_level = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("char_start").alias("ps"), F.col("char_end").alias("pe"), F.col("token_start").alias("ts"), F.col("token_end").alias("te"), F.col("flags").alias("pf"))
    child = c.where("chunk_level = 'child'").join(parent, "parent_id", "left")
    text = docs.select("document_id", "markdown")
    bad = lambda cond: F.count_if(~F.coalesce(cond, F.lit(False)))
    inside = child.join(text, "document_id").agg(
        bad((F.col("ps") <= F.col("char_start")) & (F.col("char_end") <= F.col("pe")) & (F.col("ts") <= F.col("token_start")) & (F.col("token_end") <= F.col("te"))).alias("outside_parent"),
        bad((F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("markdown"))).alias("outside_page"),
        bad(F.col("dims") == CONFIG.embedding_dims).alias("without_vector"),
        bad(F.substr("markdown", F.col("char_start") + 1, F.length("chunk_text")).contains(F.substring_index("chunk_text", "\n", 1))).alias("not_verbatim"),
    )
    own = child.groupBy("parent_id").agg(F.array(*(F.max(F.col("flags")[i]) for i in range(7))).alias("any"), F.first("pf").alias("pf")).agg(bad(F.col("any") == F.col("pf")).alias("flags_differ"))
    whole = c.agg(F.countDistinct("document_id").alias("pages"), (F.count("*") - F.countDistinct("chunk_id")).alias("repeated_ids"))
    return whole.crossJoin(inside).crossJoin(own)  # one row each


def c14_markdown_flags(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks").select("chunk_id", "chunk_text").distinct()
    f = chunking.facts(c, "chunk_id", "chunk_text")
    return f.select("chunk_id", *(F.col("flags")[i].alias(n) for i, n in enumerate(schemas.FLAGS)))


def c20_overlap(spark: SparkSession, root: str) -> DataFrame:
    """How many content words a child shares with its parent."""
    c = retrieval.once(table(spark, root, "chunks").select("chunk_id", "parent_id", "chunk_text"))
    f = chunking.facts(c, "chunk_id", "chunk_text").select("chunk_id", "words")
    p = f.select(F.col("chunk_id").alias("parent_id"), F.col("words").alias("pw"))
    child = c.where("parent_id is not null").select("chunk_id", "parent_id").join(f.withColumnRenamed("words", "cw"), "chunk_id")
    return child.join(p, "parent_id").select("chunk_id", F.size(F.array_intersect("cw", "pw")).alias("shared"))


def c24_markdown_images(spark: SparkSession, root: str) -> DataFrame:
    return chunking.facts(table(spark, root, "normalized_documents"), "fetch_id", "markdown").select("fetch_id", "images", "context")


def e3_embedding_text(spark: SparkSession, root: str) -> DataFrame:
    c = retrieval.once(table(spark, root, "chunks").where("chunk_level = 'child'"))
    return chunking.facts(c, "chunk_id", "chunk_text", "image_context_text").select("chunk_id", "embedding_text")


# retrieval


def r4_corpus(spark: SparkSession, root: str) -> DataFrame:
    n = retrieval.corpus_counts(table(spark, root, "chunks"), table(spark, root, "indexed_documents"))
    return n.withColumn("mode", retrieval.mode_of(F.col("parent_tokens"), CONFIG))


def r5_depth_multiplier(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select("depth").distinct().select("depth", F.round(depth_multiplier(F.col("depth"), 0.05, 0.80), 9).alias("multiplier"))


def r6_child_search(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(retrieval.child_search(table(spark, root, "chunks"), _vectors(spark, root)), "similarity")


def r6_label_cosine(spark: SparkSession, root: str) -> DataFrame:
    """The cosine in the JVM: of every vector to the mean vector of its label."""
    e = table(spark, root, "embeddings")
    mean = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))
    return e.join(mean, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("similarity"))


def r7_parent_scores(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks")
    return _rounded(retrieval.parent_scores(retrieval.child_search(c, _vectors(spark, root)), c), "score", "raw_similarity")


def _scored_parents(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks")
    s = _rounded(retrieval.parent_scores(retrieval.child_search(c, _vectors(spark, root)), c), "score", "raw_similarity")
    p = retrieval.once(c.where("chunk_level = 'parent'")).select(F.col("chunk_id").alias("parent_id"), "document_id", "chunk_index", "source_url", "section_heading", "title", "chunk_text", (F.col("token_end") - F.col("token_start")).alias("tokens"))
    return s.join(p, "parent_id")


def r9_first_fit(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.within_budget(_scored_parents(spark, root), 2000).select("query_id", "rank", "parent_id", "tokens")


def r10_chunk_retrieval(spark: SparkSession, root: str) -> DataFrame:
    rows = retrieval.retrieve_chunks(table(spark, root, "chunks"), _vectors(spark, root))
    return _rounded(rows.select("query_id", "position", "chunk_id", "score", "raw_similarity", "surface", "source_url", "chunk_index", "tokens"), "score", "raw_similarity")


def r12_full_context(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.full_context(table(spark, root, "chunks")).select("position", "chunk_id", "source_url", "chunk_index", "tokens", "surface")


def r14_surfaces(spark: SparkSession, root: str) -> DataFrame:
    c = retrieval.once(table(spark, root, "chunks"))
    return c.select("chunk_id", *retrieval.surfaces()).select("chunk_id", "surface", F.length("selected_text").alias("length"))


def r17_summary(spark: SparkSession, root: str) -> DataFrame:
    rows = retrieval.retrieve_chunks(table(spark, root, "chunks"), _vectors(spark, root))
    return _rounded(retrieval.summary(rows), "top_score")


def r18_citations(spark: SparkSession, root: str) -> DataFrame:
    """Of every child, the words of its parent at the child's place."""
    c = retrieval.once(table(spark, root, "chunks").select("chunk_id", "parent_id", "chunk_text", "char_start", "char_end"))
    child = c.where("parent_id is not null").select(F.col("chunk_id").alias("child_id"), F.col("parent_id").alias("chunk_id"), F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    return child.join(c, "chunk_id").select("child_id", retrieval.citation(F.col("s"), F.col("e")).alias("verbatim_text"))


# analysis and reranking


def q4_analysis(spark: SparkSession, root: str) -> DataFrame:
    return analysis.analyze(table(spark, root, "documents").select("doc_id", "title"), "title").select("doc_id", "sub_queries", "query_type", "complexity")


def q6_key_concepts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.key_concepts(F.col("title")).alias("key_concepts"))


def q7_constraints(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(ASKED, 1)), "query_id int, query string")
    return analysis.analyze(rows, constraints=["python", "2024"]).select("query_id", "sub_queries", "query_type", "complexity")


def k2_passages(spark: SparkSession, root: str) -> DataFrame:
    c = retrieval.once(table(spark, root, "chunks").select("chunk_id", "html_text").where("html_text is not null"))
    return c.select("chunk_id", text.without_markup(F.col("html_text")).alias("passage"))


def k4_pass_through(spark: SparkSession, root: str) -> DataFrame:
    rows = retrieval.retrieve_chunks(table(spark, root, "chunks"), _vectors(spark, root))
    out = reranking.pass_through(reranking.top_by_score(reranking.passing(rows, 0.15), 20), 20)
    return _rounded(out.select("query_id", "chunk_id", "reranked_score"), "reranked_score")


# evaluation


def v1_signals(spark: SparkSession, root: str) -> DataFrame:
    s = evaluation.signals(_scored_parents(spark, root), CONFIG)
    return _rounded(s.drop("avg_confidence"), "score_at_k", "score_cliff", "score_variance", "score_mean", "token_fill_ratio", "redundancy_ratio")


def v5_decisions(spark: SparkSession, root: str) -> DataFrame:
    s = evaluation.signals(_scored_parents(spark, root), CONFIG)
    return evaluation.decide(s, CONFIG).select("query_id", "action", "confidence", "rule")


# expansion, neighbours, merge


def x1_link_scores(spark: SparkSession, root: str) -> DataFrame:
    """The twenty best links for each of the asked queries."""
    links, docs = link_ops.once(table(spark, root, "link_candidates")), table(spark, root, "indexed_documents")
    s = expansion.scored(links, _asked(spark), docs.select(F.col("source_url").alias("url")), link_ops.in_degree(table(spark, root, "link_candidates")))
    return expansion.best(_rounded(s, "score"), 20, 0.12).select("query_id", "rank", "id", "target_url", "score")


def x2_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty links of the pages at depth 0, as one run would score them after taking those pages in."""
    links, docs = table(spark, root, "link_candidates"), table(spark, root, "indexed_documents")
    taken = docs.where("depth = 0").select(F.col("source_url").alias("url"))
    return expansion.first_candidates(links, docs, taken, CONFIG.candidates_to_score).select("place", "id", "target_url")


def x3_parent_urls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "indexed_documents").select("document_id", expansion.parent_urls(F.col("source_url")).alias("parents"))


def x5_in_degree(spark: SparkSession, root: str) -> DataFrame:
    return link_ops.in_degree(table(spark, root, "link_candidates"))


def l1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    hits = _scored_parents(spark, root).select("query_id", F.col("parent_id").alias("chunk_id"), "document_id", "chunk_index", "score")
    return merging.neighbours(hits, table(spark, root, "chunks"), 1, 0.3).select("query_id", "chunk_id", "chunk_index", "surface")


def _arrivals(spark: SparkSession, root: str) -> DataFrame:
    """Results of several queries as if they were sub-queries of one: by query, then score."""
    s = _scored_parents(spark, root)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id"))
    rows = s.withColumn("ord", (F.col("query_id") * 100 + n).cast("int")).withColumn("group_id", F.floor(F.col("query_id") / 250).cast("int"))
    return rows.select("group_id", "ord", F.col("parent_id").alias("chunk_id"), "score", "source_url", "section_heading", "title", "tokens", F.col("chunk_text").alias("selected_text"))


def m1_union(spark: SparkSession, root: str) -> DataFrame:
    return merging.union_by_chunk(_arrivals(spark, root), "group_id").select("group_id", "ord", "chunk_id", "score")


def m2_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    rows = merging.union_by_chunk(_arrivals(spark, root), "group_id")
    return merging.without_near_duplicates(rows, 0.3, "group_id").select("group_id", "chunk_id")


def m4_prefix_budget(spark: SparkSession, root: str) -> DataFrame:
    return merging.prefix_budget(merging.union_by_chunk(_arrivals(spark, root), "group_id"), 3000, "group_id").select("group_id", "rank", "chunk_id")


def m6_merged(spark: SparkSession, root: str) -> DataFrame:
    return merging.merged(_arrivals(spark, root), CONFIG.redundancy_ceiling, 4000, "group_id").select("group_id", "rank", "chunk_id", "score")


# presentation


def _grouped(rows: DataFrame, make: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What a function of the brief gives for the rows of each group, in their order."""
    import pandas as pd

    names = [c.split(" ")[0] for c in schema.split(", ")]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        given = part.sort_values("ord").to_dict("records")
        return pd.DataFrame([(given[0]["group_id"], *r) for r in make(given)], columns=names)

    return rows.groupBy("group_id").applyInPandas(one, schema)


def f2_sources(spark: SparkSession, root: str) -> DataFrame:
    """Pages of each group's results, numbered by first appearance, with their headings."""
    return _grouped(_arrivals(spark, root), lambda rows: [(u, n, hs) for n, u, _, hs in briefs.source_entries(rows)], "group_id int, source_url string, number int, headings array<string>")


def f8_citations(spark: SparkSession, root: str) -> DataFrame:
    """Quotes of each group's results, cut and without repeats, numbered in order."""
    rows = _arrivals(spark, root).withColumn("verbatim_text", F.col("selected_text"))
    return _grouped(rows, lambda rows: [(n, q) for n, q, _ in briefs.quote_entries(rows)], "group_id int, number int, quote string")


def f1_briefs(spark: SparkSession, root: str) -> DataFrame:
    """A whole brief for each group of results."""
    import pandas as pd

    def one(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("ord").to_dict("records")
        for r in rows:
            r |= {"surface": "markdown", "verbatim_text": r["selected_text"]}
        a = briefs.Answer("", rows, rows, matched=sorted({r["source_url"] for r in rows}))
        return pd.DataFrame({"group_id": [rows[0]["group_id"]], "brief": [briefs.brief(a, CONFIG)]})

    merged = merging.merged(_arrivals(spark, root), CONFIG.redundancy_ceiling, 4000, "group_id")
    return merged.groupBy("group_id").applyInPandas(one, "group_id int, brief string")


def h1_html_text(spark: SparkSession, root: str) -> DataFrame:
    c = retrieval.once(table(spark, root, "chunks").select("chunk_id", "html_text", "source_url").where("html_text is not null"))
    return html_text.converted(c, "chunk_id", "html_text", "source_url")


def t2_search(spark: SparkSession, root: str) -> DataFrame:
    return _engine(spark, root).search(ASKED[0], top_k=10).select("chunk_id", "reranked_rank", "source_url")


def t3_status(spark: SparkSession, root: str) -> DataFrame:
    return status(table(spark, root, "indexed_documents"), table(spark, root, "chunks")).select("document_id", "source_url", "parents", "children", "tokens")


def _engine(spark: SparkSession, root: str) -> Engine:
    docs, chunks, links = (table(spark, root, t) for t in ("indexed_documents", "chunks", "link_candidates"))
    return Engine(spark, Corpus(docs, chunks.drop("site"), link_ops.once(links), table(spark, root, "normalized_documents")), CONFIG.with_(similarity_floor=0.0))


def o1_answer(spark: SparkSession, root: str) -> DataFrame:
    """A whole run for one query over the corpus, without expansion."""
    a = _engine(spark, root).run(None, ASKED[1], expansion_budget=0)
    rows = [(i, c["chunk_id"], float(c["score"]), c["source_url"], c["source_sub_query"]) for i, c in enumerate(a.chunks, 1)]
    return spark.createDataFrame(rows, "place int, chunk_id string, score double, source_url string, sub_query string")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if callable(f) and name[0].islower() and name.split("_")[0][1:].isdigit() and len(name.split("_")[0]) <= 3}


def oracle_sql() -> dict[str, str]:
    from corvane.plans.oracles import SQL

    return SQL
