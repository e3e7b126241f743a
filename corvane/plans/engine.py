"""The engine: answer, search and status over a corpus.

The loop over rounds runs on the driver; every step inside it is a distributed
job over the corpus tables, and what comes back is one query's result, bounded
by top-k and token budgets.
"""

from __future__ import annotations

import threading
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import EngineConfig
from corvane.functions.brief import Answer, Step, brief
from corvane.functions.providers import Embedder, HashingEmbedder, Reranker, Tokenizer, WordTokenizer
from corvane.functions.text import token_span
from corvane.functions.urls import page_of
from corvane.operators import evaluation, expansion, merging, reranking, retrieval
from corvane.operators.analysis import analyze
from corvane.operators.chunking import chunks_of
from corvane.sources import store as st
from corvane.sources.pages import normalized, site_map


class Failure(RuntimeError):
    """An answer that can't be given at all; the message says what was asked and why."""


class TimedOut(Failure):
    """An answer that took longer than it may; its jobs are cancelled."""


#: What the phases of a run tell who asked.
PHASES = {
    "ingest": "Taking in the page", "analysis": "Reading the question", "retrieval": "Searching the corpus", "evaluation": "Judging what was found", "expand_breadth": "Following links",
    "expand_intent": "Asking in other words", "expand_recall": "Widening the search", "locality": "Adding neighbours", "citations": "Quoting", "format": "Writing the brief",
}


@dataclass
class Corpus:
    """Tables of a corpus, and where more pages come from."""

    documents: DataFrame
    chunks: DataFrame
    links: DataFrame
    pages: DataFrame | None = None
    added: list[str] = field(default_factory=list)


NO_EVIDENCE = "[SOURCES]\n(none)\n\n[EVIDENCE]\n(no evidence chunks)\n\nNo content was found for: {query}"


class Engine:
    def __init__(self, spark: SparkSession, corpus: Corpus, config: EngineConfig = EngineConfig(), embedder: Embedder | None = None, reranker: Reranker | None = None, tokenizer: Tokenizer | None = None, decompose: Callable[[str], list[str]] | None = None) -> None:
        self.spark, self.corpus, self.config = spark, corpus, config
        self.embedder, self.reranker, self.tokenizer, self.decompose = embedder or HashingEmbedder(config.embedding_dims), reranker, tokenizer or WordTokenizer(), decompose
        self.on_progress: Callable[[str, str], None] = lambda phase, message: None

    def progress(self, phase: str) -> None:
        """Tells who listens; one that fails doesn't fail the run."""
        try:
            self.on_progress(phase, PHASES.get(phase, phase))
        except Exception as e:
            warnings.warn(f"progress couldn't be told: {e!r}", stacklevel=2)

    # corpus

    def ensure(self, urls: list[str], depth: int = 0) -> tuple[list[str], list[str]]:
        """Pages that the corpus lacks are taken from the page source, chunked and added: (added, failed)."""
        missing = [r.url for r in st.missing_urls(self.spark.createDataFrame([(u,) for u in urls], "url string"), self.corpus.documents).collect()] if urls else []
        if not missing:
            return [], []
        if self.corpus.pages is None:
            return [], missing
        wanted = self.spark.createDataFrame([(u,) for u in missing], "source_url string")
        docs = st.prepared(normalized(self.corpus.pages)).join(wanted, "source_url", "left_semi").where("markdown is not null").withColumn("depth", F.lit(depth))
        got = [r.source_url for r in docs.select("source_url").collect()]
        if got:
            new = chunks_of(docs, self.config, self.tokenizer, self.embedder)
            c = self.corpus
            c.documents = c.documents.unionByName(docs.withColumn("indexed_at", F.current_timestamp()).select(*c.documents.columns), allowMissingColumns=True)
            c.chunks = c.chunks.unionByName(new, allowMissingColumns=True)
            c.links = c.links.unionByName(st.new_links(docs).select(*c.links.columns))
            c.added += got
        return got, [u for u in missing if u not in got]

    # one round

    def _queries(self, texts: list[str]) -> DataFrame:
        rows = [(i, t, v) for i, (t, v) in enumerate(zip(texts, self.embedder.embed(texts)))]
        return self.spark.createDataFrame(rows, "query_id int, query string, vector array<double>")

    def _retrieve(self, subs: list[str], sources: list[str] | None, budget: int, mode: str | None, timing: dict[str, float]) -> tuple[DataFrame | None, str]:
        """Ranked rows of all sub-queries in one job, each with the sub-query it came from, and the mode; nothing is embedded or searched where the scope has no parents."""
        began = time.time()
        c, cfg = self.corpus, self.config
        scope = self.spark.createDataFrame([(s,) for s in sources], "source_url string") if sources else None
        tokens = retrieval.corpus_counts(retrieval.scoped(c.chunks, scope), c.documents).first()
        timing["documents"], timing["parents"] = tokens.total_documents, tokens.total_parent_chunks
        if not tokens.total_parent_chunks:
            return None, mode or "full_context"
        fits = tokens.parent_tokens <= cfg.threshold(budget)
        mode = mode or ("full_context" if fits else "chunk")
        q = self._queries(subs)
        if mode == "full_context":
            all_ = retrieval.full_context(c.chunks, cfg, budget, scope).withColumn("rank", F.col("position"))
            rows = q.select("query_id", "query").crossJoin(all_)  # a few sub-queries with what fits one budget
        else:
            rows = retrieval.retrieve_chunks(c.chunks, q, cfg, budget, scope).join(F.broadcast(q.select("query_id", "query")), "query_id")
        timing["retrieval"] = timing.get("retrieval", 0) + (time.time() - began) * 1000
        began = time.time()
        ranked = reranking.rerank(reranking.passing(rows, cfg.rerank_similarity_floor), self.reranker, cfg)
        out = ranked.select("query_id", F.col("query").alias("source_sub_query"), "chunk_id", "document_id", "chunk_index", F.col("reranked_score").alias("score"), "raw_similarity", "confidence", F.lit(False).alias("is_locality_expanded"), "surface", "selected_text", "chunk_text", "section_heading", "source_url", "title", "depth", "char_start", "char_end", "token_start", "token_end", token_span().alias("tokens"), (F.col("query_id") * 10000 + F.col("reranked_rank")).alias("ord"))
        timing["reranking"] = timing.get("reranking", 0) + (time.time() - began) * 1000
        return out, mode

    def _merged(self, rows: DataFrame | None, budget: int) -> list[dict[str, Any]]:
        if rows is None:
            return []
        one = rows.withColumn("query_id", F.lit(0))
        got = merging.merged(one, self.config.redundancy_ceiling, budget).orderBy("rank").collect()
        return [r.asDict() for r in got]

    def _sub_queries(self, query: str, constraints: list[str] | None, by_rules: list[str]) -> list[str]:
        """What the decomposer gives, with the constraints; where there is none, or it fails or gives nothing, what the rules give."""
        if self.decompose is None:
            return by_rules
        try:
            got = [s.strip() for s in self.decompose(query) if s and s.strip()]
        except Exception as e:
            warnings.warn(f"the decomposer failed, the rules hold: {e!r}", stacklevel=2)
            got = []
        return [" ".join([s, *constraints]) if constraints else s for s in got] or by_rules

    def _quotes(self, chunks: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """The chunks with the words of their page at their place; the chunk's own text where the page isn't at hand or has changed."""
        pages: dict[str, str] = {}
        if chunks and self.corpus.pages is not None:
            spans: dict[str, list[dict[str, Any]]] = {}
            for c in chunks:
                spans.setdefault(c["document_id"], []).append(c)
            own = self.corpus.documents.join(F.broadcast(self.spark.createDataFrame([(d,) for d in spans], "document_id string")), "document_id", "left_semi").select("document_id", "source_url", "content_hash")
            at = self.spark.createDataFrame([(c["document_id"], c["chunk_id"], c["char_start"], c["char_end"]) for c in chunks], "document_id string, chunk_id string, s int, e int")
            text = normalized(self.corpus.pages).withColumn("source_url", page_of()).join(F.broadcast(own), ["source_url", "content_hash"]).select("document_id", "markdown")
            cut = F.substr("markdown", F.col("s") + 1, F.col("e") - F.col("s"))
            pages = {r.chunk_id: r.q for r in text.join(F.broadcast(at), "document_id").where("s >= 0 and e > s and e <= length(markdown)").select("chunk_id", cut.alias("q")).dropDuplicates(["chunk_id"]).collect()}
        quoted = [c | {"verbatim_text": pages.get(c["chunk_id"]) or c["chunk_text"]} for c in chunks]
        return [c for c in quoted if c["verbatim_text"]]

    # tools

    def run(self, url: str | None, query: str, intent: str | None = None, constraints: list[str] | None = None, expansion_budget: int | None = None, mode: str | None = None) -> Answer:
        """Analyse, retrieve, and expand until a rule stops; then neighbours, the final merge and citations."""
        cfg, began, timing = self.config, time.time(), {}
        budget = cfg.budget(None)
        most = cfg.max_expansion_depth if expansion_budget is None else min(expansion_budget, cfg.max_expansion_depth)
        self.progress("ingest")
        added, failed = self.ensure([url]) if url else ([], [])
        if failed:
            raise Failure(f"could not get {failed[0]}")
        self.progress("analysis")
        asked = self.spark.createDataFrame([(query, intent)], "query string, intent string")
        a = analyze(asked, "query", F.col("intent"), constraints, cfg.decomposition_mode).first()
        subs, concepts = self._sub_queries(query, constraints, list(a.sub_queries)), list(a.key_concepts)
        timing["analysis"] = (time.time() - began) * 1000
        ingested = list(dict.fromkeys([u.split("#")[0] for u in [url] if u] + added))
        scope = [url.split("#")[0]] if url else None
        self.progress("retrieval")
        rows, used_mode = self._retrieve(subs, scope, budget, mode, timing)
        chunks = self._merged(rows, budget)
        decision, band = self._decide(chunks, budget, 0, None)
        steps: list[Step] = []
        i = 0
        while decision["action"] != "stop" and i < most:
            i += 1
            self.progress(decision["action"])
            at = time.time()
            step = Step(url or (chunks[0]["source_url"] if chunks else ""), i, reason=decision["reason"])
            if decision["action"] == "expand_breadth":
                c = self.corpus
                known = self.spark.createDataFrame([(u,) for u in ingested], "url string")
                mine = c.links.join(F.broadcast(c.documents.join(F.broadcast(known.withColumnRenamed("url", "source_url")), "source_url", "left_semi").select(F.col("document_id").alias("source_document_id"))), "source_document_id", "left_semi")
                found = site_map(c.pages, mine, F.current_timestamp(), cfg.map_limit) if c.pages is not None else None
                targets = expansion.selected(c.links, c.documents, step.source_url, i, query, concepts, ingested, cfg.candidates_to_score, cfg.candidates_per_iteration, cfg.min_candidate_score, found)
                step.expanded, step.failed = self.ensure(targets, i)
                step.chunks_added = len(step.expanded)
                ingested += step.expanded
            elif decision["action"] == "expand_recall":
                budget *= 2
            else:
                subs = list(dict.fromkeys([query, *subs, " ".join(concepts)]))
            steps.append(step)
            timing["expansion"] = timing.get("expansion", 0) + (time.time() - at) * 1000
            rows, used_mode = self._retrieve(subs, None, budget, mode, timing)
            chunks = self._merged(rows, budget)
            if decision["action"] == "expand_breadth" and not step.expanded:
                decision = {"action": "stop", "reason": "No candidates left to expand."}
                break
            decision, band = self._decide(chunks, budget, i, band)
        at = time.time()
        self.progress("locality")
        if cfg.locality_enabled and chunks:
            chunks = self._with_neighbours(chunks, budget)
        timing["locality"] = (time.time() - at) * 1000
        timing["total"] = (time.time() - began) * 1000
        self.progress("format")
        cites = self._quotes(chunks)
        return Answer(query, chunks, cites, steps, used_mode, decision["reason"], i, len(self.corpus.added), timing.pop("documents"), timing.pop("parents"), sorted({c["source_url"] for c in chunks}), timing)

    def _decide(self, chunks: list[dict[str, Any]], budget: int, iteration: int, band: int | None) -> tuple[dict[str, Any], int]:
        if chunks:
            rows = self.spark.createDataFrame([(0, float(c["score"]), int(c["tokens"]), c["source_url"], c["confidence"]) for c in chunks], "query_id int, score double, tokens int, source_url string, confidence double")
            s = evaluation.signals(rows, self.config, budget, confidence="confidence")
        else:
            none = evaluation.empty_signals()
            kinds = {float: "double", int: "bigint", bool: "boolean", type(None): "double"}
            s = self.spark.createDataFrame([tuple(none.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in none.items()))
        d = evaluation.decide(s, self.config, iteration, F.lit(band).cast("bigint")).first()
        return {"action": d.action, "reason": d.reason}, d.chunks_above_threshold

    def _with_neighbours(self, chunks: list[dict[str, Any]], budget: int) -> list[dict[str, Any]]:
        hits = self.spark.createDataFrame([(0, c["chunk_id"], c["document_id"], c["chunk_index"], float(c["score"])) for c in chunks], "query_id int, chunk_id string, document_id string, chunk_index int, score double")
        near = merging.neighbours(hits, self.corpus.chunks, self.config.locality_radius, self.config.locality_min_score)
        near = [r.asDict() | {"confidence": None, "raw_similarity": None, "source_sub_query": None} for r in near.withColumn("tokens", token_span()).orderBy("document_id", "chunk_index").collect()]
        if not near:
            return chunks
        # hits in their order, then the neighbours: one more merge
        cols = ["chunk_id", "selected_text"]
        rows = [(0, i, float(c["score"]), int(c["tokens"] or 0), *(c[k] for k in cols)) for i, c in enumerate(chunks + near)]
        made = self.spark.createDataFrame(rows, "query_id int, ord int, score double, tokens int, chunk_id string, selected_text string")
        kept = merging.merged(made, self.config.redundancy_ceiling, budget).orderBy("rank").select("chunk_id").collect()
        by = {c["chunk_id"]: c for c in reversed(chunks + near)}
        return [by[r.chunk_id] for r in kept]

    def answer(self, url: str | list[str] | None, query: str, intent: str | None = None, constraints: list[str] | None = None, expansion_budget: int | None = None, research_mode: str = "fast", retrieval_mode: str | None = None) -> str:
        """A brief for a query. Further urls are taken in first; ``fast`` doesn't expand unless a budget is given; ``deep`` does."""
        urls = [url] if isinstance(url, str) else list(url or [])
        if research_mode not in ("fast", "deep"):
            raise ValueError("research_mode is fast or deep")
        self.ensure(urls[1:])
        steps = expansion_budget if expansion_budget is not None else (0 if research_mode == "fast" else None)
        a = self._in_time(lambda: self.run(urls[0] if urls else None, query, intent, constraints, steps, retrieval_mode))
        if not a.chunks:
            return NO_EVIDENCE.format(query=query)
        note = "\n\nNext step: run again in deep mode to follow the links of these pages." if research_mode == "fast" and not a.steps else ""
        return brief(a, self.config, self.tokenizer) + note

    def _in_time(self, work: Callable[[], Answer]) -> Answer:
        """What ``work`` gives, whose jobs are cancelled when the time an answer may take is over."""
        sc, late, group = self.spark.sparkContext, threading.Event(), f"answer-{uuid.uuid4().hex[:8]}"

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(self.config.timeout_s, stop)
        timer.daemon = True
        sc.setJobGroup(group, "answer", interruptOnCancel=True)
        timer.start()
        try:
            a = work()
        except Exception as e:
            if late.is_set():
                raise TimedOut(f"The answer took longer than {self.config.timeout_s} s. Ask for fewer pages, or in fast mode.") from e
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
        if late.is_set():
            raise TimedOut(f"The answer took longer than {self.config.timeout_s} s. Ask for fewer pages, or in fast mode.")
        return a

    def search(self, query: str, source_urls: list[str] | None = None, top_k: int = 10, retrieval_mode: str | None = None, by_score: bool = False) -> DataFrame:
        """The first ``top_k`` retrieved parents in the order of documents (or by score), reranked: one stage of retrieval without merge or floor."""
        cfg = self.config
        scope = self.spark.createDataFrame([(s,) for s in source_urls], "source_url string") if source_urls else None
        mode = retrieval_mode or "chunk"
        if mode not in ("chunk", "full_context"):
            raise ValueError("retrieval_mode is chunk or full_context")
        if mode == "full_context":
            rows = retrieval.full_context(self.corpus.chunks, cfg, sources=scope).withColumn("rank", F.col("position")).withColumn("query_id", F.lit(0))
        else:
            rows = retrieval.retrieve_chunks(self.corpus.chunks, self._queries([query]), cfg, sources=scope)
        first = rows.where(F.col("rank" if by_score else "position") <= top_k).withColumn("query", F.lit(query))
        return reranking.rerank(first, self.reranker, cfg.with_(rerank_top_n=top_k))

    def status(self, source_url: str | None = None) -> DataFrame:
        return status(self.corpus.documents, self.corpus.chunks, source_url)


def status(documents: DataFrame, chunks: DataFrame, source_url: str | None = None) -> DataFrame:
    """One row a document, newest first, with its parents, children and parents' tokens; documents without chunks count 0."""
    d = documents if source_url is None else documents.where(F.col("source_url") == source_url)
    c = retrieval.once(chunks.select("chunk_id", "document_id", "chunk_level", "token_start", "token_end"))
    parent = F.col("chunk_level") == "parent"
    per = c.groupBy("document_id").agg(F.count_if(parent).alias("parents"), F.count_if(~parent).alias("children"), F.sum(F.when(parent, F.col("token_end") - F.col("token_start"))).alias("tokens"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint").alias(x)
    return d.join(per, "document_id", "left").select("document_id", "source_url", "title", "fetched_at", "depth", zero("parents"), zero("children"), zero("tokens")).orderBy(F.desc_nulls_last("fetched_at"), "document_id")


def totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (documents, parents, children, tokens) for the whole corpus."""
    per = status(documents, chunks)
    return per.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("parents", "children", "tokens")))
