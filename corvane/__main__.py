"""``python -m corvane answer|search|status CORPUS ...``: the tools over a folder of tables or a store."""

from __future__ import annotations

import argparse

from corvane.config import EngineConfig
from corvane.plans.engine import Corpus, Engine
from corvane.session import local_session, table
from corvane.sources.store import Store


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corvane")
    tools = p.add_subparsers(dest="tool", required=True)
    for name in ("answer", "search", "status"):
        t = tools.add_parser(name)
        t.add_argument("corpus", help="a store, or a folder with indexed_documents, chunks and link_candidates")
        if name != "status":
            t.add_argument("query")
        t.add_argument("--url", action="append", default=[])
        t.add_argument("--mode", choices=("chunk", "full_context"))
    tools.choices["answer"].add_argument("--deep", action="store_true")
    tools.choices["search"].add_argument("--top-k", type=int, default=10)
    a = p.parse_args(argv)
    spark = local_session()
    store = Store(spark, a.corpus)
    if store.version():
        corpus = Corpus(*(store.read(t) for t in ("documents", "chunks", "link_candidates")))
    else:
        docs, chunks, links = (table(spark, a.corpus, t) for t in ("indexed_documents", "chunks", "link_candidates"))
        corpus = Corpus(docs, chunks.drop("site"), links, table(spark, a.corpus, "normalized_documents"))
    engine = Engine(spark, corpus, EngineConfig())
    if a.tool == "answer":
        print(engine.answer(a.url or None, a.query, research_mode="deep" if a.deep else "fast", retrieval_mode=a.mode))
    elif a.tool == "search":
        for r in engine.search(a.query, a.url or None, a.top_k, a.mode).orderBy("reranked_rank").toLocalIterator():
            print(f"{r.reranked_rank}. {r.reranked_score:.3f} {r.source_url}\n{r.selected_text}\n")
    else:
        for r in engine.status(a.url[0] if a.url else None).toLocalIterator():
            print(f"{r.fetched_at} {r.source_url}: {r.parents} parents, {r.children} children, {r.tokens} tokens")


if __name__ == "__main__":
    main()
