import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.config import EngineConfig
from corvane.functions import text
from corvane.functions.urls import language_of, page_of, site_of
from corvane.operators import chunking, expansion
from corvane.plans.engine import Corpus, Engine, Failure, TimedOut, status, totals
from corvane.sources import links as lk
from corvane.sources import pages as pg
from corvane.sources import store as st
from corvane.streaming.upserts import stream_into, upsert

T0 = dt.datetime(2025, 1, 1)
PAGE = "url string, source_url string, title string, markdown string, html string, links array<string>, fetched_at timestamp"


def day(n):
    return T0 + dt.timedelta(days=n)


def one(spark, expr, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(expr).first()[0]


@pytest.mark.parametrize("url, key", [("https://a.b/x/?q=1#f", "https://a.b/x"), ("https://a.b", "https://a.b/"), ("https://a.b/", "https://a.b/"), ("https://u@a.b:8/x;p=1", "https://u@a.b:8/x"), ("no scheme/x/", "no scheme/x"), ("https://a.b/x//", "https://a.b/x"), ("", "/")])
def test_match_key(spark, url, key):
    assert one(spark, pg.match_key(F.col("c0")), url) == key


@pytest.mark.parametrize("url, site", [("https://www.A.example:443/x", "a.example"), ("http://user:pw@b.example/", "b.example"), ("//c.example/x", "c.example"), ("nonsense", ""), ("", ""), ("HTTPS://D.example", "d.example")])
def test_site(spark, url, site):
    assert one(spark, site_of(F.col("c0")), url) == site


@pytest.mark.parametrize("given, code", [("en-US", "en"), ("EN", "en"), ("english", "en"), ("français", "fr"), ("jp", "ja"), ("pt_BR", "pt"), ("", "und"), (" de ", "de")])
def test_language(spark, given, code):
    assert one(spark, language_of(F.col("c0")), given) == code


def test_normalizing(spark):
    rows = [("https://a.example/p.PDF?x", None, "t", "text", "<p>", ["https://x/#a", "https://x/", "", None, "#top", "https://y"], T0), ("https://a.example/q", "", None, "", None, None, None), ("https://a.example/r", "https://a.example/s", None, None, None, [], T0)]
    got = {r.url: r for r in pg.normalized(spark.createDataFrame(rows, PAGE)).collect()}
    a, b, c = (got[r[0]] for r in rows)
    assert a.doc_type == "pdf" and a.links == ["https://x/", "https://y"] and a.content_hash == "982d9e3eb996f559e633f4d194def3761d909f5a3b647d1a851fead67c32c9d1"
    assert b.doc_type == "html" and b.content_hash == "" and b.links == [] and c.content_hash == "" and b.status_code is None
    assert pg.normalized(spark.createDataFrame([], PAGE)).count() == 0
    kinds = spark.createDataFrame([("application/PDF; x", 0), ("text/html", 3), ("text/html", 0)], "t string, n int").select(pg.doc_type(F.col("t"), F.col("n"), F.lit(None), F.lit("u")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["pdf", "pdf", "html"]


def test_batches_keep_their_order(spark):
    asked = spark.createDataFrame([(0, "https://a.example/1"), (1, "https://a.example/gone"), (2, "https://a.example/1/#x"), (3, "https://a.example/2")], "position int, requested_url string")
    pages = spark.createDataFrame([("https://a.example/2/", None, "two", "m", None, [], T0), ("https://a.example/1", None, "one", "m", None, [], T0), ("https://elsewhere.example/", None, "moved", "m", None, [], T0)], PAGE)
    got = [(r.position, r.title) for r in pg.ingest(asked, pages).orderBy("position").collect()]
    assert got == [(0, "one"), (1, None), (2, None), (3, "two")]
    filled = {r.position: r.url for r in pg.fill_unmatched(asked, pages).collect()}
    assert filled == {0: "https://a.example/1", 1: "https://elsewhere.example/", 2: None, 3: "https://a.example/2/"}


LINK = [("l1", "d1", "https://a/1", "https://a/x", None, None, day(1), None, 0), ("l1", "d1", "https://a/1", "https://a/x", None, None, day(1), None, 0), ("l2", "d1", "https://a/1", "https://a/y", "old", None, day(2), None, 0), ("l3", "d2", "https://a/2", "https://a/x", "T", "D", day(3), day(4), 1), ("l4", "d2", "https://a/2", "https://a/z", None, None, day(0), None, 1)]
DOC = [("d1", "https://a/1", 0), ("d2", "https://a/2", 1)]


def test_link_enrichment(spark):
    links, docs = spark.createDataFrame(LINK, schemas.LINKS), spark.createDataFrame(DOC, "document_id string, source_url string, depth int")
    found = spark.createDataFrame([("d1", "https://a/x", "X", None, day(9)), ("d1", "https://a/new", "N", "d", day(9)), ("d2", "https://a/z", "Z", "z", day(9)), ("d9", "https://a/q", "q", "", day(9)), ("d1", None, "", "", day(9))], "source_document_id string, target_url string, title string, description string, at timestamp")
    got = {(r.source_document_id, r.target_url): (r.title, r.touched, r.enriched_at is not None, r.depth) for r in lk.enrich(links, found, docs).collect()}
    assert got == {("d1", "https://a/x"): ("X", True, True, 0), ("d1", "https://a/y"): ("old", False, False, 0), ("d1", "https://a/new"): ("N", True, True, 0), ("d2", "https://a/x"): ("T", False, True, 1), ("d2", "https://a/z"): (None, False, False, 1)}
    again = lk.enrich(lk.enrich(links, found, docs).drop("touched"), found, docs)
    assert not any(r.touched for r in again.collect())


def test_link_candidates(spark):
    links = lk.once(spark.createDataFrame(LINK, schemas.LINKS))
    docs = spark.createDataFrame([("d2",)], "document_id string")
    assert [r.id for r in lk.candidates(links, docs).collect()] == ["l4", "l3"]
    assert [r.id for r in lk.candidates(links, exclude=spark.createDataFrame([("https://a/x",)], "url string")).collect()] == ["l4", "l2"]
    assert [r.id for r in lk.candidates(links, enriched_only=True).collect()] == ["l3"]
    assert {r.target_url: r.in_degree for r in lk.in_degree(spark.createDataFrame(LINK, schemas.LINKS)).collect()} == {"https://a/x": 2, "https://a/y": 1, "https://a/z": 1}


@pytest.mark.parametrize("url, above", [("https://s.example/stable/modules/ensemble.html", ["https://s.example/stable/modules/", "https://s.example/stable/"]), ("https://e.example/page", []), ("https://e.example/", []), ("https://e.example/a//b/?q=/x/y", ["https://e.example/a/"])])
def test_parent_urls(spark, url, above):
    assert one(spark, expansion.parent_urls(F.col("c0")), url) == above


def test_link_score(spark):
    links = spark.createDataFrame([("l", "https://s.example/modules/gradient_boosting.html", "Gradient Boosting Guide", "Complete guide to gradient boosting algorithms.", 1), ("m", "https://s.example/other", None, None, 9)], "id string, target_url string, title string, description string, depth int")
    ask = spark.createDataFrame([(1, "gradient boosting", ["gradient", "boosting"])], "query_id int, query string, key_concepts array<string>")
    got = {r.id: r.score for r in expansion.scored(links, ask).collect()}
    assert got["l"] == pytest.approx(0.15 * 2 / 4 + 0.4 * 2 / 3 + 0.3 * 2 / 6 + 0.1 * 0.8) and got["m"] == 0
    assert [r.id for r in expansion.best(expansion.scored(links, ask), 1, 0.12).collect()] == ["l"] and expansion.best(expansion.scored(links, ask), 5, 0.9).count() == 0
    done = spark.createDataFrame([("https://s.example/modules/gradient_boosting.html",)], "url string")
    assert {r.id for r in expansion.scored(links, ask, done).collect()} == {"m"}


def test_text_expressions(spark):
    assert one(spark, text.without_markup(F.col("c0")), "<p>Hello <b>world</b></p>") == "Hello world" and one(spark, text.without_markup(F.col("c0")), "foo   bar\n\nbaz") == "foo bar baz"
    assert one(spark, text.missing(F.col("c0")), "  \n ") is None and one(spark, text.missing(F.col("c0")), " a   b ") == "a b"
    f = chunking.facts(spark.createDataFrame([(1, "| a |\n\nNote\n1) x", None), (2, None, None), (3, "![Alt](u) ![alt](v)", "c")], "id int, t string, c string"), "id", "t", "c").orderBy("id").collect()
    assert [r.id for r in f] == [1, 3] and f[0].flags == [True, False, False, False, True, True] and f[1].context == "Alt" and f[1].images == 2 and f[1].embedding_text.endswith("Image context: c")
    assert chunking.plain("# A [Link](u) `x`") == "a link x"
    assert one(spark, text.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")), 1) == 0.0


def page(n, body, links=(), d=0):
    return (f"https://a.example/{n}", None, f"Page {n}", body, None, list(links), day(d))


def test_upserts(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/store")
    assert s.version() is None and s.read("chunks").count() == 0
    first = spark.createDataFrame([page(1, "## One\n\nalpha beta", ["https://a.example/2"]), page(2, "## Two\n\ngamma"), page(2, "## Two\n\ngamma", d=-1), page(3, None)], PAGE)
    assert upsert(s, first) == {"insert": 3, "replace": 0, "unchanged": 0}
    v, chunks = s.version(), {r.chunk_id for r in s.read("chunks").collect()}
    assert s.read("documents").count() == 3 and s.read("link_candidates").count() == 1 and len(chunks) == 6
    assert upsert(s, first) == {"insert": 0, "replace": 0, "unchanged": 3} and s.version() == v
    assert upsert(s, spark.createDataFrame([page(1, "## One\n\nchanged", d=5), page(2, "## Two\n\ngamma", d=5)], PAGE)) == {"insert": 0, "replace": 1, "unchanged": 1}
    after = s.read("chunks").collect()
    assert {r.document_id for r in after} == {r.document_id for r in s.read("documents").collect()} - {r.document_id for r in s.read("documents").where("source_url like '%/3'").collect()}
    assert any("changed" in r.chunk_text for r in after) and s.read("link_candidates").count() == 0
    assert upsert(s, first.limit(0)) == {"insert": 0, "replace": 0, "unchanged": 0}


def test_stream(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/store")
    spark.createDataFrame([page(1, "## One\n\nalpha")], PAGE).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(spark.createDataFrame([], PAGE).schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_into(s, stream, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(120)
    spark.createDataFrame([page(2, "## Two\n\nbeta"), page(1, "## One\n\nalpha", d=3)], PAGE).write.parquet(f"{tmp_path}/in/b")
    stream_into(s, stream, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    assert {r.source_url for r in s.read("documents").collect()} == {"https://a.example/1", "https://a.example/2"}


def corpus(spark, *rows):
    pages = spark.createDataFrame(list(rows), PAGE)
    empty = lambda schema: spark.createDataFrame([], schema)
    return Corpus(empty(schemas.DOCUMENTS), empty(schemas.CHUNKS), empty(schemas.LINKS), pg.normalized(pages))


def test_engine_answers_and_expands(spark):
    c = corpus(spark, page(1, "## Intro\n\nAn index stores pages.", ["https://a.example/gradient-boosting", "https://a.example/other"]), page("gradient-boosting", "## Gradient boosting\n\ngradient boosting builds trees one after the other"), page("other", "## Other\n\nnothing of interest"))
    e = Engine(spark, c, EngineConfig(max_expansion_depth=2, plateau_variance=0.0, min_candidate_score=0.05))
    got = e.run("https://a.example/1#top", "gradient boosting")
    assert any("trees one after" in r["selected_text"] for r in got.chunks) and got.iterations >= 1 and got.steps[0].expanded
    assert "https://a.example/gradient-boosting" in c.added and got.mode == "full_context" and got.citations
    brief = e.answer("https://a.example/1", "gradient boosting")
    assert "[SOURCES]" in brief and "[STATS]" in brief and "deep mode" in brief
    found = e.search("gradient boosting builds trees", top_k=2).collect()
    assert found and "trees" in found[0].selected_text
    s = {r.source_url: r.parents for r in e.status().collect()}
    assert len(s) == 3 and all(v >= 1 for v in s.values())
    with pytest.raises(Failure):
        e.run("https://a.example/missing", "x")
    assert status(c.documents.limit(0), c.chunks).count() == 0


def test_engine_on_an_empty_corpus(spark):
    e = Engine(spark, corpus(spark, page(1, "x")), EngineConfig(max_expansion_depth=1))
    assert "No content was found" in e.answer(None, "anything")
    assert page_of() is not None


def test_a_write_touches_only_its_buckets_and_readers_never_see_nothing(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/store", buckets=16)
    upsert(s, spark.createDataFrame([page(i, f"## P\n\nbody {i}") for i in range(30)], PAGE))
    before, v = s._manifest(s.version())["files"], s.version()
    upsert(s, spark.createDataFrame([page(3, "## P\n\nchanged", d=4)], PAGE))
    after = s._manifest(s.version())["files"]
    moved = {b for b in set(before["documents"]) | set(after["documents"]) if before["documents"].get(b) != after["documents"].get(b)}
    assert 1 <= len(moved) <= 2 and s.read("documents").count() == 30 and s.read("chunks").where("chunk_text like '%changed%'").count() >= 1
    # the old pointer stays until the new one stands: a crash before that leaves the store as it was
    assert s._manifest(v)["files"] == before
    real, s._put = s._put, lambda name, text: (_ for _ in ()).throw(OSError("crash")) if name.startswith("pointers/") else real(name, text)
    with pytest.raises(OSError):
        upsert(s, spark.createDataFrame([page(5, "## P\n\nlost", d=4)], PAGE))
    again = st.Store(spark, f"file://{tmp_path}/store")
    assert again.read("documents").count() == 30 and again.read("chunks").where("chunk_text like '%lost%'").count() == 0
    assert upsert(again, spark.createDataFrame([page(5, "## P\n\nlost", d=4)], PAGE))["replace"] == 1


def test_links_to_follow_are_those_of_pages_taken_in(spark):
    docs = spark.createDataFrame([("d1", "https://a.example/1", 0), ("d2", "https://b.example/1", 0)], "document_id string, source_url string, depth int")
    link = lambda i, d, t, title=None: (i, d, f"https://{'ab'[d == 'd2']}.example/1", f"https://x.example/{t}", title, None, day(int(i[1:])), None, 0)
    links = spark.createDataFrame([link("l9", "d1", "far"), link("l1", "d2", "other"), link("l2", "d1", "near"), link("l3", "d1", "near"), link("l4", "d1", "done")], schemas.LINKS)
    done = spark.createDataFrame([("https://a.example/1",), ("https://x.example/done",), (None,)], "url string")
    got = expansion.first_candidates(links, docs, done, 20).orderBy("place").collect()
    assert [(r.place, r.id, r.target_url) for r in got] == [(1, "l2", "https://x.example/near"), (2, "l9", "https://x.example/far")]
    found = spark.createDataFrame([("d1", "https://x.example/far", "red trees", None, day(50)), ("d1", "https://x.example/new", "blue", None, day(50))], "source_document_id string, target_url string, title string, description string, at timestamp")
    got = {r.target_url: r.title for r in expansion.first_candidates(links, docs, done, 20, found).collect()}
    assert got == {"https://x.example/near": None, "https://x.example/far": "red trees", "https://x.example/new": "blue"}
    args = ("https://a.example/1", 1, "red trees", ["trees"], ["https://a.example/1"], 20, 1, 0.05)
    assert expansion.selected(links, docs, *args, found=found) == ["https://x.example/far"] and expansion.selected(links.limit(0), docs, *args) == []


def test_page_payloads():
    class Obj:
        data = [1, None, 2]

    assert pg.payload_items([1, 2]) == [1, 2] and pg.payload_items({"links": [1, 2, 3]}, 2) == [1, 2] and pg.payload_items(Obj()) == [1, 2]
    for bad in (None, 3, "x", {"other": []}):
        with pytest.raises(ValueError):
            pg.payload_items(bad)


def test_engine_limits_and_fallbacks(spark):
    import time

    c = corpus(spark, page(1, "## Intro\n\nAn   index stores pages.\n\n\n\nMore of it."))
    told = []
    e = Engine(spark, c, EngineConfig(max_expansion_depth=0), decompose=lambda q: 1 / 0)
    e.on_progress = lambda phase, message: told.append((phase, message))
    with pytest.warns(UserWarning, match="decomposer"):
        got = e.run("https://a.example/1", "index pages", constraints=["2024"])
    assert got.chunks and all(r["verbatim_text"] in "## Intro\n\nAn   index stores pages.\n\n\n\nMore of it." for r in got.citations)
    assert ("retrieval", "Searching the corpus") in told
    e.decompose = lambda q: ["a", " ", "b"]
    assert e._sub_queries("q", ["2024"], ["q"]) == ["a 2024", "b 2024"]
    slow = Engine(spark, c, EngineConfig(timeout_s=1), decompose=lambda q: time.sleep(2) or ["index"])
    with pytest.raises(TimedOut):
        slow.answer("https://a.example/1", "index pages")
    assert e.search("index", retrieval_mode="full_context").count() == 1
    with pytest.raises(ValueError):
        e.search("index", retrieval_mode="none")
    t = totals(c.documents, c.chunks).first()
    assert (t.documents, t.parents) == (1, 1) and t.children >= 1


def test_a_remote_reranker_takes_an_instruction(spark):
    from corvane.functions.providers import RemoteReranker

    asked = []
    r = RemoteReranker(lambda q, p: asked.append(q) or [(1, 0.9), (0, 0.2)], "Prefer short ones")
    assert r.rerank("cats", ["x", "y"]) == [(1, 0.9, 0.9), (0, 0.2, 0.2)] and asked == ["Prefer short ones. cats"]
    with pytest.raises(ValueError):
        RemoteReranker(lambda q, p: [(7, 1.0)]).rerank("q", ["x"])
