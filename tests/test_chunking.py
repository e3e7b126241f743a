import json

import pytest

from corvane import schemas
from corvane.config import EngineConfig
from corvane.functions import dom
from corvane.functions.providers import BytePairTokenizer, HashingEmbedder, WordTokenizer, checked_embeddings, token_offsets
from corvane.operators import chunking as ch
from corvane.session import table
from corvane.sources import pages, store

WIDE = EngineConfig(child_target_tokens=10_000, parent_max_tokens=10_000)
TOK = WordTokenizer()


def test_sections():
    md = "lost words\n# One\na\n## Two\nb\n## Three\nc"
    assert [(h, md[a:b]) for h, a, b in ch.sections(md)] == [("## Two", "## Two\nb\n"), ("## Three", "## Three\nc")]
    assert [h for h, *_ in ch.sections("# A\nx\n# B\ny")] == ["# A", "# B"]
    assert ch.sections("no heading") == [(None, 0, 10)]


def test_blocks():
    t = "one\ntwo\n\n\n three\n   \n\nfour\n\n  "
    assert [t[a:b] for a, b in ch.blocks(t)] == ["one\ntwo", " three", "four"] or [t[a:b].strip() for a, b in ch.blocks(t)] == ["one\ntwo", "three", "four"]
    assert ch.blocks(" \n\n ") == []


def test_pieces_shatter_without_joining():
    assert ch.pieces("a b c", 5, TOK.count) == ["a b c"]
    assert ch.pieces("one two. three four. five", 2, TOK.count) == ["one two.", "three four.", "five"]
    assert ch.pieces("one two three four", 3, TOK.count) == ["one", "two", "three", "four"]
    assert ch.pieces("x" * 50, 1, lambda t: len(t)) == ["x" * 50]


def test_parents_pack_blocks():
    md = "## H\n\n" + "\n\n".join(f"p{i} " + "w " * 9 for i in range(6))
    parents = ch.parents_of(md, 25, TOK.count)
    assert [p.index for p in parents] == list(range(len(parents))) and len(parents) == 3
    assert all(TOK.count(p.text) <= 25 for p in parents) and all(p.heading == "## H" for p in parents)
    assert parents[0].start == 0 and all(md[p.start :].startswith(p.text[:10]) for p in parents)


def test_headless_documents_make_parents_of_four():
    parents, children = ch.chunk_document("\n\n".join(f"para {i}" for i in range(9)), None, WIDE, TOK)
    assert [c.index for c in children] == list(range(9)) and [c.parent for c in children] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    assert [p.text.count("\n\n") for p in parents] == [3, 3, 0] and parents[1].start == children[4].start and all(p.heading is None for p in parents)


def test_nothing_of_nothing():
    assert ch.chunk_document("", None, WIDE, TOK) == ([], []) == ch.chunk_document(None, "<p>x", WIDE, TOK)


def test_images():
    none, _ = ch.chunk_document("# Title\n\nSome plain text", "<html><body><p>Some plain text</p></body></html>", WIDE, TOK)
    assert none[0].images == [] and none[0].context is None
    html = '<section><div><p>alpha beta gamma figures</p><figure><img src="/a.png" alt="First"><figcaption>Cap one</figcaption></figure><figure><img src="/b.png" alt="Second"></figure><figure><img src="/a.png" alt="First"><figcaption>Cap one</figcaption></figure></div></section>'
    parents, children = ch.chunk_document("# Title\n\nalpha beta gamma figures First Second Cap", html, WIDE, TOK)
    assert parents[0].images == [("/a.png", "First", None, "Cap one"), ("/b.png", "Second", None, None)]
    assert parents[0].context == "First | Cap one | Second"
    md, _ = ch.chunk_document('# T\n\n![  Alt  text ](x.png "My title") ![](y.png)', None, WIDE, TOK)
    assert md[0].images == [("x.png", "Alt text", "My title", None), ("y.png", None, None, None)] and md[0].context == "Alt text | My title"


def test_flags_and_snippets():
    html = '<div><table><tr><td>alpha</td><td>beta</td></tr></table><pre><code>print(gamma)</code></pre><div class="admonition note"><p>delta epsilon zeta</p></div><ol><li>steps</li></ol></div>'
    parents, children = ch.chunk_document("## H\n\n| alpha | beta |\n|---|---|\n\n```\nprint(gamma)\n```\n\nNote\n\ndelta epsilon zeta\n\n1. steps", html, WIDE, TOK)
    by = {c.text.split("\n")[0]: dict(zip(schemas.FLAGS, c.flags)) for c in children}
    assert by["| alpha | beta |"]["has_table"] and by["```"]["has_code"] and by["Note"]["has_admonition"] and by["1. steps"]["has_steps"]
    assert children[1].html == "<table><tr><td>alpha</td><td>beta</td></tr></table>"
    assert all(parents[0].flags[k] for k in (0, 1, 4, 5)) and not parents[0].flags[2]
    assert ch.html_flags(dom.parse('<span class="katex">x</span>').children[0])[2] and ch.html_flags(None) == [False] * 6


def test_token_offsets():
    ends = TOK.ends("one two  three")
    assert ends == [3, 7, 14] and token_offsets(ends, 0, 7) == (0, 2) and token_offsets(ends, 4, 99) == (1, 3) and token_offsets(ends, 9, 2) == (2, 2) and token_offsets([], 0, 5) == (0, 0)
    bpe = BytePairTokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = "Grüße 世界 and more"
    assert len(bpe.ends(text)) == bpe.count(text) and bpe.ends(text)[-1] == len(text)


def test_embedder_contract():
    e = HashingEmbedder(16)
    assert e.embed(["same"]) == e.embed(["same"]) and sum(x * x for x in e.embed(["some words"])[0]) == pytest.approx(1)

    class Short:
        dims = 4

        def embed(self, texts):
            return [[0.0] * 3 for _ in texts]

    with pytest.raises(ValueError):
        checked_embeddings(Short(), ["a"])
    assert checked_embeddings(e, []) == []


def test_chunks_of_the_test_data(spark, data):
    docs = store.prepared(pages.normalized(table(spark, data, "normalized_documents")))
    c = ch.chunks_of(docs).cache()
    md = {r.document_id: r.markdown for r in docs.collect()}
    rows = c.collect()
    assert c.schema == schemas.CHUNKS and len({r.chunk_id for r in rows}) == len(rows)
    parents = {r.chunk_id: r for r in rows if r.chunk_level == "parent"}
    for r in rows:
        assert 0 <= r.char_start < r.char_end <= len(md[r.document_id]) and 0 <= r.token_start <= r.token_end
        if r.chunk_level == "child":
            assert parents[r.parent_id].document_id == r.document_id and len(r.embedding) == 64
        else:
            assert r.parent_id is None and r.embedding is None
    exact = [r for r in rows if r.chunk_level == "child" and md[r.document_id][r.char_start : r.char_end] == r.chunk_text]
    assert len(exact) >= 0.995 * sum(r.chunk_level == "child" for r in rows)
    again = {json.dumps(r.asDict(True), default=str, sort_keys=True) for r in ch.chunks_of(docs.repartition(3)).collect()}
    assert again == {json.dumps(r.asDict(True), default=str, sort_keys=True) for r in rows}


def test_odd_documents(spark):
    docs = spark.createDataFrame([("a", None, "x", None), (None, "text", "x", 1), ("b", "", "x", 1), ("c", "# H\n\nword " * 3000, None, None)], "document_id string, markdown string, chunk_text string, depth int")
    assert {r.document_id for r in ch.chunks_of(docs).collect()} == {"c"}
    assert ch.chunks_of(docs.limit(0)).count() == 0
