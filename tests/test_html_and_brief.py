import pytest

from corvane.config import EngineConfig
from corvane.functions import brief as b
from corvane.functions.dom import parse
from corvane.functions.html_text import convert, converted


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>Hello <b>world</b></p>", "Hello world"),
        ("<table><tr><th>Name</th><th>V</th></tr><tr><td>alpha</td></tr></table>", "| Name  | V   |\n| ----- | --- |\n| alpha |     |"),
        ("<table></table>", ""),
        ('<pre><code class="language-python">x = 1\n</code></pre>', "```python\nx = 1\n```"),
        ('<pre class="highlight-js">y</pre>', "```js\ny\n```"),
        ("use <code>x</code> now", "use `x` now"),
        ('<math alttext="x^2 + y^2"></math>', "$x^2 + y^2$"),
        ('<math display="block" alttext="a"></math>', "$$a$$"),
        ("<math><mfrac><mi>a</mi><mi>b</mi></mfrac></math>", r"$\frac{a}{b}$"),
        ("<math><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><msub><mi>y</mi><mn>1</mn></msub></math>", "$x^{2}+y_{1}$"),
        ("<math><msqrt><mi>z</mi></msqrt><munder><mi>a</mi><mi>b</mi></munder></math>", r"$\sqrt{z}\underset{b}{a}$"),
        ("<math><mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr></mtable></math>", r"$\begin{matrix}a & b\end{matrix}$"),
        ("<dl><dt>Term</dt><dd>Meaning</dd><dt>T2</dt><dd>M2</dd></dl>", "**Term**: Meaning\n\n**T2**: M2"),
        ('<div class="admonition warning"><p>Careful</p></div>', "⚠️ WARNING: Careful"),
        ('<div class="admonition"><p>Read</p></div>', "NOTE: Read"),
        ('<div class="plain">x</div>', "x"),
        ("a<br>b<hr>c", "a\nb\n---\nc"),
        ("<p>one<p>two<ul><li>x<li>y</ul>", "one\n\ntwo\n\nx\n\ny"),
    ],
)
def test_conversion(html, text):
    assert convert(html).text == text


def test_images():
    got = convert('<figure><img src="/i.png" alt="Pic"><figcaption>Cap</figcaption></figure><img alt="no source"><img src="x.png">', "https://a.example/d/p.html")
    assert got.images == [("https://a.example/i.png", "Pic", "Cap"), ("https://a.example/d/x.png", None, None)] and "[Pic]" in got.text and "[image]" in got.text


def test_tree_tolerates_anything():
    assert parse("<div><p>a</div>b").text() == "ab" and parse("<b <i>x").text() == "x" and parse("").children == []
    assert parse('<a href="x>y">z</a>').find("a").attrs == {"href": "x>y"}
    assert parse("<script>a < b</script>c").text() == "c" and convert(None).text == ""
    assert convert("<div>" * 2000 + "deep").text == "deep"
    n = parse('<p class="x y">a &lt; b<br></p>').children[0]
    assert n.markup() == '<p class="x y">a &lt; b<br></p>' and n.classes() == ["x", "y"]


def test_converted_table(spark):
    df = spark.createDataFrame([("a", "<p>x</p>", "u", "clash"), ("b", None, None, ""), ("c", "", None, "")], "chunk_id string, html string, url string, text string")
    assert {(r.chunk_id, r.text) for r in converted(df, "chunk_id", "html", "url").collect()} == {("a", "x"), ("c", "")}
    assert converted(df.limit(0), "chunk_id", "html").count() == 0


def chunk(i, score=0.5, url="https://a.example/p", **more):
    return {"chunk_id": f"c{i}", "score": score, "source_url": url, "title": "T", "section_heading": "## S", "selected_text": f"text number {i}", "surface": "markdown", "confidence": None, "source_sub_query": None} | more


def test_brief_sections_and_order():
    rows = [chunk(1, 0.4), chunk(2, 0.9, "https://b.example/q", confidence=0.8, source_sub_query="sub"), chunk(3, 0.1, selected_text="text number 1", is_locality_expanded=True)]
    a = b.Answer("q", rows, [r | {"verbatim_text": "x" * 400} for r in rows], mode="full_context", stop_reason="done", documents=2, parents=9, matched=["u"])
    t = b.brief(a)
    assert [t.index(s) for s in ("[SOURCES]", "[EVIDENCE]", "[CITATIONS]", "[STATS]")] == sorted(t.index(s) for s in ("[SOURCES]", "[EVIDENCE]", "[CITATIONS]", "[STATS]"))
    assert "[1] T — https://a.example/p\n    § ## S" in t and "[2] T — https://b.example/q" in t
    assert t.index("relevance: 0.90, confidence: 0.80") < t.index("relevance: 0.40") and '[sub-query: "sub"]' in t and t.count("text number 1") == 1
    assert '[1] "' + "x" * 297 + '..."' in t and '[2] "' not in t and "Retrieval: full_context" in t and "no links were followed" in t


def test_evidence_stops_at_the_budget():
    rows = [chunk(i, 1 - i / 10, selected_text="w " * 50) for i in range(1)] + [chunk(i, 0.5 - i / 10) for i in range(1, 4)]
    text, _, _ = b.evidence(rows, 30, lambda t: len(t.split()))
    assert "0 of 4 passages are given, 4 are left out" in text
    assert b.evidence([], 10, len)[0].endswith("(no evidence chunks)") and b.sources([]) == "[SOURCES]\n(none)"


def test_trace():
    s = "https://a.example/d/"
    steps = [b.Step(s + "seed", 1, 2, [s + "x", s + "y"], [s + "bad"]), b.Step(s + "x", 2, 1, [s + "z"], [], "enough")]
    assert b.trace(steps) == "[EXPANSION TRACE]\nBase: https://a.example/d/\n\n/seed (seed)\n    ├── /x (depth 1, +2 chunks)\n    │   └── /z (depth 2, +1 chunks, [ended: enough])\n    ├── /y (depth 1, +2 chunks)\n    └── /bad (depth 1, failed)"
    assert b.trace([]) == "" and b.url_prefix([s + "only"]) == s and b.url_prefix(["https://a.example/x", "ftp://b"]) == ""
    a = b.Answer("q", [chunk(1)], steps=[b.Step("u", 5, reason="r")], iterations=5)
    assert "deepest level allowed, 5" in b.stats(a, EngineConfig())
