import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import markup as m


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("a <b>bold</b> word", ["html"]), ("broken <div id=\"x\"\nnext", ["html"]), ("cell <td>x</td>", ["html"]), ("x<!-- note -->y", ["comment"]), ("a&nbsp;b and &#8217;", ["entity"]),
        ("see [[Page|here]]", ["wiki"]), ("'''strong''' words", ["wiki"]), ("== Title ==\ntext", ["wiki"]), ("{| class=\"w\"\n|-\n| a || b\n|}", ["wiki"]), ("x<ref>n 1</ref>", ["html"]),
        ("\\section{One}", ["latex"]), ("das\\cite{key1}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), ("\\href{https://a.example}{t}", ["latex"]),
        ("plain *Markdown* [l](u) ![i](s)\n\n| a | b |\n|---|---|\n\n> q\n\n- x", []), ("`<b>` and `\\emph{x}`", []), ("```html\n<div>&nbsp;</div>\n```", []), ("$\\frac{a}{b}$ and $$\\sum_{i}$$", []),
        ("lives in C:\\halzi\\new\\encoder.", []), ("R&D and AT&T", []), ("a < b and 3 > 2", []), ("As a matrix, x is [[9, 2], [4, 2]].", []), ("{{ name.first }} and ${HOME} and {% block x %}", []), ("<https://a.example/x>", []),
    ],
)
def test_residue_in_markdown(text, kinds):
    assert m.clean_markdown(text)[1] == kinds


def test_markdown_is_turned_into_clean_markdown():
    text = "== Title ==\nA <b>bold</b> &amp; '''strong''' [[Page|link]]. Keep `<b>` and $\\frac{a}{b}$.\n\\section{Two}\n\\item one\nx<!-- gone -->y"
    got, _ = m.clean_markdown(text)
    assert got == "## Title\nA **bold** & **strong** link. Keep `<b>` and $\\frac{a}{b}$.\n## Two\n- one\nxy"
    assert m.clean_markdown(got) == (got, [])


@pytest.mark.parametrize("html, kinds", [("<p>a</p>", []), ("<p>&lt;b&gt;x&lt;/b&gt;</p>", ["html"]), ("<pre><code>&lt;b&gt; **x**</code></pre>", []), ("<p>&amp;nbsp;x</p>", ["entity"]), ("<div>**x** y</div>", ["markdown"]), ("<p>'''x''' y</p>", ["wiki"]), ("<p>\\begin{center}x\\end{center}</p>", ["latex"]), ("<math alttext='\\frac{a}{b}'><mi>a</mi></math>", [])])
def test_residue_in_html(html, kinds):
    assert m.clean_html(html)[1] == kinds


def test_rendering_keeps_structure():
    html = "<h2>Head</h2><p>One <b>two</b><p>Three<ul><li>a<li>b</ul><table><tr><th>K<th>Value<tr><td>x<td>yy</table><pre><code class='language-py'>a\n  b</code></pre><math alttext='x^2'></math><script>no</script><div style='display: none'>no</div>"
    assert m.render(html) == "## Head\n\nOne **two**\n\nThree\n\n- a\n- b\n\n| K   | Value |\n|-----|-------|\n| x   | yy    |\n\n```py\na\n  b\n```\n\n$x^2$"


def test_broken_and_deep_html():
    assert "text" in m.render("<div><p>text<b") and m.render("") == ""
    assert m.render("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert m.render("a" * 10**6) == "a" * 10**6


def test_table(spark):
    docs = spark.createDataFrame([(1, "a <b>x</b>", "<p>h", "clash"), (2, None, None, ""), (3, "", "", "")], "fetch_id bigint, markdown string, html string, field string")
    chunks = spark.createDataFrame([("c", "<p>&lt;i&gt;</p>", 1), ("c", "<p>&lt;i&gt;</p>", 1), ("n", None, 1), (None, "<p>", 1)], "chunk_id string, html_text string, text int")
    assert {tuple(r) for r in m.found(docs, chunks).collect()} == {("markdown", "1"), ("html_text", "c")}
    assert m.found(docs.limit(0), chunks.limit(0)).count() == 0
    assert {(r.field, r.item_key, r.text) for r in m.cleaned(m.items(docs, chunks.limit(0), pages=True)).collect()} == {("markdown", "1", "a **x**"), ("markdown", "3", ""), ("html", "1", "h"), ("html", "3", "")}


@pytest.mark.parametrize(
    "html",
    [
        "<table><tr><td>one<td>two</tr><p>three</p><div>four <b>five</b></div><h2>six</h2>", "<table>one<tr>two<td>three</td>four<p>five</p></tr><tbody>six<tr><td>seven</table>eight",
        "<html><head><title>T</title><body><p>one</p>two</body></html>", "<html><head><meta charset=x><p>one<p>two", "<head><title>T</title>one<p>two", "<ul>one<li>two</li>three <b>four</b><p>five</p></ul>six",
        "<ol>one<li>two</ol><dl>three<dt>four<dd>five</dd>six<p>seven</p></dl>", "<table><form><tr><td>one</td></tr></form><tr><td><table><tr><td>two</td></tr></table></td></tr></table>three",
    ],
)
def test_no_visible_word_of_broken_pages_is_lost(html):
    words = "one two three four five six seven eight".split()
    text = m.render(html)
    assert [text.count(w) for w in words] == [html.count(w) for w in words]


def test_long_inline_formulas_are_set_aside():
    text = "So $" + " + ".join(f"\\frac{{a_{i}}}{{b}}" for i in range(60)) + "$ holds."
    assert m.clean_markdown(text) == (text, []) and m.without_code(text)[0] == "So   holds."


def test_html_in_markdown_goes_through_the_tree():
    got, kinds = m.clean_markdown('Before.\n\n<div style="display:none">secret</div> <script>x()</script>\n\n<table><tr><th>K</th><th>Value</th></tr><tr><td>x</td><td>yy</td></tr></table>\n\nAfter.')
    assert kinds == ["html"] and "secret" not in got and "x()" not in got
    assert "| K   | Value |\n|-----|-------|\n| x   | yy    |" in got and got.startswith("Before.") and got.endswith("After.")
    got, _ = m.clean_markdown("<div>\n\nOne **two**.\n\n- <b>three</b>\n\n</div>\n\n<ul><li>four</li><li>five</li></ul>")
    assert "One **two**." in got and "- **three**" in got and "- four\n- five" in got and "<" not in got


@pytest.mark.parametrize("tag, n", [("span", 1500), ("b", 1200), ("div", 5000), ("ul", 2000), ("table", 500), ("blockquote", 1500), ("mrow", 1500)])
def test_deep_nesting_keeps_text_and_visibility(tag, n):
    html = f"<{tag}>" * n + "deep<i hidden>secret</i><p>end</p>" + f"</{tag}>" * n
    for got in (m.render(html), m.clean_html(html)[0], m.clean_markdown(html)[0]):
        assert "deep" in got and "end" in got and "secret" not in got


def test_nested_tables_come_once():
    got = m.render("<table><tr><td>a<table><tr><td>inner</td></tr></table></td><td>b</td></tr></table>")
    assert got.count("inner") == 1 and got.count("a") >= 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/abpdivtrliul &;\"'=\n*_[]{}|\\$`")), max_size=120))
def test_never_fails(text):
    for f in (m.clean_html, m.clean_markdown):
        out, kinds = f(text)
        assert isinstance(out, str) and kinds == sorted(set(kinds))
