"""Problem 4: clean text from HTML, Markdown, wiki and LaTeX markup.

HTML goes through a tree builder with implied end tags; what is visible is laid
out as text: blocks apart, headings, lists, code and formulas marked as in
Markdown, table cells aligned. In Markdown, code and formulas are set aside,
markup of other kinds is turned into Markdown or dropped, and each kind that
was found is reported; that report is what tells residue.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.dom import BLOCK, KNOWN, VOID, Node, attributes, parse

_FENCE = re.compile(r"^[ \t]{0,3}(?P<f>`{3,}|~{3,})[^\n]*(?:\n|\Z)(?:.*?^[ \t]{0,3}(?P=f)[`~]*[ \t]*$|.*\Z)", re.M | re.S)
_INLINE = re.compile(r"(?<!`)(`{1,2})(?!`)[^\n]*?[^`\n]\1(?!`)")
_FORMULA = re.compile(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<![\\$\w])\$(?=[^\s$])(?:[^$\n]*?[^\s\\$])?\$(?![\d$])", re.S)
_PLACEHOLDER = re.compile(r"\{\{\{?\s*[\w.\-]+\s*\}?\}\}|\{%[^%\n]*%\}|<%[^%\n]*%>|[$#]\{[^{}\n]*\}|<<[^<>\n]+>>")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!(?:doctype|\[CDATA\[)[^>]*>?", re.S | re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)((?:\s(?:[^<>\"'\n]|\"[^\"\n]*\"|'[^'\n]*')*)?/?)(>|(?=\s*(?:\n|\Z|<))|(?<=\")(?=\s))")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_WIKI = (
    ("wiki", re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M), lambda m: "#" * len(m[1]) + " " + m[2]),
    ("wiki", re.compile(r"'''''(.+?)'''''|'''(.+?)'''"), lambda m: f"***{m[1]}***" if m[1] else f"**{m[2]}**"),
    ("wiki", re.compile(r"(?<!['\w])''([^'\n]+)''(?!['\w])"), lambda m: f"*{m[1]}*"),
    ("wiki", re.compile(r"\[\[(?:(?:File|Image|Category|Datei|Bild):[^\[\]\n]*\|)?:?((?=[^\W\d])[^\[\]\n|]*)(?:\|([^\[\]\n]*))?\]\](?!\()"), lambda m: m[1] if m[2] is None else m[2]),
    ("wiki", re.compile(r"\{\{(?:[A-Za-z][^{}|\n]*\|[^{}]*|(?:Infobox|Cite|Citation|Main|See also)[^{}]*)\}\}"), lambda m: " ".join(p.split("=", 1)[-1].strip() for p in m[0][2:-2].split("|")[1:])),
    ("wiki", re.compile(r"^\{\|.*?(?:^\|\}[ \t]*$|\Z)", re.M | re.S), lambda m: _wiki_table(m[0])),
    ("wiki", re.compile(r"^\|\}[ \t]*$|__(?:NO)?TOC__|~{4}", re.M), lambda m: ""),
)
_LATEX = (
    ("latex", re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}"), lambda m: "## " + m[1]),
    ("latex", re.compile(r"\\(?:textbf|mathbf|bf)\{([^{}]*)\}"), lambda m: f"**{m[1]}**"),
    ("latex", re.compile(r"\\(?:emph|textit|it)\{([^{}]*)\}"), lambda m: f"*{m[1]}*"),
    ("latex", re.compile(r"\\href\{([^{}]*)\}\{([^{}]*)\}"), lambda m: f"[{m[2]}]({m[1]})"),
    ("latex", re.compile(r"\\(?:texttt|verb)\{([^{}]*)\}"), lambda m: f"`{m[1]}`"),
    ("latex", re.compile(r"[ \t]*\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?[ \t]*\n?"), lambda m: ""),
    ("latex", re.compile(r"^[ \t]*\\item\b[ \t]*", re.M), lambda m: "- "),
    ("latex", re.compile(r"~?\\(?:cite|ref|label|eqref|footnote|url)[a-z]*\*?(?:\[[^\]\n]*\])*\{([^{}]*)\}"), lambda m: f" ({m[1]})"),
    ("latex", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{([^{}]*)\}"), lambda m: m[1]),
    ("latex", re.compile(r"(?<![\w:\\./])\\[A-Za-z]{2,}(?![\w\\{])"), lambda m: ""),
)


def without_code(text: str) -> tuple[str, int]:
    """Markdown without code blocks, inline code and formulas, and how many characters they had."""
    gone = 0

    def drop(m: re.Match[str]) -> str:
        nonlocal gone
        gone += len(m.group())
        return " "

    for marks, pattern in (("`~", _FENCE), ("`", _INLINE), ("$\\", _FORMULA)):
        if any(c in text for c in marks):
            text = pattern.sub(drop, text)
    return text, gone


def _set_aside(text: str) -> tuple[str, list[str]]:
    """Code, formulas and placeholders as numbered signs, and what they stand for."""
    held: list[str] = []

    def keep(m: re.Match[str]) -> str:
        held.append(m.group())
        return f"\ue000{len(held) - 1}\ue001"

    text = text.replace("\ue000", "").replace("\ue001", "")
    for marks, pattern in (("`~", _FENCE), ("`", _INLINE), ("$\\", _FORMULA), ("{%<", _PLACEHOLDER)):
        if any(c in text for c in marks):
            text = pattern.sub(keep, text)
    return text, held


def _put_back(text: str, held: list[str]) -> str:
    sign = re.compile("\ue000(\\d+)\ue001")
    while sign.search(text):
        text = sign.sub(lambda m: held[int(m[1])], text)
    return text


def _wiki_table(block: str) -> str:
    rows: list[list[str]] = []
    cells: list[str] = []
    for line in block.split("\n")[1:]:
        line = line.strip()
        if line.startswith(("|-", "|}")):
            if cells:
                rows.append(cells)
            cells = []
        elif line[:1] in "|!" and line and not line.startswith("|+"):
            cells += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
        elif cells and line:
            cells[-1] += " " + line
    if cells:
        rows.append(cells)
    return table_text(rows) + "\n"


def table_text(rows: list[list[str]]) -> str:
    """Rows of cells as a table whose columns are aligned; the first row is the head."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    size = [max(3, *(len(r[i]) for r in rows)) for i in range(width)]
    line = lambda r: "| " + " | ".join(c.ljust(s) for c, s in zip(r, size)) + " |"
    return "\n".join([line(rows[0]), "|" + "|".join("-" * (s + 2) for s in size) + "|", *map(line, rows[1:])])


def _pairs(text: str) -> list[tuple[int, int, int, int, str]]:
    """(start, inner start, inner end, end, name) of the HTML elements of a text that have both tags, by start; tags without a partner are left out."""
    open_: list[tuple[str, int, int]] = []
    out = []
    for m in _TAG.finditer(text):
        name = m[2].lower()
        if name not in KNOWN or name in VOID or m[3].endswith("/"):
            continue
        if not m[1]:
            open_.append((name, m.start(), m.end()))
            continue
        at = next((i for i in range(len(open_) - 1, max(-1, len(open_) - 65), -1) if open_[i][0] == name), None)
        if at is not None:
            out.append((open_[at][1], open_[at][2], m.start(), m.end(), name))
            del open_[at:]
    return sorted(out)


def _elements(text: str, kinds: set[str]) -> str:
    """A text whose HTML elements went through the tree; one that spans paragraphs of Markdown only loses its own tags, unless it isn't visible."""
    out, pos = [], 0
    for start, inner, inner_end, end, name in _pairs(text):
        if start < pos:
            continue
        node = Node(name, attributes(text[start + 1 + len(name) : inner - 1].rstrip("/")))
        if _visible(node) and name != "table" and "\n\n" in text[inner:inner_end]:
            continue
        whole = text[start:end]
        kinds.add("html")
        kinds.update(k for k, p in (("comment", _COMMENT), ("entity", _ENTITY)) if p.search(whole))
        out.append(text[pos:start])
        if _visible(node):
            tree = _shallow(parse(whole))
            block = any(x.tag in BLOCK for x in tree.walk() if x is not tree)
            out.append("\n\n" + _laid_out(tree) + "\n\n" if block else "".join(_inline(c) for c in tree.children))
        pos = end
    return "".join((*out, text[pos:]))


def _foreign(text: str, in_markdown: bool = True) -> tuple[str, set[str]]:
    """A text without code with its HTML, wiki and LaTeX markup turned into Markdown, and the kinds found."""
    kinds: set[str] = set()

    def change(kind: str, pattern: re.Pattern[str], to: Callable[[re.Match[str]], str], s: str) -> str:
        def one(m: re.Match[str]) -> str:
            kinds.add(kind)
            return to(m)

        return pattern.sub(one, s)

    if "<" in text:
        text = _elements(text, kinds) if in_markdown and "</" in text else text
        text = change("comment", _COMMENT, lambda m: "", text)

        def tag(m: re.Match[str]) -> str:
            name = m[2].lower()
            if name not in KNOWN and "-" not in name:
                return m[0]
            kinds.add("html")
            if name in ("br", "hr", "tr", "li", "p", "div", "table", "ul", "ol"):
                return "\n- " if name == "li" and not m[1] else "\n"
            if name in ("td", "th"):
                return " " if m[1] else "| "
            return {"b": "**", "strong": "**", "i": "*", "em": "*", "sup": "" if m[1] else "^", "sub": "" if m[1] else "_"}.get(name, "")

        text = _TAG.sub(tag, text)
    if "&" in text:

        def entity(m: re.Match[str]) -> str:
            if m[1] and m[1] + ";" not in html.entities.html5:
                return m[0]
            kinds.add("entity")
            return html.unescape(html.unescape(m[0]))

        once = _ENTITY.sub(entity, text)
        if once != text:  # what was escaped twice
            text = _TAG.sub(lambda m: "" if m[2].lower() in KNOWN else m[0], _ENTITY.sub(entity, once))
    if any(c in text for c in ("''", "[[", "{{", "{|", "|}", "==", "__", "~~~~")):
        for kind, pattern, to in _WIKI:
            text = change(kind, pattern, to, text)
    if "\\" in text:
        for kind, pattern, to in _LATEX:
            text = change(kind, pattern, to, text)
    return text, kinds


def clean_markdown(markdown: str) -> tuple[str, list[str]]:
    """Markdown with only Markdown left, and the other kinds of markup it had: comment, entity, html, latex, wiki."""
    text, held = _set_aside(markdown)
    text, kinds = _foreign(text)
    if kinds:
        text = re.sub(r"[ \t\xa0]+\n", "\n", re.sub(r"\n{3,}", "\n\n", text))
    return _put_back(text, held), sorted(kinds)


_MARKDOWN = re.compile(
    r"(?<![\w*])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![\w*])|(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w_])__?(?=[^\W_])[^_\n]+?(?<=[^\W_])__?(?![\w_])"
    r"|!?\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|^[ \t]{0,3}#{1,6}[ \t]+\S|^[ \t]{0,3}(?:```|~~~)|(?<!`)`[^`\n]+`(?!`)|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|"
    r"|^[ \t]{0,3}[-*+][ \t]+\S|^[ \t]{0,3}>[ \t]+\S|~~\S[^~\n]*~~",
    re.M,
)

_HIDDEN = frozenset("script style template head noscript iframe object svg datalist meta link".split())


def _visible(n: Node) -> bool:
    if n.tag in _HIDDEN or "hidden" in n.attrs:
        return False
    style = n.attrs.get("style")
    return not (style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style, re.I))


def clean_html(fragment: str) -> tuple[str, list[str]]:
    """HTML as text, from one tree, and the kinds of markup that its text still has outside code elements once tags and entities are gone."""
    root = parse(fragment)
    plain: list[str] = []
    _plain(root, plain)
    left = "".join(plain)
    _, kinds = _foreign(left, in_markdown=False)
    if "$" in left and _FORMULA.search(left):
        kinds.add("latex")
    if _MARKDOWN.search(left):
        kinds.add("markdown")
    return _laid_out(_shallow(root)), sorted(kinds)


_CODE = frozenset(("code", "pre", "kbd", "samp", "tt", "xmp", "script", "style"))


def _plain(n: Node, out: list[str]) -> None:
    """Text outside code elements; a block begins a line."""
    stack: list[Node | str] = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in _CODE:
            out.append(" ")
        else:
            if x.tag in BLOCK or x.tag == "br":
                stack.append("\n")
                out.append("\n")
            stack += reversed(x.children)


#: Nesting that is laid out; what is nested deeper stands at this level, with all its text and blocks.
DEPTH = 100


def _shallow(root: Node) -> Node:
    """The tree without what isn't visible and without nesting below ``DEPTH``: deeper elements become siblings of their ancestors."""
    top = Node(root.tag, root.attrs)
    stack: list[tuple[Node | str, Node, int]] = [(c, top, 1) for c in reversed(root.children)]
    while stack:
        x, parent, depth = stack.pop()
        if isinstance(x, str):
            parent.children.append(x)
        elif _visible(x):
            copy = Node(x.tag, x.attrs, parent)
            parent.children.append(copy)
            into = copy if depth < DEPTH else parent
            stack += [(c, into, depth + (into is copy)) for c in reversed(x.children)]
    return top


def _laid_out(tree: Node) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(_block(tree, 0)))).strip()


def render(fragment: str) -> str:
    """HTML as text: everything visible, blocks a blank line apart, structure as in Markdown."""
    return _laid_out(_shallow(parse(fragment)))


def _inline(n: Node | str) -> str:
    if isinstance(n, str):
        return re.sub(r"[ \t\n\r\f]+", " ", n)
    if not _visible(n):
        return ""
    if n.tag == "br":
        return "\n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})"
    if n.tag in ("code", "kbd", "samp", "tt"):
        s = n.text()
        return f"`{s.strip()}`" if s.strip() else ""
    if n.tag == "math":
        s = n.attrs.get("alttext") or re.sub(r"\s+", " ", n.text()).strip()
        return f"${s}$" if s else ""
    s = "".join(_inline(c) for c in n.children)
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}.get(n.tag)
    if mark and s.strip():
        return s[: len(s) - len(s.lstrip())] + mark + s.strip() + mark + s[len(s.rstrip()) :]
    return ("^" + s if n.tag == "sup" else "_" + s if n.tag == "sub" else s) if s else ""


def _wrapped(children: list[Node | str]) -> Node:
    n = Node("div")
    n.children = children
    return n


def _items(n: Node, tags: tuple[str, ...]) -> Iterator[Node]:
    """The visible items of a list; what stands between them (text, other elements) is an item of its own."""
    run: list[Node | str] = []
    for c in [*n.children, None]:
        if isinstance(c, str) or (c is not None and c.tag not in BLOCK):
            run.append(c)
            continue
        if any(x.strip() if isinstance(x, str) else _visible(x) for x in run):
            yield _wrapped(run)
        run = []
        if c is not None and _visible(c):
            yield c if c.tag in (*tags, "ul", "ol", "menu") else _wrapped([c])


def _table_parts(n: Node) -> tuple[list[Node], list[list[Node]], Node]:
    """Captions, rows of cells, and an element with all else a table holds outside its cells; tables inside cells stay there."""
    captions: list[Node] = []
    rows: list[list[Node]] = [[]]
    stray: list[Node | str] = []
    stack: list[Node | str] = list(reversed(n.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            stray.append(x)
        elif x.tag in ("td", "th"):
            rows[-1].append(x)
        elif not _visible(x):
            continue
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag in ("tr", "tbody", "thead", "tfoot") or (x.tag != "table" and any(y.tag in ("tr", "td", "th") for y in x.walk()) and x.find("table") is None):
            if x.tag in ("tr", "tbody", "thead", "tfoot"):
                rows.append([])
            stack += reversed(x.children)
        else:
            stray.append(x)
    return captions, rows, _wrapped(stray)


def _block(n: Node, depth: int) -> Iterator[str]:
    """The parts of a block element; runs of inline children become one paragraph."""
    run: list[str] = []

    def flush() -> Iterator[str]:
        s = re.sub(r" *\n *", "\n", "".join(run)).strip()
        run.clear()
        if s:
            yield s + "\n\n"

    for c in n.children:
        if isinstance(c, str) or (c.tag not in BLOCK and not any(x.tag in BLOCK for x in c.walk())):
            run.append(_inline(c))
            continue
        if not _visible(c):
            continue
        yield from flush()
        if c.tag[:1] == "h" and c.tag[1:].isdigit():
            s = re.sub(r"\s+", " ", "".join(_inline(x) for x in c.children)).strip()
            yield f"{'#' * int(c.tag[1:])} {s}\n\n" if s else ""
        elif c.tag == "pre":
            inner = c.find("code")
            lang = next((x.split("-", 1)[1] for x in (inner or c).classes() if x.startswith(("language-", "lang-", "highlight-"))), "")
            yield f"```{lang}\n{c.text().strip(chr(10))}\n```\n\n"
        elif c.tag in ("ul", "ol", "menu"):
            start = int(c.attrs["start"]) if c.attrs.get("start", "").isdigit() else 1
            for i, item in enumerate(_items(c, ("li",))):
                mark = f"{start + i}. " if c.tag == "ol" else "- "
                body = "".join(_block(item, depth + 1)).strip()
                yield mark + re.sub(r"\n+", "\n" + " " * len(mark), body) + "\n"
            yield "\n"
        elif c.tag == "table":
            captions, cells, stray = _table_parts(c)
            for x in captions:
                yield "".join(_block(x, depth + 1))
            rows = [[re.sub(r"\s+", " ", "".join(_block(x, depth + 1))).strip() for x in r] for r in cells]
            yield table_text(rows) + "\n\n"
            yield from _block(stray, depth + 1)
        elif c.tag == "dl":
            for x in _items(c, ("dt", "dd", "div")):
                s = "".join(_block(x, depth + 1)).strip()
                yield (f"**{s}**\n" if x.tag == "dt" else f": {s}\n") if s else ""
            yield "\n"
        elif c.tag == "blockquote":
            s = "".join(_block(c, depth + 1)).strip()
            yield "".join(f"> {x}\n" for x in s.split("\n")) + "\n" if s else ""
        elif c.tag == "hr":
            yield "---\n\n"
        else:
            yield from _block(c, depth + 1)
    yield from flush()


def items(documents: DataFrame, chunks: DataFrame, pages: bool = False) -> DataFrame:
    """(field, item_key, text) of the markup fields; ``pages`` adds the pages' own HTML. A chunk delivered twice is one item."""
    docs = documents.select(F.lit("markdown").alias("field"), F.col("fetch_id").cast("string").alias("item_key"), F.col("markdown").alias("text"))
    if pages:
        docs = docs.unionByName(documents.select(F.lit("html").alias("field"), F.col("fetch_id").cast("string").alias("item_key"), F.col("html").alias("text")))
    parts = chunks.select(F.lit("html_text").alias("field"), F.col("chunk_id").alias("item_key"), F.col("html_text").alias("text"))
    return docs.unionByName(parts).where("text is not null and item_key is not null")


def cleaned(fields: DataFrame) -> DataFrame:
    """(field, item_key, residue, text): clean text of items (field, item_key, text) and the kinds of markup the renderer met in them.

    ``markdown`` is taken as Markdown, other fields as HTML. Null texts have no
    row, empty ones an empty text. Whole texts are read; what can't be parsed
    stays as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [clean_markdown(text) if field == "markdown" else clean_html(text) for field, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k for _, k in got], pa.list_(pa.string())), pa.array([t for t, _ in got], pa.string())], ["field", "item_key", "residue", "text"])

    return fields.select("field", "item_key", "text").mapInArrow(run, "field string, item_key string, residue array<string>, text string")


def found(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """p4_found: items in which the renderer met markup of another kind than their own."""
    return cleaned(items(documents, chunks)).where(F.size("residue") > 0).select("field", "item_key").distinct()
