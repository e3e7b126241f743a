"""HTML fragments as text a model can read, with the images they hold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.dom import Node, parse

_BLOCKS = frozenset("p div section article blockquote h1 h2 h3 h4 h5 h6 ul ol li figure figcaption header footer nav main aside".split())
_NOTE = re.compile(r"\b(admonition|warning|note|tip|caution|danger|important|hint|attention|error)\b", re.I)
#: The sign of each kind of note.
SIGNS = {"warning": "⚠️", "caution": "⚠️", "danger": "⚠️", "error": "❌", "note": "ℹ️", "tip": "💡", "hint": "💡", "important": "❗", "attention": "❗"}
#: Two-part MathML elements in LaTeX.
_PAIRS = {"mfrac": r"\frac{%s}{%s}", "msup": "%s^{%s}", "msub": "%s_{%s}"}
_MARKS = {"mover": r"\overset{%s}{%s}", "munder": r"\underset{%s}{%s}"}


@dataclass
class Converted:
    text: str
    images: list[tuple[str, str | None, str | None]] = field(default_factory=list)


def convert(html: str | None, base_url: str | None = None) -> Converted:
    """The text of a fragment and its images (url, alt, caption); nothing of null."""
    out = Converted("")
    if html:
        text = re.sub(r"\n{3,}", "\n\n", _text(parse(html), out.images, base_url))
        out.text = "\n".join(line.rstrip() for line in text.split("\n")).strip()
    return out


def _stripped(n: Node) -> str:
    """Text of an element, each part without white space around it."""
    parts: list[str] = []
    stack: list[Node | str] = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x.strip())
        else:
            stack += reversed(x.children)
    return "".join(parts)


def _text(n: Node | str, images: list, base: str | None, depth: int = 0) -> str:
    if isinstance(n, str):
        return n
    if depth > 250:
        return n.text()
    if (own := _ELEMENTS.get(n.tag)) is not None and (got := own(n, images, base)) is not None:
        return got
    inner = "".join(_text(c, images, base, depth + 1) for c in n.children)
    if n.tag == "div" and (kind := note_kind(n)):
        return f"\n\n{kind}: {inner.strip()}\n\n"
    return f"\n\n{inner.strip()}\n\n" if n.tag in _BLOCKS else inner


def note_kind(n: Node) -> str | None:
    """The label of a note by its classes, the specific one before the general; None for other elements."""
    kinds = [m[1].lower() for c in n.classes() if (m := _NOTE.search(c))]
    if not kinds:
        return None
    first = next((k for k in kinds if k != "admonition"), None)
    return f"{SIGNS[first]} {first.upper()}" if first else "NOTE"


def _table(n: Node, images: list, base: str | None) -> str:
    rows = [r for tr in n.find_all("tr") if (r := [_stripped(c) for c in tr.find_all("th", "td")])]
    if not rows:
        return n.text()
    wide = max(map(len, rows))
    rows = [r + [""] * (wide - len(r)) for r in rows]
    size = [max(3, *map(len, col)) for col in zip(*rows)]
    lines = ["| " + " | ".join(c.ljust(s) for c, s in zip(r, size)) + " |" for r in rows]
    lines.insert(1, "| " + " | ".join("-" * s for s in size) + " |")
    return "\n\n" + "\n".join(lines) + "\n\n"


def language_of(*nodes: Node | None) -> str:
    """The language a class names, of the first element that names one."""
    for n in nodes:
        for c in n.classes() if n is not None else []:
            for p in ("language-", "highlight-", "lang-"):
                if c.startswith(p):
                    return c[len(p) :]
    return ""


def _code(n: Node, images: list, base: str | None) -> str:
    inner = n.find("code")
    body = (inner or n).text().strip("\n")
    return f"\n\n```{language_of(inner, n)}\n{body}\n```\n\n"


def _math(n: Node, images: list, base: str | None) -> str:
    tex = n.attrs.get("alttext") or latex(n)
    if not tex:
        return n.text()
    return f"\n\n$${tex}$$\n\n" if n.attrs.get("display") == "block" else f"${tex}$"


def latex(n: Node | str, depth: int = 0) -> str:
    """MathML as LaTeX; unknown elements give what they hold, as does all nested deeper than 150."""
    if isinstance(n, str):
        return n.strip()
    if depth > 150:
        return n.text().strip()
    kids = [c for c in n.children if isinstance(c, Node) or c.strip()]
    if n.tag in ("mi", "mn", "mo", "mtext"):
        return _stripped(n)
    if n.tag == "mtable":
        rows = [" & ".join(latex(d, depth + 2) for d in r.children if isinstance(d, Node) and d.tag == "mtd") for r in n.children if isinstance(r, Node) and r.tag == "mtr"]
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"
    parts = [latex(c, depth + 1) for c in kids]
    if n.tag in _PAIRS and len(parts) > 1:
        return _PAIRS[n.tag] % (parts[0], parts[1])
    if n.tag in _MARKS and len(parts) > 1:
        return _MARKS[n.tag] % (parts[1], parts[0])
    if n.tag == "msubsup" and len(parts) > 2:
        return "%s_{%s}^{%s}" % tuple(parts[:3])
    inner = "".join(parts)
    return rf"\sqrt{{{inner}}}" if n.tag == "msqrt" else inner


def _terms(n: Node, images: list, base: str | None) -> str:
    return "".join(f"\n\n**{_stripped(c)}**: " if c.tag == "dt" else _stripped(c) for c in n.children if isinstance(c, Node) and c.tag in ("dt", "dd")) + "\n\n"


def _image(n: Node, images: list, base: str | None) -> str:
    src = n.attrs.get("src", "")
    if not src:
        return ""
    alt = (n.attrs.get("alt") or "").strip() or None
    caption = n.parent.find("figcaption") if n.parent is not None and n.parent.tag == "figure" else None
    try:
        url = urljoin(base, src) if base else src
    except ValueError:
        url = src
    images.append((url, alt, _stripped(caption) if caption is not None else None))
    return f"[{alt or 'image'}]"


_ELEMENTS = {
    "table": _table,
    "pre": _code,
    "code": lambda n, images, base: None if n.parent is not None and n.parent.tag == "pre" else f"`{n.text()}`",
    "math": _math,
    "dl": _terms,
    "img": _image,
    "br": lambda n, images, base: "\n",
    "hr": lambda n, images, base: "\n---\n",
}


def converted(df: DataFrame, key: str, html: str, base_url: str | None = None) -> DataFrame:
    """(key, text, images) of every row with HTML; images as structs (url, alt, caption)."""
    kind = df.schema[key].dataType.simpleString()
    arrow = pa.list_(pa.struct([("url", pa.string()), ("alt", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [convert(h, u) for h, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            images = [[dict(zip(("url", "alt", "caption"), i)) for i in c.images] for c in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.text for c in got], pa.string()), pa.array(images, arrow)], [key, "text", "images"])

    base = F.col(base_url) if base_url else F.lit(None)
    rows = df.select(key, F.col(html).cast("string").alias("h"), base.cast("string").alias("u")).where("h is not null")
    return rows.mapInArrow(run, f"{key} {kind}, text string, images array<struct<url:string,alt:string,caption:string>>")
