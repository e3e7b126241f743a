"""A small HTML tree: tokens, implied end tags, void and raw elements, broken markup tolerated.

Runs inside Arrow-batched functions; needs nothing but the standard library.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Names of elements that make a bracketed word HTML.
KNOWN = VOID | RAW | BLOCK | frozenset(
    "a abbr acronym applet b bdi bdo big blink button canvas cite code colgroup data datalist del dfn em font frame frameset head i ins kbd label map mark marquee math meter noscript object output picture progress q rp rt ruby s samp select slot small span strike strong sub sup svg template time tt u var video audio path g rect circle ref references nowiki gallery mi mn mo mrow mfrac msup msub msqrt mtext mtable mtr mtd mover munder msubsup semantics annotation".split()
)
#: A start tag on the left ends an open element on the right (up to the nearest scope element).
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    "thead": {"caption"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
#: What may stand in a head; anything else ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "legend"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>\"'<=]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]{0,4000}+\"|'[^']{0,4000}+'|[\"'])*+)(?:>|(?=<)|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """This node and all elements below it, in document order."""
        stack: list[Node] = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags and n is not self]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags and n is not self), None)

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack += reversed(n.children)
        return "".join(out)

    def markup(self) -> str:
        """The element written as HTML again."""
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, tuple):
                out.append(n[0])
            elif isinstance(n, str):
                out.append(html.escape(n, quote=False))
            else:
                attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in n.attrs.items())
                out.append(f"<{n.tag}{attrs}>")
                if n.tag not in VOID:
                    stack.append((f"</{n.tag}>",))
                    stack += reversed(n.children)
        return "".join(out)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def parse(text: str) -> Node:
    """The tree of an HTML text under a root without a name; never fails."""
    root = cur = Node("")
    pos, n = 0, len(text)

    def put(s: str, decode: bool = True) -> None:
        nonlocal cur
        if cur.tag == "head" and not s.isspace() and s:
            cur = cur.parent or root
        if s:
            s = html.unescape(s) if decode and "&" in s else s
            if cur.children and isinstance(cur.children[-1], str):
                cur.children[-1] += s
            else:
                cur.children.append(s)

    while pos < n:
        m = _TOKEN.search(text, pos)
        if m is None:
            put(text[pos:])
            break
        put(text[pos : m.start()])
        pos = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            at: Node | None = cur
            while at is not None and at.tag != name and not (at.tag == "table" and name not in ("table", "body", "html")):
                at = at.parent
            if at is not None and at.tag == name:
                cur = at.parent or root
            elif name == "br":
                cur.children.append(Node("br", None, cur))
            continue
        attrs = m["attrs"] or ""
        if cur.tag == "head" and name not in _IN_HEAD:
            cur = cur.parent or root
        elif name == "body":
            at = cur
            while at is not None and at.tag != "head":
                at = at.parent
            cur = cur if at is None else at.parent or root
        if name in _CLOSES_P:
            at = cur
            while at is not None and at.tag not in ("p", "table", "td", "th", "button", "li", "div"):
                at = at.parent
            if at is not None and at.tag == "p":
                cur = at.parent or root
        if name in _ENDS:
            scope, last, at = _SCOPE.get(name, {"table"}), None, cur
            while at is not None and at.tag not in scope:
                if at.tag in _ENDS[name]:
                    last = at
                at = at.parent
            if last is not None:
                cur = last.parent or root
        node = Node(name, attributes(attrs.rstrip("/")), cur)
        cur.children.append(node)
        if name in VOID or (attrs.endswith("/") and name not in BLOCK):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(text, pos)
            raw, pos = (text[pos : end.start()], end.end()) if end else (text[pos:], n)
            if raw:
                node.children.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            continue
        cur = node
    return root
