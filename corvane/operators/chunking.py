"""Markdown into parents and children with exact spans, flags, HTML snippets and images.

A document is cut by spans: sections, blocks of paragraphs inside them, parents
as runs of blocks, children as pieces of blocks. This happens inside one
Arrow-batched function, because packing and splitting hang on token counts of
texts that are made on the way; documents are independent, so nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corvane import schemas
from corvane.config import EngineConfig
from corvane.functions import dom
from corvane.functions.providers import Embedder, HashingEmbedder, Tokenizer, WordTokenizer, checked_embeddings, token_offsets

#: What marks headings, tables, admonitions, steps, images and rich elements.
_H2 = re.compile(r"(?m)^##\s+.+$")
_H1 = re.compile(r"(?m)^#\s+.+$")
_GAP = re.compile(r"\n\s*\n+")
_TABLE = re.compile(r"(?m)^\|.+\|\s*$")
_NOTE = re.compile(r"(?im)^(?:note|warning|important|tip|caution|danger|info|success|example|see also|deprecated since)\s*$")
_STEP = re.compile(r"(?m)^\s*\d+[.)]\s+")
_IMAGE = re.compile(r'!\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)')
_WORD = re.compile(r"\w+")
_NOTE_CLASS = re.compile(r"admonition|note|warning|tip|important|caution|danger|info", re.I)
_MATH_CLASS = re.compile(r"mathjax|katex|^math$", re.I)
_PLAIN = ((re.compile(r"`{1,3}"), " "), (re.compile(r"\[(.*?)\]\((.*?)\)"), r"\1"), (re.compile(r"!\[(.*?)\]\((.*?)\)"), r"\1"), (re.compile(r"[*_>#|\\-]+"), " "), (re.compile(r"\s+"), " "))
#: Elements that a chunk is matched with, in the order in which equal matches win.
CANDIDATES = ("section", "article", "div", "p", "li", "table", "pre", "code", "dl", "blockquote")
#: Children of a document without headings that make one parent.
GROUP = 4

Image = tuple[str, "str | None", "str | None", "str | None"]


@dataclass
class Piece:
    """A parent or a child: its text, where it stands, and what it holds."""

    text: str
    start: int
    end: int
    heading: str | None = None
    index: int = 0
    parent: int | None = None
    flags: list[bool] = field(default_factory=lambda: [False] * 6)
    html: str | None = None
    images: list[Image] = field(default_factory=list)
    context: str | None = None
    block_starts: list[int] = field(default_factory=list)


def sections(markdown: str) -> list[tuple[str | None, int, int]]:
    """(heading, start, end): from each ``##`` to the next; without those from each ``#``; else the whole. What stands before the first heading belongs to none."""
    heads = list(_H2.finditer(markdown)) or list(_H1.finditer(markdown))
    if not heads:
        return [(None, 0, len(markdown))]
    ends = [h.start() for h in heads[1:]] + [len(markdown)]
    return [(h.group().strip(), h.start(), e) for h, e in zip(heads, ends)]


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines that hold more than white space."""
    cuts = [0, *(x for m in _GAP.finditer(text) for x in m.span()), len(text)]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if text[a:b].strip()]


def pieces(text: str, most: int, count: Callable[[str], int]) -> list[str]:
    """A text in pieces of at most ``most`` tokens: at blank lines, then line ends, sentence ends and spaces, each only where a piece is still too long. Pieces aren't joined again."""
    done, todo = [], [(text, 0)]
    while todo:
        t, level = todo.pop()
        if count(t) <= most or level == 4:
            if t.strip():
                done.append(t)
            continue
        sep = ("\n\n", "\n", ". ", " ")[level]
        parts = t.split(sep)
        if len(parts) > 1:
            kept = [p + sep for p in parts[:-1]] + parts[-1:]
            todo += [(k, level + 1) for k in reversed([p.strip() for p in kept]) if k]
        else:
            todo.append((t, level + 1))
    return done


def parents_of(markdown: str, most: int, count: Callable[[str], int]) -> list[Piece]:
    """Runs of a section's blocks of at most ``most`` tokens; a block that is longer is a parent of its own."""
    out: list[Piece] = []
    for heading, lo, hi in sections(markdown):
        run: list[tuple[int, int]] = []

        def close() -> None:
            if run:
                lead = markdown[slice(*run[0])]
                starts = [run[0][0] + len(lead) - len(lead.lstrip()), *(a for a, _ in run[1:])]
                out.append(Piece("\n\n".join(markdown[a:b] for a, b in run).strip(), run[0][0], run[-1][1], heading, len(out), block_starts=starts))
                run.clear()

        for a, b in ((lo + x, lo + y) for x, y in blocks(markdown[lo:hi])):
            if run and count("\n\n".join(markdown[x:y] for x, y in [*run, (a, b)]).strip()) > most:
                close()
            run.append((a, b))
        close()
    return out or [Piece(markdown, 0, len(markdown))]


def words(text: str) -> set[str]:
    return {w for w in _WORD.findall(text.lower()) if len(w) > 2}


def plain(text: str) -> str:
    for pattern, to in _PLAIN:
        text = pattern.sub(to, text)
    return text.strip().lower()


def markdown_flags(text: str) -> list[bool]:
    """table, code, math, definition list, admonition, steps that Markdown shows; formulas and definition lists can only be seen in HTML."""
    return [bool(_TABLE.search(text)), "```" in text, False, False, bool(_NOTE.search(text)), bool(_STEP.search(text))]


def embedding_text(text: str, context: str | None) -> str:
    """What is embedded of a child: its text, and its images' context where it has one."""
    return text + (f"\n\nImage context: {context}" if context else "")


def squeezed(text: str | None) -> str | None:
    return (re.sub(r"\s+", " ", text).strip() or None) if text is not None else None


def distinct_images(images: list[Image]) -> list[Image]:
    clean = [(u.strip(), squeezed(a), squeezed(t), squeezed(c)) for u, a, t, c in images]
    return list(dict.fromkeys(i for i in clean if i[0]))


def joined_context(texts: Iterator[str | None]) -> str | None:
    seen: dict[str, str] = {}
    for t in map(squeezed, texts):
        if t:
            seen.setdefault(t.lower(), t)
    return " | ".join(seen.values()) or None


class HtmlContext:
    """A page's HTML, parsed once, with the words of the elements a chunk may match."""

    def __init__(self, root: dom.Node) -> None:
        self.root = root
        by: dict[str, list[dom.Node]] = {}
        for n in root.walk():
            if n is not root and n.tag:
                by.setdefault(n.tag, []).append(n)
        named = [n for tag in CANDIDATES for n in by.get(tag, ())]
        self.held = [(n, words(_spaced(n))) for n in named or [n for n in root.walk() if n is not root]]

    def best(self, text: str) -> dom.Node | None:
        """The element that shares most words with a text; the first of equals; none that shares nothing."""
        want = words(plain(text))
        top, at = 0, None
        for n, has in self.held:
            if len(has) > top and (score := len(want & has)) > top:
                top, at = score, n
        return at


def _spaced(n: dom.Node) -> str:
    out: list[str] = []
    stack: list[dom.Node | str] = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x.strip())
        else:
            stack += reversed(x.children)
    return " ".join(t for t in out if t)


def html_flags(n: dom.Node | None) -> list[bool]:
    """table, code, math, definition list, admonition, steps in an element or below it."""
    if n is None:
        return [False] * 6
    every = list(n.walk())
    tags = {x.tag for x in every}
    classes = [c for x in every for c in x.classes()]
    return [
        "table" in tags,
        bool(tags & {"pre", "code"}),
        "math" in tags or any(t.startswith("mjx-") for t in tags) or any(_MATH_CLASS.search(c) for c in classes),
        "dl" in tags,
        "blockquote" in tags or any(_NOTE_CLASS.search(c) for c in classes),
        "ol" in tags,
    ]


def snippet(text: str, at: dom.Node | None, flags: list[bool]) -> str | None:
    """The flagged element under a chunk's context that shares most words with the chunk, as HTML."""
    if at is None:
        return None
    own = lambda *tags: [*at.find_all(*tags), *([at] if at.tag in tags else [])]
    some: list[dom.Node] = []
    if flags[0]:
        some += own("table")
    if flags[1]:
        some += [*at.find_all("pre"), *at.find_all("code"), *([at] if at.tag in ("pre", "code") else [])]
    if flags[3]:
        some += own("dl")
    if flags[2]:
        some += [*own("math"), at]
    if flags[4]:
        some += [x for x in at.walk() if any(_NOTE_CLASS.search(c) for c in x.classes())]
        some += [*([at] if at.tag == "blockquote" else []), *at.find_all("blockquote")]
    want = words(plain(text))
    top, best = 0, None
    for x in some or [at]:
        if (score := len(want & words(_spaced(x)))) > top:
            top, best = score, x
    return best.markup() if best is not None else None


def html_images(at: dom.Node | None) -> list[Image]:
    out: list[Image] = []
    for img in at.find_all("img") if at is not None else []:
        url = next((u for k in ("src", "data-src", "data-original", "data-lazy-src") if (u := img.attrs.get(k))), None)
        if not url or not url.strip():
            continue
        figure = img.parent
        while figure is not None and figure.tag != "figure":
            figure = figure.parent
        caption = figure.find("figcaption") if figure is not None else None
        if figure is None and img.parent is not None:
            after = [c for c in img.parent.children if isinstance(c, dom.Node)]
            nxt = after[after.index(img) + 1 : after.index(img) + 2]
            caption = nxt[0] if nxt and nxt[0].tag in ("figcaption", "caption") else None
        out.append((url.strip(), squeezed(img.attrs.get("alt")), squeezed(img.attrs.get("title")), squeezed(_spaced(caption)) if caption is not None else None))
    return distinct_images(out)


def merged_images(text: str, at: dom.Node | None) -> list[Image]:
    """Images of a chunk's HTML, their gaps filled from Markdown, then those only Markdown has."""
    marked = distinct_images([(m[2], m[1], m[3], None) for m in _IMAGE.finditer(text)])
    seen = html_images(at)
    by: dict[str, int] = {i[0]: k for k, i in enumerate(seen)}
    out = list(seen)
    for u, alt, title, _ in marked:
        if u in by:
            _, a, t, c = out[by[u]]
            out[by[u]] = (u, a or alt, t or title, c)
        else:
            out.append((u, alt, title, None))
    return distinct_images(out)


def children_of(parent: Piece, whole: HtmlContext | None, most: int, count: Callable[[str], int], first: int = 0) -> list[Piece]:
    """The pieces of a parent's blocks, in order, with flags, snippets and images.

    Places are those of the document, also where blocks stand further apart
    there than in the parent's text.
    """
    context = whole
    if whole is not None and (scope := whole.best(parent.text)) is not None:
        context = HtmlContext(scope)
    out: list[Piece] = []
    spans = blocks(parent.text)
    known = parent.block_starts if len(parent.block_starts) == len(spans) else [parent.start + a for a, _ in spans]
    for (a, b), place in zip(spans, known):
        block, pos = parent.text[a:b], 0
        for t in pieces(block, most, count):
            at = block.find(t, pos)
            at = pos if at < 0 else at
            pos = at + len(t)
            start = place + at
            tag = context.best(t) if context is not None else None
            flags = [x or y for x, y in zip(markdown_flags(t), html_flags(tag))]
            images = merged_images(t, tag)
            out.append(
                Piece(t, start, start + len(t), parent.heading, first + len(out), parent.index, flags, snippet(t, tag, flags) if any(flags[:5]) else None, images, joined_context(x for i in images for x in i[1:]))
            )
    return out


def facts(df: DataFrame, key: str, text: str, context: str | None = None) -> DataFrame:
    """(key, flags, words, images, context, embedding_text) of Markdown texts without HTML, by what chunking itself uses; null texts have no row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, given = b.column(1).to_pylist(), b.column(2).to_pylist()
            images = [merged_images(t, None) for t in texts]
            cols = [
                pa.array([markdown_flags(t) for t in texts], pa.list_(pa.bool_())), pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string())), pa.array([len(i) for i in images], pa.int32()),
                pa.array([joined_context(x for i in some for x in i[1:]) for some in images], pa.string()), pa.array([embedding_text(t, c) for t, c in zip(texts, given)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [key, "flags", "words", "images", "context", "embedding_text"])

    rows = df.select(key, F.col(text).cast("string").alias("t"), (F.col(context) if context else F.lit(None)).cast("string").alias("c")).where("t is not null")
    return rows.mapInArrow(run, f"{key} {kind}, flags array<boolean>, words array<string>, images int, context string, embedding_text string")


def chunk_document(markdown: str | None, html: str | None, config: EngineConfig, tokenizer: Tokenizer) -> tuple[list[Piece], list[Piece]]:
    """(parents, children) of a document; nothing of an empty one. Without headings every four children make a parent."""
    if not markdown:
        return [], []
    root = dom.parse(html) if html else None
    whole = HtmlContext(root) if root is not None else None
    if sections(markdown)[0][0] is None:
        children = children_of(Piece(markdown, 0, len(markdown)), whole, config.child_target_tokens, tokenizer.count)
        parents = []
        for lo in range(0, len(children), GROUP):
            some = children[lo : lo + GROUP]
            for c in some:
                c.parent = len(parents)
            parents.append(Piece("\n\n".join(c.text for c in some), some[0].start, some[-1].end, None, len(parents)))
    else:
        parents = parents_of(markdown, config.parent_max_tokens, tokenizer.count)
        children = [c for p in parents for c in children_of(p, whole, config.child_target_tokens, tokenizer.count)]
    for p in parents:
        mine = [c for c in children if c.parent == p.index]
        if not mine:
            continue
        p.flags = [any(c.flags[k] for c in mine) for k in range(6)]
        p.images = distinct_images([i for c in mine for i in c.images])
        p.context = joined_context(x for c in mine if c.context for x in c.context.split("|"))
        if any(p.flags[:5]):
            at = whole.best(p.text) if whole is not None else None
            p.html = snippet(p.text, at, p.flags) or next((c.html for c in mine if c.html), None)
    return parents, children


_COLUMNS = [c for c in schemas.CHUNKS.names if c not in ("source_url", "fetched_at", "depth", "title")]


def chunks_of(documents: DataFrame, config: EngineConfig = EngineConfig(), tokenizer: Tokenizer | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Chunks of documents (document_id, markdown, html, source_url, fetched_at, depth, title): parents and embedded children.

    A document without an id or without markdown has no chunks. Ids hang on the
    document and the place, so the same document always has the same chunks.
    """
    tok, emb = tokenizer or WordTokenizer(), embedder or HashingEmbedder(config.embedding_dims)

    def key(*parts: object) -> str:
        return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()

    def rows(doc: dict) -> list[dict]:
        parents, children = chunk_document(doc["markdown"], doc["html"], config, tok)
        ends = tok.ends(doc["markdown"]) if parents else []
        texts = [embedding_text(c.text, c.context) for c in children]
        vectors = checked_embeddings(emb, texts)
        out = []
        for level, some in (("parent", parents), ("child", children)):
            for k, p in enumerate(some):
                up = key(doc["document_id"], "parent", p.parent) if level == "child" else None
                a, b = token_offsets(ends, p.start, p.end)
                out.append(
                    {"chunk_id": key(doc["document_id"], level, p.index) if level == "parent" else key(doc["document_id"], level, p.parent, p.index), "document_id": doc["document_id"], "parent_id": up, "chunk_level": level, "chunk_index": p.index,
                     "section_heading": p.heading, "chunk_text": p.text, "html_text": p.html, **dict(zip(schemas.FLAGS, p.flags)), "has_image": bool(p.images), "image_context_text": p.context,
                     "image_refs": [dict(zip(("url", "alt", "title", "caption"), i)) for i in p.images], "char_start": p.start, "char_end": p.end, "token_start": a, "token_end": b,
                     "embedding": vectors[k] if level == "child" else None, "source_url": doc["source_url"], "fetched_at": doc["fetched_at"], "depth": doc["depth"], "title": doc["title"]}
                )
        return out

    arrow = to_arrow_schema(schemas.CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 50):
                out = [r for d in b.slice(lo, 50).to_pylist() for r in rows(d)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    has = lambda c, kind: (F.col(c) if c in documents.columns else F.lit(None)).cast(kind).alias(c)
    given = documents.select(has("document_id", "string"), has("markdown", "string"), has("html", "string"), has("source_url", "string"), has("fetched_at", "timestamp"), F.coalesce(has("depth", "int"), F.lit(0)).alias("depth"), has("title", "string"))
    return given.where("document_id is not null and markdown is not null").mapInArrow(run, schemas.CHUNKS)
