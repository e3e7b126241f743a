"""Problem 5: template residue, filler and error pages.

Character n-gram models of filler, of error and script notices, of page
furniture and of natural prose are fitted to the corpus: prose and furniture
from all of its lines, filler and notices from public stock wording and from
what short pages of several sites have in common. Likelihood ratios in windows
over each line and the common phrases themselves localise what is residue; a
page is a case by what covers it. Phrases, grams and the lines that a site
repeats are counted over all rows; a site's lines are no content. Placeholders
left unfilled are found by their syntax outside code.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.urls import page_of, site_of
from corvane.llm import residue_seeds, site_lines
from corvane.llm.markup import without_code
from corvane.session import cut_lineage

SIZE = 1 << 16
#: Parts of the table for Latin, other alphabets and the signs of East Asia, by a gram's last character: shares are taken within a part, so that a class isn't unlikely because little of it is in a script.
PARTS = ((0, 0, SIZE // 2), (0x370, SIZE // 2, SIZE // 4), (0x2E80, SIZE // 4 * 3, SIZE // 4))
ORDERS = (2, 3, 4, 5)
CLASSES = ("prose", "filler", "notice", "furniture")
PROSE, FILLERS, NOTICES, FURNITURE = range(4)
#: Filler and notices: the least likelihood ratio a character over prose, and the part of the content it must cover.
MARGIN = 0.25
COVER = 0.5
#: A phrase that is so many times more frequent in short pages than in full ones is no prose.
MORE = 60.0
#: Words of a phrase, and the least letters it has.
WORDS = 4
LETTERS = 8
#: Bits of the filter that full pages' phrases pass before they are counted, in bitmaps of 32,768.
FILTER = 1 << 23
#: Counts of grams leave a task in pieces of so many.
PIECE = 1 << 12
#: Windows in which long lines are judged: characters, and characters from one to the next.
WINDOW = 80
STEP = 10

PLACEHOLDER = re.compile(
    r"(?=[{%<$#@_\[(])(?:"  # every form begins with one of these
    r"\{\{\{?\s*[\w.\-]+(?:\s*\|\s*(?:upper|lower|title|safe|escape|trim|e))?\s*\}?\}\}"  # {{ name }}
    r"|\{%-?\s*\w[^%\n{}]*%\}|<%=?\s*\w[^%\n]*%>"  # {% block x %}, <%= x %>
    r"|[$#]\{\w[\w.\-:]*\}"  # ${name}, #{name}
    r"|(?<![\w%])%%?[A-Za-z][A-Za-z_]{2,}%%?(?![\w%])"  # %NAME%
    r"|(?<![\w}{\\$#%\]])\{(?:\d{1,2}|[A-Za-z_][\w.]*)\}(?![\w{}])"  # {name}, {0}
    r"|@@\w+@@|(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+__(?!\w)"  # @@NAME@@, __NAME__
    r"|<<\s*[A-Z][A-Z0-9_ ]+>>"
    r"|\[(?:Your|Insert|Enter|Add|Company|Customer|Product|First|Last) [A-Z][^\]\[\n]{0,50}\](?![(\[:])"  # [Your Name]
    r"|\[(?:(?:[Yy]our|[Ii]nsert) [^\]\[\n]{1,50}|(?:[Ee]nter|[Aa]dd|[Tt]ype|[Pp]ut|[Ww]rite) [^\]\[\n]{1,50} here)\](?![(\[:])"  # [insert name here]
    r"|\[(?:(?:TITLE|NAME|DATE|NUMBER|ADDRESS|TOPIC|SUBJECT|AUTHOR|DESCRIPTION|PLACE|LIST) OF|YOUR|INSERT|ENTER|COMPANY|CUSTOMER|PRODUCT|FIRST|LAST) [A-Z][A-Z_ ]{0,50}\](?![(\[:])"  # [TITLE OF PAGE]
    r"|\$\([A-Za-z][A-Za-z0-9]*(?:[._][A-Za-z0-9]+)+\)"  # $(page.title)
    r"|\(\((?:[A-Z][A-Z0-9_ ]{2,50}|[^()\n]{1,50} [Gg]oes [Hh]ere)\)\)|\[[^\]\[\n]{1,50} (?:goes here|GOES HERE)\](?![(\[:])"  # ((TITLE GOES HERE))
    r")"
)
_MARKER = re.compile(r"^[\s>]*(?:#{1,6}\s+|[-*+•]\s+|\d+[.)]\s+)?[*_]{0,3}")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s|^\s{0,3}(?:=+|-+)\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of texts in lower case, digits as one sign.

    Gives (characters, orders), 0 where a gram would start before its text,
    and where each text starts.
    """
    texts = [re.sub(r"\d+", "0", f" {t.lower()} ") for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(size)[:-1]]
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    part = sum((x >= first).view(np.uint8) for first, *_ in PARTS[1:])
    base, size_of = np.array([lo + 1 for _, lo, _ in PARTS], np.int32)[part], np.array([n - 1 for *_, n in PARTS], np.uint64)[part]
    x = x.astype(np.uint64)
    out = np.zeros((len(ORDERS), len(x)), np.int32)
    with np.errstate(over="ignore"):
        h, n = x, 1
        for k, order in enumerate(ORDERS):
            while n < order and len(h) > 1:
                h = h[1:] * np.uint64(0x9E3779B97F4A7C15)
                h += x[: len(h)]
                h += np.uint64(1)
                n += 1
            if n < order:
                break
            m = h >> np.uint64(29)
            m ^= h
            m *= np.uint64(0xBF58476D1CE4E5B9)
            m >>= np.uint64(32)
            m *= size_of[n - 1 :]
            m >>= np.uint64(32)
            np.add(m.view(np.int64), base[n - 1 :], out=out[k, n - 1 :], casting="unsafe")
            for i in range(n - 1):
                out[k, np.minimum(starts + i, len(x) - 1)] = 0
    out = out.T
    return out, starts


@dataclass(frozen=True)
class NGramModels:
    """Log-probabilities of grams less that of prose: (orders, SIZE, classes); gram 0 says nothing. Hashes of phrases that are residue, sorted, and their classes."""

    log: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))

    @staticmethod
    def of(counts: np.ndarray, known: np.ndarray | None = None, kinds: np.ndarray | None = None) -> NGramModels:
        """Counts mixed with what all classes have in common, so that a gram no class knows says nothing."""
        counts[:, 0] = 0
        share = np.concatenate([part / np.maximum(part.sum(1, keepdims=True), 1.0) for part in (counts[:, lo : lo + n] for _, lo, n in PARTS)], axis=1)
        common = share.mean(2, keepdims=True) + 0.02 / SIZE
        log = np.log(0.9 * share + 0.1 * common)
        log = (log - log[:, :, :1]).astype(np.float32)
        return NGramModels(log) if known is None else NGramModels(log, known, kinds)

    def _scores(self, g: np.ndarray) -> np.ndarray:
        s = np.zeros((len(g), len(CLASSES)), np.float32)
        for k in range(len(ORDERS)):
            s += np.take(self.log[k], g[:, k], axis=0, mode="clip")
        s /= len(ORDERS)
        return s

    def ratios_of(self, g: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean log-likelihood ratio a character of each class to prose, a row for each text of :func:`grams`."""
        s = self._scores(g)
        return np.add.reduceat(s, starts, axis=0) / np.diff(np.r_[starts, len(s)])[:, None]

    def ratios(self, texts: list[str]) -> np.ndarray:
        return self.ratios_of(*grams(texts)) if texts else np.zeros((0, len(CLASSES)))

    def shares(self, texts: list[str]) -> np.ndarray:
        """The part of each text that belongs to each class, by windows; a text within a window is judged whole, and one of which phrases of residue have half of the words belongs to them."""
        if not texts:
            return np.zeros((0, len(CLASSES)))
        g, starts = grams(texts)
        sums = np.vstack([np.zeros(len(CLASSES)), np.cumsum(self._scores(g), axis=0, dtype=np.float64)])
        size = np.diff(np.r_[starts, len(g)])
        count = 1 + np.maximum(0, -(-(size - WINDOW) // STEP))
        first = np.r_[0, np.cumsum(count)[:-1]]
        of = np.repeat(np.arange(len(texts)), count)
        at = (np.arange(len(of)) - first[of]) * STEP
        lo = starts[of] + np.minimum(at, np.maximum(0, size[of] - WINDOW))
        hi = np.minimum(lo + WINDOW, starts[of] + size[of])
        r = (sums[hi] - sums[lo]) / (hi - lo)[:, None]
        best = r.argmax(1)
        best[r[np.arange(len(r)), best] < MARGIN] = PROSE
        share = np.add.reduceat(np.eye(len(CLASSES))[best], first, axis=0) / count[:, None]
        words, held = self._held(texts)
        whole = (held.sum(1) > 0) & (2 * held.sum(1) >= words)
        share[whole] = np.eye(len(CLASSES))[held[whole].argmax(1)]
        return share

    def _held(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and how many of them stand in known phrases of each class."""
        held = np.zeros((len(texts), len(CLASSES)), np.int64)
        if not len(self.known):
            return np.zeros(len(texts), np.int64), held
        p = phrases(texts)
        at = np.minimum(np.searchsorted(self.known, p.h), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == p.h)
        of_word = np.zeros(len(p.of), np.int64)
        for i in range(WORDS):
            of_word[np.minimum(p.first[hit] + i, p.last[hit])] = self.kinds[at[hit]]
        np.add.at(held, (p.of[of_word > 0], of_word[of_word > 0]), 1)
        return np.bincount(p.of, minlength=len(texts)), held


def _counted(g: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(g[:, k], minlength=SIZE) for k in range(len(ORDERS))])


def _counts(texts: list[str]) -> np.ndarray:
    """How often each gram stands in texts: (orders, SIZE)."""
    return sum((_counted(grams(texts[lo : lo + 2000])[0]) for lo in range(0, len(texts), 2000)), np.zeros((len(ORDERS), SIZE), np.int64))


@dataclass(frozen=True)
class Fit:
    """The most characters of content that a short page has, and the sites whose short pages share a phrase that may be residue."""

    short: int = 500
    sites: int = 3


_LETTERS = re.compile(r"[\W\d_]+")
#: Stands at the end of a line that the page's site repeats.
_SITE = "\ue002"


def marked(markdown: str, lines: list[int] | None) -> str:
    """The text with the sign of a repeated line at the end of these lines (counted from 0)."""
    if not lines:
        return markdown
    rows = markdown.replace(_SITE, "").split("\n")
    for i in lines:
        rows[i] += _SITE
    return "\n".join(rows)


def units(markdown: str) -> list[tuple[str, bool, bool]]:
    """Lines without markers, long ones by sentences; whether each is a heading, and whether its site repeats it."""
    out = []
    for line in markdown.split("\n"):
        site = line.endswith(_SITE)
        line = line.replace(_SITE, "")
        if not line.strip():
            continue
        head = bool(_HEADING.match(line))
        body = _MARKER.sub("", line).strip(" *_~!")
        out += [(p, head, site) for p in (_SENTENCE.split(body) if len(body) > 60 else [body]) if p.strip()]
    return out


def residue_of(pages: list[str | None], models: NGramModels) -> list[dict[str, float]]:
    """What pages have: placeholders, and characters of filler, notices, furniture and content.

    Code, formulas and table rows are content; headings are content of no
    length, but a heading that is a notice counts as one. Lines of a site
    count for nothing: those marked as repeated, unless they are filler or a
    notice, and those too short to be counted that are furniture.
    """
    parts, code = [], []
    for p in pages:
        text, n = without_code(p) if p else ("", 0)
        code.append(n - (p or "").count(_SITE) + text.count(_SITE))
        parts.append((text, units(text)))
    each = list(dict.fromkeys(u for _, us in parts for u, *_ in us))
    share = dict(zip(each, models.shares(each).tolist()))
    out = []
    for (text, us), n in zip(parts, code):
        f = dict.fromkeys(("placeholders", "filler", "notice", "furniture", "content"), 0.0)
        f["content"], f["placeholders"] = float(n), float(len(PLACEHOLDER.findall(text)))
        for u, head, site in us:
            prose, filler, notice, furniture = (1.0, 0.0, 0.0, 0.0) if u[0] == "|" else share[u]
            if site:
                prose, furniture = 0.0, furniture + prose
            if head:
                prose = filler = furniture = 0.0
            for name, part in (("content", prose), ("filler", filler), ("notice", notice), ("furniture", furniture)):
                f[name] += part * len(u)
        out.append(f)
    return out


def is_residue(f: dict[str, float]) -> bool:
    body = f["content"] + f["filler"] + f["notice"]
    return f["placeholders"] > 0 or (body > 0 and (f["filler"] + f["notice"]) >= COVER * body)


def lines_of_sites(documents: DataFrame) -> DataFrame:
    """(fetch_id, lines): the numbers of the lines that a page's site repeats, counted over all rows."""
    return site_lines.repeated_lines(documents).groupBy("fetch_id").agg(F.collect_set("line_no").alias("lines"))


@functools.cache
def _signs() -> np.ndarray:
    """Of every code point: 1 for a sign of words, 3 for a letter."""
    every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(every), np.uint8)
    for bit, signs in ((1, r"\w+"), (2, r"[^\W\d_]+")):
        for m in re.finditer(signs, every):
            out[slice(*m.span())] |= bit
    return out


_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of an odd number and of its inverse, modulo 2 ** 64."""
    each = [np.cumprod(np.full(1 << bits, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return tuple(np.r_[np.uint64(1), x] for x in each)


@dataclass(frozen=True)
class Phrases:
    """The words of texts, each by its text's number; phrases by their hash, first and last word and signs from ``lo`` to ``hi`` of ``joined``."""

    of: np.ndarray
    h: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    joined: str


def phrases(texts: list[str]) -> Phrases:
    """Every ``WORDS`` words that follow one another in a text, or the whole text if it has no more; by their letters in lower case, ``LETTERS`` at least."""
    lower = [t.lower() for t in texts]
    joined = "\n".join(lower)
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sign = _signs()[x]
    edge = np.diff((sign & 1).astype(np.int8), prepend=0, append=0)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), lo, "right")
    words = np.bincount(of, minlength=len(texts))
    i = np.arange(len(lo))
    begin = (np.cumsum(words) - words)[of]
    few = words[of] <= WORDS
    first = i[np.where(few, i == begin, i + WORDS <= begin + words[of])]
    last = np.where(few[first], begin[first] + words[of[first]] - 1, first + WORDS - 1)
    letter = sign == 3
    before = np.r_[0, np.cumsum(letter)]
    start, end = before[lo[first]], before[hi[last]]
    long = end - start >= LETTERS
    first, last, start, end = first[long], last[long], start[long], end[long]
    power, inverse = _powers(max(16, int(before[-1]).bit_length()))
    with np.errstate(over="ignore"):
        v = (x[letter].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.r_[np.uint64(0), np.cumsum((v ^ (v >> np.uint64(29))) * power[: len(v)], dtype=np.uint64)]
        h = (sums[end] - sums[start]) * inverse[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return Phrases(of, (h ^ (h >> np.uint64(32))).view(np.int64), first, last, lo[first], hi[last], joined)


def _parts(text: str, lines: list[int] | None) -> tuple[list[tuple[str, bool]], int]:
    """The units of a page that are neither headings nor table rows, with whether its site repeats them, and the characters of content apart from its site's lines."""
    text, code = without_code(marked(text, lines))
    us = [(u, own) for u, head, own in units(text) if not head and u[0] != "|"]
    return us, code + sum(len(u) for u, own in us if not own)


def _is_full(text: str, lines: list[int] | None, short: int) -> bool:
    """True only if the page has more than ``short`` characters of content: without code every letter outside headings, tables and its site's lines is content."""
    if len(text) <= short or any(c in text for c in "`~$\\" + _SITE):
        return False
    own = set(lines or ())
    return len(_LETTERS.sub("", "\n".join(x for i, x in enumerate(text.split("\n")) if i not in own and "|" not in x and not _HEADING.match(x)))) > short


def _added(pieces: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the counts (kind, key, counts) that tasks give in pieces, by kind; their size is fixed."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in t.column("counts").to_pylist())
        return pa.table({"kind": t.column("kind")[:1], "key": t.column("key")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out: dict[str, np.ndarray] = {}
    for r in pieces.groupBy("kind", "key").applyInArrow(add, "kind string, key bigint, counts binary").collect():
        out.setdefault(r.kind, np.zeros(len(ORDERS) * SIZE, np.int64))[r.key * PIECE : (r.key + 1) * PIECE] = np.frombuffer(r.counts, np.int64)
    return {k: v.reshape(len(ORDERS), SIZE) for k, v in out.items()}


def _pieces(kind: str, counts: np.ndarray) -> list[tuple[str, int, int, bytes]]:
    flat = counts.reshape(-1)
    return [(kind, i, 0, flat[i * PIECE : (i + 1) * PIECE].tobytes()) for i in range(len(flat) // PIECE)]


_SEEN = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)


def common_phrases(rows: DataFrame, p: Fit) -> DataFrame:
    """(h, text, short, sure): the phrases that short pages of ``sites`` sites share, and how often short pages have them.

    A phrase is sure if the parts of their pages that it makes up are a whole
    page at least, one page a site: a notice of two sentences is on a few
    sites, a short article that a few sites copied isn't.
    """
    schema = pa.schema([("h", pa.int64()), ("site", pa.string()), ("part", pa.float64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us: list[tuple[str, int, str]] = []
            for site, text, lines in zip(*(b.column(c).to_pylist() for c in ("site", "text", "lines"))):
                if not _is_full(text, lines, p.short):
                    parts, size = _parts(text, lines)
                    if size <= p.short:
                        us += [(site or "", max(1, size), u) for u, own in parts if not own]
            x = phrases([u for *_, u in us])
            yield _batch([(h, us[of][0], min(1.0, (hi - lo) / us[of][1]), x.joined[lo:hi]) for h, of, lo, hi in zip(x.h.tolist(), x.of[x.first].tolist(), x.lo.tolist(), x.hi.tolist())], schema)

    seen = rows.where("text is not null").select("site", "text", "lines").mapInArrow(run, "h bigint, site string, part double, text string")
    per = seen.groupBy("h", "site").agg(F.min("text").alias("text"), F.count("*").alias("short"), F.max("part").alias("part"))
    common = per.groupBy("h").agg(F.count("*").alias("sites"), F.sum("part").alias("part"), F.min("text").alias("text"), F.sum("short").alias("short"))
    return common.where(F.col("sites") >= p.sites).select("h", "text", "short", (F.col("part") >= 1).alias("sure"))


def wordings(rows: DataFrame, p: Fit) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """What the corpus says about itself, from all rows (key, site, text, lines): how often grams stand in prose and in furniture, and phrases (h, text, sure) that may be residue.

    Prose are the lines of pages with more than ``short`` characters of content
    apart from headings and lines of their site, furniture the lines of sites.
    A phrase that short pages of ``sites`` sites share may be residue if a
    character of theirs has it ``MORE`` times as often as one of full pages.
    Rows aren't labelled. What comes to the driver is of fixed size: sums of grams, and a
    filter that keeps phrases of no short page out of the shuffle.
    """
    common = cut_lineage(common_phrases(rows, p))
    at = F.pmod("h", F.lit(FILTER))
    bits = common.groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << 15) - 1)).alias("bits")).collect()
    asked = np.zeros((FILTER >> 15, 1 << 12), np.uint8)
    for r in bits:
        asked[r.bucket] = np.frombuffer(r.bits, np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(asked.reshape(-1))  # a fixed size: FILTER bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        counts, chars = {k: np.zeros((len(ORDERS), SIZE), np.int64) for k in ("prose", "furniture")}, {"short": 0, "full": 0}
        for b in batches:
            pages = [_parts(text, lines) for text, lines in zip(b.column("text").to_pylist(), b.column("lines").to_pylist())]
            for lo in range(0, len(pages), 100):
                of: dict[str, list[str]] = {"prose": [], "furniture": []}
                for us, size in pages[lo : lo + 100]:
                    chars["full" if size > p.short else "short"] += size
                    of["furniture"] += [u for u, own in us if own]
                    of["prose"] += [u for u, own in us if not own and size > p.short]
                for k, us in of.items():
                    counts[k] += _counts(us)
                h = phrases(of["prose"]).h
                slot = h % FILTER
                h, n = np.unique(h[(asked[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0], return_counts=True)
                yield _batch([("phrase", i, k, b"") for i, k in zip(h.tolist(), n.tolist())], _SEEN)
        yield _batch([x for k, c in counts.items() if c.any() for x in _pieces(k, c)] + [(k, 0, n, b"") for k, n in chars.items()], _SEEN)

    seen = cut_lineage(rows.where("text is not null").select("text", "lines").mapInArrow(run, "kind string, key bigint, n bigint, counts binary"))
    size = {r.kind: max(1, r.n) for r in seen.where("kind in ('short', 'full')").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    full = seen.where("kind = 'phrase'").groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("full"))
    more = (F.col("short") / size.get("short", 1)) / ((F.coalesce("full", F.lit(0)) + 1) / size.get("full", 1))
    grams_of = _added(seen.where("kind in ('prose', 'furniture')").drop("n"))
    none = np.zeros((len(ORDERS), SIZE), np.int64)
    return grams_of.get("prose", none), grams_of.get("furniture", none), common.join(full, "h", "left").where(more >= MORE).select("h", "text", "sure")


def fit_models(rows: DataFrame, n: int, p: Fit | None = None) -> NGramModels:
    """Models for ``n`` rows (key, site, text, lines), of the seeds alone if there are none; without lines of sites furniture comes from the seeds alone.

    Phrases that may be residue and are sure, or likelier residue than prose by
    the seeds, go to filler or to notices, whichever is likelier, and teach it.
    """
    counts = np.zeros((len(ORDERS), SIZE, len(CLASSES)))
    for c, xs in seeds().items():
        counts[:, :, c] += _counts(xs)
    if not n:
        return NGramModels.of(counts)
    prose, furniture, residue = wordings(rows, p or Fit())
    counts[:, :, PROSE] += prose
    counts[:, :, FURNITURE] += furniture
    first = rows.sparkSession.sparkContext.broadcast(NGramModels.of(counts).log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = NGramModels(first.value), np.zeros((len(CLASSES), len(ORDERS), SIZE), np.int64)
        for b in batches:
            text, sure = b.column("text").to_pylist(), np.array(b.column("sure").to_pylist(), bool)
            r = m.ratios(text)[:, FILLERS : NOTICES + 1]
            best = np.where(sure | (r.max(1) > 0), r.argmax(1) + FILLERS, PROSE)
            for c in (FILLERS, NOTICES):
                sums[c] += _counts([x for x, k in zip(text, best) if k == c])
                yield _batch([("known", c, 0, np.asarray(b.column("h"))[best == c].tobytes())], _SEEN)
        yield _batch([x for c in (FILLERS, NOTICES) if sums[c].any() for x in _pieces(CLASSES[c], sums[c])], _SEEN)

    seen = cut_lineage(residue.mapInArrow(run, "kind string, key bigint, n bigint, counts binary"))
    for kind, c in _added(seen.where("kind <> 'known'").drop("n")).items():
        counts[:, :, CLASSES.index(kind)] += c
    known = [(np.frombuffer(r.counts, np.int64), r.key) for r in seen.where("kind = 'known'").select("key", "counts").collect()]  # 8 bytes a phrase
    h = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in known)])
    kinds = np.concatenate([np.zeros(0, np.int8), *(np.full(len(x), c, np.int8) for x, c in known)])
    order = np.argsort(h)
    return NGramModels.of(counts, h[order], kinds[order])


def seeds() -> dict[int, list[str]]:
    """The seed texts of filler, notices and furniture, a sentence each."""
    of = ((FILLERS, residue_seeds.FILLER), (NOTICES, residue_seeds.NOTICE), (FURNITURE, residue_seeds.FURNITURE))
    return {c: [x for line in s.split("\n") for x in _SENTENCE.split(line) if x.strip()] for c, s in of}


def scan(rows: DataFrame, models: NGramModels, key: str = "fetch_id") -> DataFrame:
    """(key, placeholders, filler, notice, furniture, content, residue) of rows as of :func:`prepared`; null texts are no residue."""
    kind = rows.schema["key"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast((models.log, models.known, models.kinds))  # orders * SIZE * classes, and 9 bytes a phrase

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = NGramModels(*held.value)
        for b in batches:
            text = b.column(1).to_pylist()
            text = [t and marked(t, own) for t, own in zip(text, b.column(2).to_pylist())]
            got = [f for lo in range(0, len(text), 100) for f in residue_of(text[lo : lo + 100], m)]
            cols = [pa.array([g[c] for g in got], pa.float64()) for c in ("placeholders", "filler", "notice", "furniture", "content")]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([is_residue(g) for g in got], pa.bool_())], [key, "placeholders", "filler", "notice", "furniture", "content", "residue"])

    return rows.select("key", "text", "lines").mapInArrow(run, f"{key} {kind}, placeholders double, filler double, notice double, furniture double, content double, residue boolean")


def prepared(documents: DataFrame, key: str = "fetch_id", text: str = "markdown", lines: DataFrame | None = None) -> DataFrame:
    """(key, site, text, lines) of all rows; ``lines`` as :func:`lines_of_sites`."""
    site = site_of(page_of()) if {"url", "source_url"} <= set(documents.columns) else F.lit(None).cast("string")
    rows = documents.select(F.col(key).alias("key"), site.alias("site"), F.col(text).cast("string").alias("text"))
    if lines is None:
        return rows.withColumn("lines", F.lit(None).cast("array<int>"))
    return rows.join(lines.withColumnRenamed("fetch_id", "key"), "key", "left").select("key", "site", "text", "lines")


def coverage(documents: DataFrame, key: str = "fetch_id", text: str = "markdown", fit: Fit | None = None) -> DataFrame:
    """:func:`scan` of all rows with models fitted to them and, where the table has addresses, the lines of their sites."""
    # small beside the texts, and read by the fit and by the scan
    lines = cut_lineage(lines_of_sites(documents)) if {"url", "source_url"} <= set(documents.columns) else None
    rows = prepared(documents, key, text, lines)
    return scan(rows, fit_models(rows, documents.select(key).count(), fit), key)


def found(documents: DataFrame) -> DataFrame:
    """p5_found."""
    return coverage(documents).where("residue").select("fetch_id")
