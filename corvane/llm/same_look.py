"""Problem 10: one form for texts that look the same.

A longest-match transducer over grapheme clusters: a table of entries of one to
three characters (width forms, spaces, characters that aren't drawn, composed
accents, voiced kana, look-alike letters) is compiled once from rules and a
short list and checked for conflicts. Look-alike letters take the script of
their word: a word with letters of its own script stays in it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage

TILE = 1024

#: Letters that are drawn like a Latin letter, and that letter.
LOOK_ALIKES = (
    ("АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝһӏ", "ABEKMHOPCTYXSIJaeopcyxsijdqwhl"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj"),  # Greek
    ("ՕՍօսհոց", "OUouhng"),  # Armenian
)
#: Signs that are drawn like another sign.
SIGNS = ("\u2010\u2011\u2236\u0374\u02bc\u037e\u2024", "--:\u02b9\u2019;.")
#: Characters that are not drawn, apart from those of category Cf.
UNDRAWN = "͏ᅟᅠ឴឵"


def _width_form(c: str) -> str | None:
    """Full-width, half-width and ligature forms by their compatibility decomposition; others stay."""
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in ("<wide>", "<narrow>") or "ﬀ" <= c <= "ﬆ":
        return unicodedata.normalize("NFKC", c)
    return None


def _mark_of(c: str) -> str | None:
    """Half-width voicing marks are the combining ones of the same sound."""
    return {"ﾞ": "゙", "ﾟ": "゚", "゛": None, "゜": None}.get(c)


def compile_table() -> dict[str, str]:
    """The entries of the transducer, of one to three characters, from the rules above.

    The table is checked: no result is changed by the table again, a look-alike
    keeps its case, and two entries that begin alike and end in marks agree.
    """
    t: dict[str, str] = {}
    for n in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)):
        c = chr(n)
        kind = unicodedata.category(c)
        if kind == "Zs" or kind in ("Zl", "Zp"):
            t[c] = " " if kind == "Zs" else "\n"
        elif kind == "Cf" or 0xE0000 <= n or c in UNDRAWN or "︀" <= c <= "️" or 0xE0100 <= n <= 0xE01EF:
            t[c] = ""
        elif m := _mark_of(c):
            t[c] = m
        elif (w := _width_form(c)) is not None:
            t[c] = w
    for given, drawn in (*LOOK_ALIKES, SIGNS):
        for c, d in zip(given, drawn, strict=True):
            t[c] = d
    # a width form of a character that has an entry of its own takes that entry
    t = {c: "".join(t.get(x, x) for x in d) for c, d in t.items()}
    for c, d in t.items():
        if any(x in t for x in d):
            raise ValueError(f"conflict: {c!r} becomes {d!r}, which changes again")
        if c.isalpha() and len(d) == 1 and d.isalpha() and c.isupper() != d.isupper():
            raise ValueError(f"conflict: {c!r} and {d!r} differ in case")
    # entries of several characters: a base, as it is or as an entry gives it, with the marks it is composed with
    several: dict[str, str] = {}
    for n in (*range(0xA0, 0xAC00), *range(0xF900, 0x20000)):
        apart = unicodedata.normalize("NFD", chr(n))
        if 2 <= len(apart) <= 3 and unicodedata.combining(apart[1]):
            one = unicodedata.normalize("NFC", "".join(t.get(x, x) for x in apart))
            if several.setdefault(apart, one) != one:
                raise ValueError(f"conflict: {apart!r}")
    for kana in map(chr, range(0xFF66, 0xFF9E)):
        for mark in "ﾞﾟ":
            several[kana + mark] = unicodedata.normalize("NFC", t[kana] + t[mark])
    return t | several


@lru_cache(maxsize=1)
def _transducer() -> tuple[dict[str, str], re.Pattern[str], re.Pattern[str]]:
    t = compile_table()
    # classes with characters beyond the basic plane aren't compiled to bitmaps, so those stand apart as one range
    single = [c for c in t if len(c) == 1 and c <= "\uffff"]
    marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c) or unicodedata.category(c) == "Mn"))
    undrawn = re.escape("".join(c for c in single if t[c] == ""))
    voiced = "ﾞﾟ"
    changed = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a != b else re.escape(chr(a)) for a, b in _ranges(iter(sorted(single))))
    composed = "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(c for c in map(chr, (*range(0xA0, 0xAC00), *range(0xF900, 0x10000))) if unicodedata.decomposition(c)[:1] not in ("", "<")))
    hangul = "[\uac00-\ud7a3][\u11a8-\u11ff]+|[\u1100-\u115e\u1161-\u11ff]+"
    cluster = re.compile(f"{hangul}|[^\\n][{undrawn}]*[{marks}{voiced}][{marks}{voiced}{undrawn}]*|[{changed}]|[{composed}]|[\U00010000-\U0001ffff]")
    return t, cluster, re.compile(f"[{undrawn}]|[\U000e0000-\U000e01ff]")


def _ranges(chars: Iterator[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for n in map(ord, chars):
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


@lru_cache(maxsize=1 << 16)
def _cluster_form(s: str) -> str:
    """A cluster by the longest entries that match, then in composed form."""
    t = _transducer()[0]
    if s in t:
        return t[s]
    s = unicodedata.normalize("NFD", "".join(t.get(c, c) for c in s))
    out, i = [], 0
    while i < len(s):
        n = next((n for n in (3, 2, 1) if s[i : i + n] in t), 0)
        out.append(t[s[i : i + n]] if n else s[i])
        i += n or 1
    return unicodedata.normalize("NFC", "".join(out))


#: Letters of other scripts that may share a word with their Latin look-alikes.
_SCRIPTS = (("Ѐ-ԯ", LOOK_ALIKES[0]), ("Ͱ-Ͽἀ-῿", LOOK_ALIKES[1]), ("Ա-֏", LOOK_ALIKES[2]))
_OTHER = re.compile("[" + "".join(r for r, _ in _SCRIPTS) + "]")
_BACK = [(re.compile(f"[{r}]"), str.maketrans(drawn, given), frozenset(drawn)) for r, (given, drawn) in _SCRIPTS]
#: Words that have such a letter.
_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]*?" + _OTHER.pattern + r"[^\W\d_]*")


@lru_cache(maxsize=1 << 16)
def _in_its_script(word: str) -> str:
    """A word whose look-alikes are Latin: in the script of its other letters, if those are all of one and the rest has look-alikes there."""
    apart = unicodedata.normalize("NFD", word)
    letters = [c for c in apart if c.isalpha()]
    for script, back, drawn in _BACK:
        own = sum(bool(script.match(c)) for c in letters)
        if own and all(c in drawn for c in letters if not script.match(c)):
            return unicodedata.normalize("NFC", apart.translate(back))
    return word


def _key(text: str) -> str:
    """The form with every look-alike as a Latin letter."""
    _, cluster, undrawn = _transducer()
    return cluster.sub(lambda m: _cluster_form(m.group()), undrawn.sub("", text) if undrawn.search(text) else text)


def one_form(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, and a form is its own form.

    Widths, kinds of space, characters that are not drawn, composed and
    decomposed accents and look-alike letters make no difference; accents,
    case, raised digits and line breaks do. A word with letters that only one
    script has is written in that script throughout; one of look-alikes alone
    in Latin. Two texts have one form just if their letters look the same.
    """
    if text is None or text.isascii():
        return text
    text = _key(text)
    return _WORD.sub(lambda m: _in_its_script(m.group()), text) if _OTHER.search(text) else text


def consistent(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form): every row with its text in the consistent form; null texts stay null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one_form(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "form"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, form string")


def looks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, look, written): 128-bit hashes of the consistent form and of the text as written; rows with null have none."""
    kind = df.schema[id_col].dataType.simpleString()

    def digest(x: str) -> bytes:
        return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).to_pylist()
            written = [digest(x) for x in text]
            look = [w if (f := one_form(x)) == x else digest(f) for x, w in zip(text, written)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(look, pa.binary()), pa.array(written, pa.binary())], ["id", "look", "written"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, f"id {kind}, look binary, written binary")


def _copies(rows: DataFrame, expand: int) -> DataFrame:
    """(look, written, id, rep, small, g): rows of looks with several ways of writing; each way's least id, whether at most ``expand`` ids share it, the look's tiles."""
    group = rows.groupBy("look").agg(F.min("written").alias("w1"), F.max("written").alias("w2")).where("w1 <> w2").select("look")
    inside = cut_lineage(rows.join(group, "look").select("look", "written", "id").distinct())
    way = inside.groupBy("look", "written").agg(F.min("id").alias("rep"), F.count("*").alias("held"))
    size = way.groupBy("look").agg(F.ceil(F.sum("held") / TILE).cast("int").alias("g"))
    return inside.join(way, ["look", "written"]).join(size, "look").select("look", "written", "id", "rep", (F.col("held") <= expand).alias("small"), "g")


def same_look(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", expand: int = 64) -> DataFrame:
    """Pairs ``(id_a, id_b)``, the smaller id first, of rows that look the same but are written differently.

    All such pairs are given, however many ways of writing a look has, but for
    one case: of two ways of writing that both have more than ``expand`` exact
    copies only the representatives, their least ids, are paired, and each
    copy is paired with the representative of another way. :func:`members`
    gives every row's representative, from which those pairs follow. A look is
    joined with itself in tiles, so one look may hold any part of the rows.
    """
    rows = _copies(looks(df, id_col, text_col), expand)
    side = lambda d, s: d.select("look", "tile", F.col("id").alias("i" + s), F.col("written").alias("w" + s), F.col("small").alias("s" + s))
    own, every = F.pmod(F.xxhash64("id"), F.col("g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    few, reps = rows.where("small"), rows.where("not small and id = rep")
    full = side(few.withColumn("tile", own), "a").join(side(rows.withColumn("tile", every), "b"), ["look", "tile"]).where("wa <> wb and (not sb or ia < ib)")
    ways = side(reps.withColumn("tile", own), "a").join(side(reps.withColumn("tile", every), "b"), ["look", "tile"]).where("ia < ib")
    ends = rows.groupBy("look").agg(F.min_by("rep", "written").alias("r1"), F.max_by("rep", "written").alias("r2"))
    star = rows.where("not small").join(ends, "look").select(F.col("id").alias("ia"), F.when(F.col("rep") == F.col("r1"), F.col("r2")).otherwise(F.col("r1")).alias("ib"))
    pair = full.select("ia", "ib").unionByName(ways.select("ia", "ib")).unionByName(star)
    return pair.where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, written_as, looks_like): for rows of looks with several ways of writing, the least id written the same and the least that looks the same."""
    rows = _copies(looks(df, id_col, text_col), 0)
    return rows.join(rows.groupBy("look").agg(F.min("rep").alias("looks_like")), "look").select("id", F.col("rep").alias("written_as"), "looks_like")


def found(documents: DataFrame) -> DataFrame:
    """p10_found: pairs of documents that look the same and are written differently."""
    return same_look(documents).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))
