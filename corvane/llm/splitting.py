"""Problem 3: cutting oversized texts at natural boundaries.

Dynamic programming over boundary positions: the sum of cut penalties and of
squared deviations from the even length is least, every piece keeps the limit
and neighbours share exactly the overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a cut costs: before a heading, at a blank line, a line end, a sentence end, a word end, anywhere.
HEADING, PARAGRAPH, LINE, SENTENCE, WORD, ANYWHERE = 0.0, 1.0, 3.0, 5.0, 9.0, 30.0
#: Added inside a fenced code block, a formula block or a table.
INSIDE = 8.0
#: Weight of the squared deviation from the even length, as a part of the limit.
BALANCE = 20.0

_NEWLINE = re.compile(r"\n(?P<blank>(?:[ \t]*\n)+)?(?P<head>#{1,6}[ \t])?")
_SENTENCE = re.compile(r"[.!?…]['\")\]»”’]*[ \t]+|[。！？]+[」』）]*")
_BLOCK = re.compile(r"^(?P<f>```+|~~~+|\$\$)[^\n]*\n.*?^(?P=f)[ \t]*$|^(?:\|[^\n]*(?:\n|\Z))+", re.M | re.S)
_SPACE = re.compile(r"\s+")


def boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, ascending, and the penalty of each."""
    n, at = len(text), {}
    for m in _NEWLINE.finditer(text):
        at[m.start("head") if m["head"] else m.end()] = HEADING if m["head"] else PARAGRAPH if m["blank"] else LINE
    for m in _SENTENCE.finditer(text):
        at.setdefault(m.end(), SENTENCE)
    order = np.array(sorted(at), np.int64)
    for m in _BLOCK.finditer(text):
        for p in order[np.searchsorted(order, m.start(), "right") : np.searchsorted(order, m.end(), "left")].tolist():
            at[p] += INSIDE
    step = max(1, (limit - overlap) // 2)
    for cost, points in ((WORD, lambda a, b: [m.end() for m in _SPACE.finditer(text, a, b)]), (ANYWHERE, lambda a, b: _anywhere(text, a, b, max(1, step // 2)))):
        known = np.array([0, *sorted(p for p in at if 0 < p < n), n])
        for i in np.flatnonzero(np.diff(known) > step):
            for p in points(int(known[i]), int(known[i + 1])):
                at.setdefault(p, cost)
    pos = np.array(sorted(p for p in at if 0 < p < n), np.int64)
    return pos, np.array([at[p] for p in pos.tolist()])


def _anywhere(text: str, a: int, b: int, step: int) -> list[int]:
    """Places every ``step`` characters, moved left off marks and joiners."""
    out = []
    for p in range(a + step, b, step):
        q = p
        while q > a + 1 and p - q < step and (unicodedata.combining(text[q]) or text[q] in "‍️" or text[q - 1] == "‍"):
            q -= 1
        out.append(q)
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of a text: each at most ``limit`` long, each starting ``overlap`` before the end of the one before it.

    A text within the limit is one piece. Needs ``0 <= overlap < limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and under the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    pos, cost = boundaries(text, limit, overlap)
    pos, cost = np.concatenate([[0], pos, [n]]), np.concatenate([[0.0], cost, [0.0]])
    count = -(-(n - overlap) // (limit - overlap))
    even = (n + (count - 1) * overlap) / count
    start = np.maximum(pos - overlap, 0)
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), np.int64)
    best[0] = 0.0
    low = 0
    # ends at or before the overlap would give a first piece that holds nothing of its own
    for j in range(1, len(pos)):
        while low < j and pos[j] - start[low] > limit:
            low += 1
        if low == j:  # no boundary is near enough
            continue
        size = pos[j] - start[low:j]
        total = best[low:j] + BALANCE * ((size - even) / limit) ** 2
        total[(pos[low:j] > 0) & (pos[low:j] <= overlap)] = np.inf
        i = int(total.argmin())
        best[j], back[j] = total[i] + cost[j], low + i
    if not np.isfinite(best[-1]):  # only where limit and overlap leave a step of a few characters
        ends = [*range(limit, n, limit - overlap), n]
        return [(max(0, e - limit) if e < n else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]
    spans, j = [], len(pos) - 1
    while j > 0:
        i = int(back[j])
        spans.append((int(start[i]), int(pos[j])))
        j = i
    return spans[::-1]


def pieces(items: DataFrame) -> DataFrame:
    """Pieces of the items that exceed their limit.

    ``items``: (item_kind, item_key, text, max_chars, overlap_chars). Gives
    (item_kind, item_key, piece_no, char_start, char_end, piece); offsets count
    code points. Items within the limit, null texts and null limits give no
    rows; a key that comes twice is cut once. Whole texts are cut.
    """
    over = items.select("item_kind", "item_key", F.col("text").cast("string").alias("text"), "max_chars", "overlap_chars").where(F.length("text") > F.col("max_chars")).dropDuplicates(["item_kind", "item_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500).to_pylist()
                out = [(r["item_kind"], r["item_key"], i, s, e, r["text"][s:e]) for r in part for i, (s, e) in enumerate(split_text(r["text"], r["max_chars"], r["overlap_chars"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["item_kind", "item_key", "piece_no", "char_start", "char_end", "piece"])

    return over.mapInArrow(run, "item_kind string, item_key string, piece_no int, char_start int, char_end int, piece string")


def corpus_items(documents: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The items of problem 3 with their limits; the table of limits has a row for each kind and at most 1,000."""
    kinds = limits.limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 kinds of item")
    by = {r.item_kind: r for r in kinds if r.item_kind is not None and r.max_chars is not None and r.overlap_chars is not None}

    def of(df: DataFrame, kind: F.Column, key: F.Column, text: F.Column, names: list[str]) -> DataFrame:
        names = [n for n in names if n in by]
        if not names:
            return df.select(kind.alias("item_kind"), key.alias("item_key"), text.alias("text"), F.lit(0).alias("max_chars"), F.lit(0).alias("overlap_chars")).limit(0)
        at = lambda f: F.coalesce(*(F.when(kind == n, F.lit(int(by[n][f]))) for n in names))
        return df.where(kind.isin(names)).select(kind.alias("item_kind"), key.alias("item_key"), text.alias("text"), at("max_chars").alias("max_chars"), at("overlap_chars").alias("overlap_chars"))

    docs = of(documents, F.lit("markdown"), F.col("fetch_id").cast("string"), F.col("markdown"), ["markdown"])
    return docs.unionByName(of(chunks, F.col("chunk_level"), F.col("chunk_id"), F.col("chunk_text"), ["parent", "child"]))


def found(documents: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """p3_found: the items that are cut, from the pieces."""
    return pieces(corpus_items(documents, chunks, limits)).where("piece_no = 1").select("item_kind", "item_key")
