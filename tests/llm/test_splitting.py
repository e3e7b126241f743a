import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import splitting as sp

SCHEMA = "item_kind string, item_key string, text string, max_chars int, overlap_chars int, piece_no string"


def valid(text, spans, limit, overlap):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 <= a <= b and b - a <= limit for a, b in spans)
    assert all(a2 == b1 - overlap and b2 > b1 for (_, b1), (a2, b2) in itertools.pairwise(spans))


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n#`|。é́", max_size=400), st.integers(1, 60), st.data())
def test_pieces_keep_limit_and_overlap(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    valid(text, sp.split_text(text, limit, overlap), limit, overlap)


def test_marks_at_the_smallest_limit():
    text = "``\u0301"
    valid(text, sp.split_text(text, 1, 0), 1, 0)


def cost(text, ends, limit, overlap, pos, pen):
    n, c = len(text), -(-(len(text) - overlap) // (limit - overlap))
    even = (n + (c - 1) * overlap) / c
    total, last = 0.0, 0
    for e in ends:
        size = e - max(last - overlap, 0)
        if size > limit or (0 < last <= overlap):
            return np.inf
        total += pen.get(e, 0.0) + sp.BALANCE * ((size - even) / limit) ** 2
        last = e
    return total


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    text = "".join(rng.choice(["alpha ", "beta. ", "\n", "\n\n", "# head\n", "x"], 22))
    limit, overlap = 50, 8
    pos, pen = sp.boundaries(text, limit, overlap)
    if len(text) <= limit:
        return
    at = dict(zip(pos.tolist(), pen.tolist()))
    best = min(cost(text, [*c, len(text)], limit, overlap, pos, at) for k in range(1, 5) for c in itertools.combinations(pos.tolist(), k))
    spans = sp.split_text(text, limit, overlap)
    assert cost(text, [b for _, b in spans], limit, overlap, pos, at) == pytest.approx(best)


def test_prefers_natural_boundaries():
    text = "word " * 30 + "\n\n" + "more " * 30 + "\n\n## Title\n" + "text " * 30
    ends = [b for _, b in sp.split_text(text, 200, 20)]
    assert all(text[:e].endswith("\n") for e in ends[:-1])


def test_no_natural_boundary_and_marks():
    text = "é" * 5 + "é" * 2000
    spans = sp.split_text(text, 300, 30)
    valid(text, spans, 300, 30)
    assert all(text[b] != "́" for _, b in spans[:-1])


def test_limits():
    assert sp.split_text("abc", 3, 1) == [(0, 3)] and sp.split_text("", 3, 1) == [(0, 0)]
    with pytest.raises(ValueError):
        sp.split_text("abc", 3, 3)


def test_table(spark):
    long = "One sentence here. " * 5000
    rows = [("parent", "a", long, 1000, 100, "clash"), ("parent", "a", long, 1000, 100, None), ("parent", "b", "short", 1000, 100, ""), ("child", "n", None, 10, 1, ""), ("child", "e", "", 10, 1, ""), ("child", "l", "x" * 50, None, 1, ""), ("child", "x", "exactly10!", 10, 1, "")]
    out = sp.pieces(spark.createDataFrame(rows, SCHEMA)).orderBy("piece_no").collect()
    assert {r.item_key for r in out} == {"a"}
    assert "".join(r.piece[100 if r.piece_no else 0 :] for r in out) == long
    assert all(r.piece == long[r.char_start : r.char_end] and len(r.piece) <= 1000 for r in out)
    assert sp.pieces(spark.createDataFrame([], SCHEMA)).count() == 0
