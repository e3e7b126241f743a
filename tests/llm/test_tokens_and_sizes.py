import random
from collections import Counter, defaultdict
from math import log

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import mixing as mx
from corvane.llm import packing as pk
from corvane.llm import token_budget as tb
from corvane.llm import tokens as tk
from corvane.session import table

# tokens


def test_counts_are_those_of_the_tokenizer(spark):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, "ab " * 50000, 5)]
    got = {r.id: r.tokens for r in tk.with_tokens(spark.createDataFrame(rows, "id int, text string, tokens int"), "text").collect()}
    enc = tk.encoding(tk.VOCABULARY)
    assert got == {1: 2, 2: 0, 3: 0, 4: len(enc.encode_ordinary(rows[3][1]))}
    assert enc.decode(enc.encode_ordinary("Grüße, 世界!")) == "Grüße, 世界!"


# token budget


CHUNKS = "document_id string, chunk_id string, parent_id string, token_start int, token_end int, chunk_text string, tokens int, language string"
DOCS = "document_id string, language string, source_url string, url string, tokens int"


def test_spans_count_every_position_once(spark):
    rng = random.Random(3)
    rows, want = [], defaultdict(set)
    for i in range(400):
        d, a, b = f"d{rng.randrange(6)}", rng.randrange(40000), 0
        b = a + rng.randrange(9000)
        want[d] |= set(range(a, b))
        rows.append((d, f"c{i}", None, *((a, b) if rng.random() > 0.1 else (b, a)), "x", 1, "en"))
    rows += rows[:20]
    got = {r.document_id: r.tokens for r in tb.span_tokens(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got == {d: len(s) for d, s in want.items()}


def test_missing_spans_are_encoded_only_without_a_parent(spark):
    rows = [("d", "p", None, 0, 10, "one two", 1, ""), ("d", "c", "p", 3, None, "two", 1, ""), ("e", "q", None, None, None, "Hello world", 1, ""), ("e", "r", "q", None, 4, "Hello world", 1, ""), (None, "s", None, 0, 5, "x", 1, ""), ("f", "t", None, None, None, None, 1, "")]
    docs = [("d", "EN", "https://www.A.example:443/x", "u", 1), ("e", None, None, "https://b.example/", 1), ("g", "français", "", "nonsense", 1), ("g", "français", "", "nonsense", 1)]
    got = {(r.language, r.site): (r.documents, r.tokens, r.encoded_tokens) for r in tb.token_totals(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {("en", "a.example"): (1, 10, 0), ("und", "b.example"): (1, 0, 2), ("fr", ""): (1, 0, 0)}
    assert tb.token_totals(spark.createDataFrame([], CHUNKS), spark.createDataFrame([], DOCS)).count() == 0


def test_deltas_give_the_cube_of_a_fresh_count(spark, data):
    docs = table(spark, data, "normalized_documents")
    got = {(r.language, r.site): (r.documents, r.tokens) for r in tb.fetched_budget(docs, "2025-06-01 00:00:00").collect()}
    fresh = defaultdict(lambda: [0, 0])
    for r in tb.newest(docs).collect():
        fresh[r.language, r.site][0] += 1
        fresh[r.language, r.site][1] += tk.count_tokens(r.text)
    assert got == {k: tuple(v) for k, v in fresh.items()} and got


def test_the_budget_is_kept_between_runs(spark, tmp_path):
    schema = "key string, content_hash string, language string, site string, domain string, text string"
    state = lambda *rows: spark.createDataFrame([(k, t, lang, s, s, t) for k, lang, s, t in rows], schema)
    root = f"file://{tmp_path}/budget"
    first = tb.Budget(spark, root, buckets=4).update(state(("1", "en", "a", "Hello world"), ("2", "en", "a", "one two three"), ("3", "de", "b", "Hello world")))
    assert first == {"encoded": 2, "cells": 2}
    kept = tb.Budget(spark, root, buckets=4)  # another run
    assert kept.update(state(("1", "en", "a", "Hello world"), ("4", "de", "b", "Hello world"), ("2", "en", "a", "one two three four"))) == {"encoded": 1, "cells": 1}
    assert {(r.language, r.documents, r.tokens) for r in kept.read("cube").collect()} == {("en", 2, 6), ("de", 1, 2)}
    v = kept.version()
    assert kept.update(state(("1", "en", "a", "Hello world"), ("4", "de", "b", "Hello world"), ("2", "en", "a", "one two three four"))) == {"encoded": 0, "cells": 0} and kept.version() == v
    assert kept.update(state(("1", "en", "a", "Hello world"))) == {"encoded": 0, "cells": 2}  # removed documents
    assert {(r.language, r.documents, r.tokens) for r in kept.read("cube").collect()} == {("en", 1, 2)} and kept.read("ledger").count() == 3


def test_ledger_encodes_only_what_is_unseen(spark):
    seen = spark.createDataFrame([("h1", tk.tokenizer_hash(tk.VOCABULARY), 99), ("h2", "another", 7)], tb.LEDGER)
    new = spark.createDataFrame([("h1", "changed text counts for nothing"), ("h2", "Hello world"), ("h2", "Hello world"), (None, "x"), ("h3", None)], "content_hash string, text string")
    assert [(r.content_hash, r.tokens) for r in tb.update_ledger(seen, new).collect()] == [("h2", 2)]


def test_removed_and_moved_documents(spark):
    ledger = spark.createDataFrame([(h, tk.tokenizer_hash(tk.VOCABULARY), n) for h, n in (("a", 5), ("b", 7))], tb.LEDGER)
    schema = "key string, content_hash string, language string"
    before = spark.createDataFrame([("1", "a", "en"), ("2", "b", "en"), ("3", "a", "de")], schema)
    after = spark.createDataFrame([("1", "b", "en"), ("3", "a", "fr"), ("4", "a", "en")], schema)
    got = {r.language: (r.documents, r.tokens) for r in tb.deltas(before, after, ledger, ["language"]).collect()}
    assert got == {"de": (-1, -5), "fr": (1, 5)}  # en: one in, one out, and 5 + 7 before as after


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200), st.integers(1, 8))
def test_best_fit_against_a_plain_search(sizes, most_open):
    # of equally full containers any may be taken or closed, so open ones are compared by their free space
    fit, free_of, open_, load = pk.BestFit(100, most_open), {}, [], Counter()
    for s in sizes:
        b = fit.put(s)
        best = min((f for f in open_ if f >= s), default=None)
        if best is None:
            if len(open_) >= most_open:
                open_.remove(min(open_))  # the fullest
            assert b not in free_of
            free = 100
        else:
            assert free_of[b] == best  # the least space that fits
            open_.remove(best)
            free = best
        load[b] += s
        free_of[b] = free - s
        if free - s:
            open_.append(free - s)
    assert all(v <= 100 for v in load.values()) and len(open_) <= most_open


def test_containers_hold_everything_once(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 5, 60, 512, 513, 3000]) if i % 9 == 0 else rng.randrange(1, 300), "c", 1) for i in range(3000)] + [(7, 10, "c", 1), (None, 5, "", 1), (9000, None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens int, container_id string, shard int")
    out = pk.pack(df, {"small": 512, "large": 4096}, 3000).collect()
    want = Counter()
    for i, n, *_ in rows:
        if i is not None and n is not None:
            want[i] += n
    for kind, cap in (("small", 512), ("large", 4096)):
        mine = [r for r in out if r.container_kind == kind]
        assert Counter({i: sum(r.tokens for r in mine if r.id == i) for i in (0, 7, 9, 2999)}) == Counter({i: want[i] for i in (0, 7, 9, 2999)})
        load = Counter()
        for r in mine:
            load[r.container_id] += r.tokens
        assert max(load.values()) <= cap and sum(load.values()) == sum(want.values())
        cut = {r.id for r in mine if r.piece_no > 0}
        assert all(any(i == r[0] and r[1] > cap for r in rows if r[1]) for i in cut)
    load = Counter()
    for r in (r for r in out if r.container_kind == "small"):
        load[r.container_id] += r.tokens
    assert sum(load.values()) / (512 * len(load)) > 0.93
    again = pk.pack(df.repartition(7), {"small": 512, "large": 4096}, 3000).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert pk.pack(df.limit(0), {"small": 512}, 0).count() == 0


def test_capacities(spark):
    ok = spark.createDataFrame([("a", 5), ("b", 9), (None, 3), ("c", None)], "container_kind string, capacity_tokens int")
    assert pk.capacities_of(ok) == {"a": 5, "b": 9}
    with pytest.raises(ValueError):
        pk.capacities_of(spark.createDataFrame([("a", 0)], "container_kind string, capacity_tokens int"))


# mixing


def test_power_for_entropy():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    goal = 0.5 * (log(3) + mx.entropy(shares))
    assert mx.entropy(mx.tempered(shares, mx.power_for_entropy(shares, goal))) == pytest.approx(goal)
    assert mx.power_for_entropy(shares, log(3)) == pytest.approx(0, abs=1e-4)


def test_plan_keeps_limits():
    tokens, shares, repeats = {"a": 100, "b": 1000, "c": 50}, {"a": 0.5, "b": 0.3, "c": 0.2, "gone": 0.4}, {"a": 2, "b": 1, "c": 4, "gone": 9}
    w, power, total = mx.plan(tokens, shares, repeats)
    assert power == 1 and w == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}) and total == pytest.approx(400)
    w, power, total = mx.plan(tokens, shares, repeats, 500)
    assert 0 < power < 1 and w["a"] * total == pytest.approx(200)
    w, power, total = mx.plan(tokens, shares, repeats, 1200)
    assert w["a"] * total == pytest.approx(200) and w["c"] * total == pytest.approx(200) and w["b"] * total == pytest.approx(800)
    assert mx.plan(tokens, shares, repeats, 10**9)[2] == 1400 and mx.plan({}, shares, repeats) == ({}, 1.0, 0.0)


def test_draw_reaches_shares_within_limits(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice("aaaaabbc") if i % 3 else "a", rng.randrange(1, 60), "x") for i in range(6000)] + [(None, "a", 5, ""), (1, None, 5, ""), (70001, "unlisted", 5, ""), (70002, "b", None, ""), (70003, "b", 0, "")]
    targets = spark.createDataFrame([("a", 0.2, 1, 0), ("b", 0.5, 2, 0), ("c", 0.3, 4, 0), ("empty", 0.1, 2, 0), (None, 0.1, 1, 0)], "source string, target_share double, max_repeats int, tokens int")
    chosen, report = mx.draw(spark.createDataFrame(rows, "id bigint, source string, tokens int, times string"), targets)
    rep = {r.source: r for r in report.collect()}
    got = chosen.collect()
    assert {r.source for r in got} == {"a", "b", "c"}
    for s, share, most in (("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.3, 4)):
        assert rep[s].reached_share == pytest.approx(share, abs=0.001) and 1 <= rep[s].most_uses <= most
        assert sum(r.tokens * r.times for r in got if r.source == s) == rep[s].drawn_tokens
    assert rep["empty"].drawn_tokens == 0
    used = [r.times for r in got if r.source == "b"]
    assert max(used) - min(used) <= 1  # whole passes, then a part of one
    none, report = mx.draw(spark.createDataFrame([], "id bigint, source string, tokens int"), targets)
    assert none.count() == 0 and all(r.drawn_tokens == 0 for r in report.collect())
