import re

import numpy as np

from corvane.llm import near_duplicates as nd
from corvane.llm.grouping import components, mix64
from corvane.session import table

SCHEMA = "chunk_id string, chunk_text string, words int, bucket string, id int"
VOCAB = [f"w{i}" for i in range(400)]


def words(t):
    return frozenset(re.findall(r"[^\W_]+", (t or "").lower()))


def brute(rows, threshold=0.8, least=20):
    s = [(i, words(t)) for i, t, *_ in rows if i is not None and len(words(t)) >= least]
    return {tuple(sorted((a, b))) for k, (a, x) in enumerate(s) for b, y in s[:k] if a != b and len(x & y) >= threshold * len(x | y) - 1e-12}


def made(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = list(rng.choice(VOCAB, 40, replace=False))
        rows.append((f"d{i}", " ".join(w), 1, "b", 2))
        for j in range(int(rng.integers(0, 3))):
            v = list(w)
            for _ in range(int(rng.integers(0, 8))):
                v[int(rng.integers(len(v)))] = str(rng.choice(VOCAB))
            rng.shuffle(v)
            rows.append((f"d{i}-{j}", ", ".join(v).upper(), 1, "b", 2))
    return rows


def test_signature_agrees_with_jaccard():
    rng = np.random.default_rng(0)
    a = np.unique(mix64(rng.integers(0, 2**60, 100).astype(np.uint64))).view(np.int64)
    b = np.r_[a[:80], np.unique(mix64(rng.integers(0, 2**60, 20).astype(np.uint64))).view(np.int64)]
    true = 80 / 120
    est = []
    for seed in range(30):
        sig, rounds = nd.super_min_hash(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), 144, seed)
        est.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(est) - true) < 0.02
    assert rounds < 60  # early stopping
    assert np.std(est) < np.sqrt(true * (1 - true) / 144) * 1.1


def test_early_stopping_changes_nothing():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2**60, 50)).astype(np.int64)
    alone, _ = nd.super_min_hash(h, np.array([0, len(h)]), 32)
    # beside a set of one word, which needs every round, nothing may differ
    other, rounds = nd.super_min_hash(np.r_[h, h[:1]], np.array([0, len(h), len(h) + 1]), 32)
    assert rounds == 32 and (alone[0] == other[0]).all() and np.isfinite(other[1]).all()


def test_links_are_those_of_brute_force(spark):
    rows = made(150, 5)
    got = {(r.id_a, r.id_b) for r in nd.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


def test_test_data(spark, data):
    d = data.replace("0.001", "0.01")
    rows = [(r.chunk_id, r.chunk_text) for r in table(spark, d, "chunks").where("chunk_level = 'child'").select("chunk_id", "chunk_text").distinct().collect()]
    got = {tuple(r) for r in nd.found(table(spark, d, "chunks")).collect()}
    assert got == brute(rows)


def test_hot_bucket_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 16)
    rng = np.random.default_rng(9)
    base = list(rng.choice(VOCAB, 60, replace=False))
    rows = [(f"d{i:03d}", " ".join(base[:59] + [f"x{i}"]), 1, "", 1) for i in range(70)]
    got = {(r.id_a, r.id_b) for r in nd.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(got) == 70 * 69 // 2


def test_large_classes_of_copies_are_stars(spark):
    t = " ".join(VOCAB[:30])
    near = " ".join(VOCAB[1:31])
    rows = [(f"c{i:03d}", t, 1, "", 1) for i in range(100)] + [("x", near, 1, "", 1)]
    got = {(r.id_a, r.id_b) for r in nd.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, 100)} | {("c000", "x")}
    groups = nd.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(groups) == 101 and {g.group_id for g in groups} == {"c000"}


def test_large_classes_of_different_texts_give_every_pair(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 16)
    rows = [(f"c{i:03d}", " ".join(VOCAB[i % 30 : 30] + VOCAB[: i % 30]) + "." * (i // 30), 1, "", 1) for i in range(90)]
    rows += [(f"n{i}", " ".join(VOCAB[1:31]) + "!" * i, 1, "", 1) for i in range(3)]
    got = {(r.id_a, r.id_b) for r in nd.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and len(got) == 93 * 92 // 2


def test_nulls_short_texts_repeats_and_empty(spark):
    t = " ".join(VOCAB[:25])
    rows = [("a", t, None, None, None), ("a", t, 1, "", 1), ("b", t.upper() + " _", 1, "", 1), (None, t, 1, "", 1), ("n", None, 1, "", 1), ("e", "", 1, "", 1), ("s", "few words", 1, "", 1), ("long", " ".join(f"v{i}" for i in range(20000)), 1, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.id_a, r.id_b, r.similarity) for r in nd.links(df).collect()] == [("a", "b", 1.0)]
    assert {(r.id, r.group_id) for r in nd.groups(df).collect()} == {("a", "a"), ("b", "a"), ("long", "long")}
    none = spark.createDataFrame([], SCHEMA)
    assert nd.links(none).count() == 0 and nd.groups(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (None, 3)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: root(x) for x in up}
