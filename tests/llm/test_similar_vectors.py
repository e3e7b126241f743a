import numpy as np
import pytest

from corvane.llm import similar_vectors as sv
from corvane.session import table

SCHEMA = "chunk_id string, embedding array<float>, bucket int, k1 string, vec int"


def brute(ids, x, k, floor):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for i in range(len(ids)):
        near = sorted((-s[i, j].round(6), ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= floor)
        out[ids[i]] = [n for _, n in near[:k]]
    return out


def clusters(n, dim, seed, noise=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    return (centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, dim))).astype(np.float32)


def run(spark, rows, **kw):
    out = {}
    for r in sv.nearest(spark.createDataFrame(rows, SCHEMA), **kw).collect():
        out.setdefault(r.id, {})[r.rank] = r.neighbour
    return {i: [v[k] for k in sorted(v)] for i, v in out.items()}


def test_hadamard_is_a_rotation():
    m = sv.fast_hadamard(np.eye(64))
    assert np.allclose(m @ m.T, np.eye(64))
    r = sv.rotations(sv.CrossPolytope(dim=20))
    assert np.allclose(r[0, 0] @ r[0, 0].T, np.eye(32), atol=1e-5)


def test_recall_against_brute_force(spark):
    x = clusters(900, 64, 1)
    ids = [f"c{i:04d}" for i in range(len(x))]
    want = brute(ids, x.astype(float), 5, 0.85)
    got = run(spark, [(i, v.tolist(), 1, "x", 2) for i, v in zip(ids, x)])
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    hit = {(a, b) for a, bs in got.items() for b in bs}
    assert len(pairs) > 1000 and len(pairs & hit) / len(pairs) >= 0.95
    assert len(hit - pairs) / len(hit) <= 0.02  # only where a nearer one was missed


def test_recall_on_the_test_data(spark, data):
    c = table(spark, data.replace("0.001", "0.01"), "chunks").where("chunk_level = 'child' and embedding is not null").dropDuplicates(["chunk_id"]).toPandas()
    x = np.stack(c.embedding.values).astype(float)
    ok = np.isfinite(x).all(1) & (np.linalg.norm(x, axis=1) > 0)
    ids = c.chunk_id[ok].tolist()
    want = {tuple(sorted((a, b))) for a, bs in brute(ids, x[ok], 5, 0.85).items() for b in bs}
    got = {tuple(r) for r in sv.found(table(spark, data.replace("0.001", "0.01"), "chunks")).collect()}
    assert len(want & got) >= 0.95 * len(want) and got <= want


def test_copies_of_one_vector_give_k_each(spark):
    v = [1.0] + [0.0] * 63
    rows = [(f"a{i:03d}", v, 0, "", 0) for i in range(300)] + [("z", [0.9, 0.1] + [0.0] * 62, 0, "", 0)]
    got = run(spark, rows)
    assert got["a000"] == ["a001", "a002", "a003", "a004", "a005"]
    assert got["a200"] == ["a000", "a001", "a002", "a003", "a004"]
    assert got["z"] == ["a000", "a001", "a002", "a003", "a004"] and len(got) == 301


def test_hot_bucket_is_cut_into_tiles_without_loss(spark):
    rng = np.random.default_rng(3)
    x = (np.eye(64)[0] * 40 + rng.normal(size=(700, 64))).astype(np.float32)  # all in one bucket
    ids = [f"h{i:04d}" for i in range(len(x))]
    p = sv.CrossPolytope(tile=64, tables=8)
    want = brute(ids, x.astype(float), 5, 0.85)
    got = run(spark, [(i, v.tolist(), 0, "", 0) for i, v in zip(ids, x)], params=p)
    assert sum(len(set(want[i]) & set(got.get(i, []))) for i in ids) >= 0.9 * 5 * len(ids)


def test_tiles_of_hot_buckets_find_what_whole_buckets_do(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(500, 64)), 4, 0) + rng.normal(size=64) * 1.1 + 0.55 * rng.normal(size=(2000, 64))  # unrelated: cosine about 0.55
    rows = [(f"h{i:04d}", v.tolist(), 0, "", 0) for i, v in enumerate(x.astype(np.float32))]
    whole, tiled = ({(a, b) for a, bs in run(spark, rows, k=20, params=sv.CrossPolytope(tile=tile)).items() for b in bs} for tile in (10**6, 64))
    assert len(whole) > 1000 and whole == tiled


def test_every_row_has_k_without_a_floor(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(600, 64)).astype(np.float32)  # no two alike
    ids = [f"r{i:03d}" for i in range(len(x))]
    rows, want = [(i, v.tolist(), 0, "", 0) for i, v in zip(ids, x)], brute(ids, x.astype(float), 5, -2)
    got = run(spark, rows, floor=None)
    assert {i: len(v) for i, v in got.items()} == dict.fromkeys(ids, 5)
    # buckets so narrow that the probes find next to nothing: the rows are compared with every vector
    got = run(spark, rows, floor=None, params=sv.CrossPolytope(occupancy=1, tables=1, probes=1, tile=128))
    assert all(len(v) == 5 for v in got.values()) and sum(got[i] == want[i] for i in ids) > 400


def test_unusable_rows_repeats_and_empty_tables(spark):
    v = [0.5] * 64
    rows = [("a", v, None, None, None), ("a", v, 1, "q", 1), ("b", [2 * x for x in v], 1, "q", 1), ("n", None, 1, "", 1), ("z", [0.0] * 64, 1, "", 1), ("s", [1.0] * 3, 1, "", 1), (None, v, 1, "", 1)]
    rows += [("nan", [float("nan")] * 64, 1, "", 1), ("inf", [float("inf")] + [1.0] * 63, 1, "", 1), ("hole", [None] + [1.0] * 63, 1, "", 1)]
    assert run(spark, rows) == {"a": ["b"], "b": ["a"]}
    assert run(spark, rows[3:5]) == {}
    assert spark.createDataFrame([], SCHEMA).transform(sv.nearest).count() == 0


@pytest.mark.parametrize("n", [10, 1000, 350_000, 5_000_000, 10**9])
def test_fitted_buckets_have_the_wanted_load(n):
    p = sv.CrossPolytope().fitted(n)
    buckets = (2 * p.width) ** (p.rotations - 1) * p.cells
    assert n / buckets <= p.occupancy and p.tables >= 5
