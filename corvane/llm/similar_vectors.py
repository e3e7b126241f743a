"""Problem 1: the most similar vectors of every vector.

Cross-polytope hashing. A vector of length 1 goes through pseudo-rotations
(three rounds of random signs and a fast Hadamard transform) and is assigned
to the nearest signed axis; the axes of one table's rotations are its bucket.
Every vector is stored in its own bucket of each table and asks there and in
the buckets that are next nearest. Candidates are compared inside the bucket
with vectors of one byte a dimension, and the best are ranked again with the
full vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.grouping import row_hash, whole_groups
from corvane.session import cut_lineage


@dataclass(frozen=True)
class CrossPolytope:
    """Parameters of the index. ``cells``: signed axes of the last rotation that count, to fit the buckets to the collection.

    ``least_cells`` are taken from 1,024 vectors a cell on, even where ``occupancy`` would need fewer.
    """

    dim: int = 64
    tables: int = 5
    probes: int = 2
    rotations: int = 2
    cells: int = 0
    seed: int = 17
    occupancy: int = 512
    tile: int = 4096
    slack: float = 0.02
    least_cells: int = 2
    sample: int = 20000

    @property
    def width(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    def fitted(self, n: int) -> CrossPolytope:
        """The same index with as many buckets as ``n`` vectors need to lie ``occupancy`` in a bucket.

        Narrower buckets find less, so above ten million vectors two tables are added for each tenfold.
        """
        per, need, full = 2 * self.width, max(2.0, min(self.least_cells, 2 * self.width, n / 1024), n / self.occupancy), 0
        while need > per:
            need, full = need / per, full + 1
        last = 1 << int(np.ceil(np.log2(max(2.0, need))))
        more = max(0, round(2 * np.log10(max(n, 1) / 1e7)))
        return CrossPolytope(**(self.__dict__ | {"rotations": full + 1, "cells": min(last, per), "tables": self.tables + more}))


#: For neighbours without a floor: those of unstructured vectors are hardly nearer than others, so buckets are wider and tables more.
WITHOUT_FLOOR = CrossPolytope(tables=24, probes=1, occupancy=4096, least_cells=128)
_ENTRY = np.dtype([("b1", "<i8"), ("b2", "<i8"), ("near", "<f4")])


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the last axis (a power of two), of norm 1."""
    n, h = x.shape[-1], 1
    y = x.copy()
    while h < n:
        y = y.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        y = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2)
        h *= 2
    return y.reshape(x.shape) / np.sqrt(n)


def rotations(p: CrossPolytope) -> np.ndarray:
    """The pseudo-rotations as matrices (table, rotation, width, width): the transform applied to the axes.

    Composed once; a product with them gives the same as three transforms and costs less at these widths.
    """
    rng = np.random.default_rng(p.seed)
    out = np.empty((p.tables, p.rotations, p.width, p.width), np.float32)
    for t in range(p.tables):
        for j in range(p.rotations):
            m = np.eye(p.width)
            for _ in range(3):
                m = fast_hadamard(m * rng.choice([-1.0, 1.0], p.width))
            out[t, j] = m
    return out


def buckets(x: np.ndarray, p: CrossPolytope, rot: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(table, probe, bucket) of each row of ``x``; probe 0 is where the row itself is stored."""
    n = len(x)
    for t in range(p.tables):
        best, second, gap = np.empty((p.rotations, n), np.int64), np.empty((p.rotations, n), np.int64), np.empty((p.rotations, n))
        for j in range(p.rotations):
            y = x @ rot[t, j]
            if j == p.rotations - 1 and p.cells and p.cells // 2 < p.width:
                y = y[:, : max(1, p.cells // 2)]
            m = np.abs(y)
            a = m.argmax(1)
            rows = np.arange(n)
            best[j] = a * 2 + (y[rows, a] < 0)
            top = m[rows, a].copy()
            if y.shape[1] > 1:
                m[rows, a] = -1
                b = m.argmax(1)
                second[j], gap[j] = b * 2 + (y[rows, b] < 0), top - m[rows, b]
            else:
                second[j], gap[j] = best[j] ^ 1, 2 * top
        order = np.argsort(gap, axis=0)
        for probe in range(min(p.probes, p.rotations + 1)):
            digits = best.copy()
            if probe:
                j = order[probe - 1]
                digits[j, np.arange(n)] = second[j, np.arange(n)]
            yield t, probe, row_hash(digits.T.astype(np.uint64), p.seed * 1000 + t)


def _unit_rows(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable (``dim`` finite numbers, not all zero), and those rows with length 1."""
    ok = np.array(pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False), bool)
    x = col.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, (x[good] / norm[good, None] + 0.0).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    """A matrix as one binary value a row."""
    x = np.ascontiguousarray(x)
    size = x.dtype.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(x)])


def _matrix(col: pa.ChunkedArray | pa.Array, dtype: type, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.dtype(dtype).itemsize * dim
    return np.frombuffer(col.buffers()[2], np.uint8)[col.offset * size : (col.offset + len(col)) * size].view(dtype).reshape(len(col), dim) if len(col) else np.empty((0, dim), dtype)


def _unit(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, k1, k2, vec): usable vectors of length 1; (k1, k2) is a hash of 128 bits of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _unit_rows(b.column(1), dim)
            if len(x):
                w = np.ascontiguousarray(np.pad(x, ((0, 0), (0, x.shape[1] % 2)))).view(np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(row_hash(w, 1)), pa.array(row_hash(w, 2)), _binary(x)], ["id", "k1", "k2", "vec"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null").mapInArrow(run, "id string, k1 bigint, k2 bigint, vec binary")


def nearest(df: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", k: int = 5, floor: float | None = 0.85, params: CrossPolytope | None = None, exact_for: F.Column | None = None) -> DataFrame:
    """The ``k`` most similar rows of every row: ``(id, rank, neighbour, cosine)``.

    Neighbours under ``floor`` are not given; the index is built to find at
    least 0.9 of those above it (measured in the tests and the README). Without
    a floor every row has its ``k``: the nearest of all that wider buckets of
    more tables collect, and a row for which they are fewer than ``k`` is
    compared with every vector. With ``exact_for`` (a condition on ``id``, for
    a stated set of rows) only those rows ask, and each is compared with every
    vector, in tiles; :func:`recall` measures the index by that. Vectors
    that are null, of another length than ``params.dim``, all zero or hold NaN,
    infinity or null have no rows. Equal similarity: the smaller id first. A
    row counts once per id; of rows of one id with different vectors each
    vector counts. Copies of one vector are compared as one and expanded at
    the end to at most ``k`` neighbours each, so a vector repeated in a third
    of all rows costs no more than another. A bucket that a bounded sample
    (``params.sample`` ids) shows to be hot is cut into tiles: a row is
    stored in one and asks in all of them, so nothing is left out. An
    empty table gives an empty result; other columns are ignored.
    """
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).alias("v"))
    n = src.select("id").where("id is not null").count()
    p = (params or (WITHOUT_FLOOR if floor is None else CrossPolytope())).fitted(n)
    rot = rotations(p)
    base = _unit(src, "id", "v", p.dim)
    hot = np.zeros((0, 2), np.int64) if exact_for is not None else _hot_buckets(src, n, p, rot)

    group = base.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.min("id").alias("least"), F.max("id").alias("most"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), np.float32, p.dim)
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            q = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
            wide = np.pad(x, ((0, 0), (0, p.width - p.dim)))
            for _, probe, key in buckets(wide, p, rot):
                tiles = np.ones(len(key), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot[:, 0], key), len(hot) - 1)
                    tiles = np.where(hot[at, 0] == key, hot[at, 1], 1)
                rows = np.arange(len(key))
                own = (k1.view(np.uint64) % tiles.astype(np.uint64)).astype(np.int64)
                if tiles.max() > 1:
                    # a row asks in every tile and is stored in one
                    rows = np.repeat(rows, tiles)
                    tile = np.concatenate([np.arange(c) for c in tiles])
                else:
                    tile = np.zeros(len(key), np.int64)
                stored = (tile == own[rows]) & (probe == 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(tile.astype(np.int32)), pa.array(k1[rows]), pa.array(k2[rows]), pa.array(stored), _binary(q[rows])], ["bucket", "tile", "k1", "k2", "stored", "q"])

    best = k + 4
    out_schema = "a1 bigint, a2 bigint, b1 bigint, b2 bigint" if floor is not None else "a1 bigint, a2 bigint, top binary"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["bucket", "tile"]):
            q = _matrix(t.column("q"), np.int8, p.dim).astype(np.float32)
            q /= np.sqrt((q * q).sum(1, keepdims=True))
            k1, k2, stored = t.column("k1").to_numpy(), t.column("k2").to_numpy(), t.column("stored").to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, [*starts[1:], len(t)]):
                at = s + np.flatnonzero(stored[s:e])
                if e - s < 2 or not len(at):
                    continue
                for lo, part in ((lo, at[c : c + p.tile]) for lo in range(s, e, 2048) for c in range(0, len(at), p.tile)):
                    sim = q[lo : min(e, lo + 2048)] @ q[part].T
                    if floor is None:
                        # what isn't among the best of some columns isn't among the best of all
                        some = sim[:, :512]
                        least = np.partition(some, -best - 1, axis=1)[:, -best - 1] if some.shape[1] > best else np.full(len(sim), -2.0)
                        i, j = np.nonzero(sim >= least[:, None])
                    else:
                        i, j = np.nonzero(sim >= floor - p.slack)
                    if not len(i):
                        continue
                    v, i, j = sim[i, j], lo + i, part[j]
                    keep = (k1[i] != k1[j]) | (k2[i] != k2[j])
                    i, j, v = i[keep], j[keep], v[keep]
                    if len(i) > best:
                        o = np.lexsort((-v, i))
                        i, j, v = i[o], j[o], v[o]
                        first = np.r_[True, i[1:] != i[:-1]]
                        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                        i, j, v = i[rank < best], j[rank < best], v[rank < best]
                    found.append((i, j, v))
            if found:
                i, j, v = (np.concatenate(x) for x in zip(*found))
                if floor is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[i], k2[i], k1[j], k2[j])], ["a1", "a2", "b1", "b2"])
                elif len(i):
                    o = np.lexsort((-v, i))
                    i, j, v = i[o], j[o], v[o]
                    entry = np.empty(len(i), _ENTRY)
                    entry["b1"], entry["b2"], entry["near"] = k1[j], k2[j], v
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    yield pa.RecordBatch.from_arrays([pa.array(k1[i[first]]), pa.array(k2[i[first]]), _packed(entry, first)], ["a1", "a2", "top"])

    def candidates(asked: DataFrame) -> DataFrame:
        cand = asked.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile").mapInArrow(compare, out_schema)
        if floor is not None:
            return cand.distinct()  # at most tables * probes * best for an asking vector
        return cand.groupBy("a1", "a2").agg(F.collect_list("top").alias("tops")).mapInArrow(lambda b: _merged(b, k + 2), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")

    asked = group.select("k1", "k2", "vec").mapInArrow(spread, "bucket bigint, tile int, k1 bigint, k2 bigint, stored boolean, q binary")
    vec = lambda s: group.select(F.col("k1").alias(s + "1"), F.col("k2").alias(s + "2"), F.col("vec").alias(s + "v"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _matrix(b.column(4), np.float32, p.dim).astype(np.float64), _matrix(b.column(5), np.float32, p.dim).astype(np.float64)
            cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            keep = cos >= (-2.0 if floor is None else floor)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(keep)) for c in range(4)), pa.array(np.minimum(cos[keep], 1.0))], ["a1", "a2", "b1", "b2", "cos"])

    def rank(asked: DataFrame) -> DataFrame:
        return candidates(asked).join(vec("a"), ["a1", "a2"]).join(vec("b"), ["b1", "b2"]).select("a1", "a2", "b1", "b2", "av", "bv").mapInArrow(exact, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, cos double")

    if exact_for is None:
        ranked = rank(asked)
    else:
        these = base.where(exact_for).select("k1", "k2").distinct()
        ranked = rank(_everywhere(group.select("k1", "k2", "vec"), group.join(these, ["k1", "k2"], "left_semi").select("k1", "k2", "vec"), n, p))

    # the k + 1 least ids of a vector that several ids have; salted, so no group is gathered at once
    shared = group.where("least <> most").select("k1", "k2")
    member = base.select("id", "k1", "k2").join(shared, ["k1", "k2"])
    few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    some = member.groupBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(few(F.collect_set("id")).alias("ids"))
    some = some.groupBy("k1", "k2").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    ids = group.select("k1", "k2", "least").join(some, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("ids", F.array("least")).alias("ids"))

    if floor is None and exact_for is None:
        ranked = cut_lineage(ranked)
        known = ranked.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionByName(some.select("k1", "k2", F.explode(F.slice("ids", 2, k))).drop("col")).groupBy("k1", "k2").agg(F.count("*").alias("known"))
        short = cut_lineage(group.select("k1", "k2", "vec").join(known, ["k1", "k2"], "left").where(F.coalesce("known", F.lit(0)) < k).select("k1", "k2", "vec"))
        if not short.isEmpty():
            ranked = ranked.unionByName(rank(_everywhere(group.select("k1", "k2", "vec"), short, n, p))).groupBy("a1", "a2", "b1", "b2").agg(F.max("cos").alias("cos"))

    hit = ranked.join(ids.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "ids"), ["b1", "b2"]).select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "cos", F.explode("ids").alias("nb"))
    own = some.select("k1", "k2", F.lit(1.0).alias("cos"), F.explode("ids").alias("nb"))
    tops = hit.unionByName(own).groupBy("k1", "k2").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("m"), F.col("nb").alias("nb")))), 1, k + 1).alias("tops"))
    lone = group.where("least = most").select("k1", "k2", F.col("least").alias("id"))
    who = lone.unionByName(member.select("k1", "k2", "id").distinct())
    per = who.join(tops, ["k1", "k2"]).select("id", F.slice(F.filter("tops", lambda x: x["nb"] != F.col("id")), 1, k).alias("tops"))
    per = per if exact_for is None else per.where(exact_for)
    return per.select("id", F.posexplode("tops").alias("rank", "t")).select("id", (F.col("rank") + 1).alias("rank"), F.col("t.nb").alias("neighbour"), (-F.col("t.m")).alias("cosine"))


def _packed(entries: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of entries that start at ``first``, each as one binary value."""
    ends = np.r_[first, len(entries)].astype(np.int32) * np.int32(entries.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(entries).view(np.uint8))])


def _merged(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """(a1, a2, b1, b2): of rows (a1, a2, tops) of packed entries the ``best`` nearest, each vector once."""
    for b in batches:
        col = b.column(2)
        flat = col.flatten()
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        entry = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(_ENTRY) if len(flat) else np.empty(0, _ENTRY)
        row = np.repeat(np.repeat(np.arange(len(b)), col.value_lengths().to_numpy()), np.diff(ends) // _ENTRY.itemsize)
        o = np.lexsort((entry["b2"], entry["b1"], row))
        row, entry = row[o], entry[o]
        once = np.r_[np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (entry["b1"][1:] != entry["b1"][:-1]) | (entry["b2"][1:] != entry["b2"][:-1])]
        row, entry = row[once], entry[once]
        o = np.lexsort((-entry["near"], row))
        row, entry = row[o], entry[o]
        first = np.r_[np.ones(min(1, len(row)), bool), row[1:] != row[:-1]]
        keep = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) < best
        row, entry = row[keep], entry[keep]
        a = b.select([0, 1]).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([a.column(0), a.column(1), pa.array(entry["b1"].copy()), pa.array(entry["b2"].copy())], ["a1", "a2", "b1", "b2"])


def recall(df: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", k: int = 5, every: int = 50, **how: object) -> DataFrame:
    """One row (asked, wanted, found, recall): what :func:`nearest` finds of the true ``k`` nearest of a stated set of rows, those whose md5 names one of ``every`` parts."""
    mine = F.pmod(F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("int"), F.lit(every)) == 0
    true = nearest(df, id_col, vec_col, k, None, exact_for=mine).select("id", "neighbour")
    got = nearest(df, id_col, vec_col, k, None, **how).where(mine).select("id", "neighbour", F.lit(1).alias("hit"))
    out = true.join(got, ["id", "neighbour"], "left").agg(F.countDistinct("id").alias("asked"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("wanted"))


def _everywhere(stored: DataFrame, asking: DataFrame, n: int, p: CrossPolytope) -> DataFrame:
    """Rows for the comparison in one bucket of all: each of ``stored`` in one tile, each of ``asking`` in every."""
    tiles = -(-n // p.tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(3), np.float32, p.dim)
            q = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(q), np.int64)), *(b.column(c) for c in (0, 1, 2, 4)), _binary(q)], ["bucket", "tile", "k1", "k2", "stored", "q"])

    one = stored.select(F.pmod("k1", F.lit(tiles)).cast("int").alias("tile"), "k1", "k2", "vec", F.lit(True).alias("stored"))
    all_ = asking.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "k1", "k2", "vec", F.lit(False).alias("stored"))
    return one.unionByName(all_).mapInArrow(run, "bucket bigint, tile int, k1 bigint, k2 bigint, stored boolean, q binary")


def _hot_buckets(src: DataFrame, n: int, p: CrossPolytope, rot: np.ndarray) -> np.ndarray:
    """(bucket, tiles) sorted by bucket: those that by a sample of ids hold more than a tile, and the tiles each needs.

    A bucket needs 40 rows of the sample to be named. The sample has at least
    ``p.sample`` ids and one of 1,638, so a bucket of more than 16 tiles is
    always named, and at most one for every 65,536 rows and table is.
    """
    every = max(1, min(n // p.sample, 16 * p.tile // 40))
    if n <= p.tile:
        return np.zeros((0, 2), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = _unit_rows(b.column(1), p.dim)
            x = np.pad(x, ((0, 0), (0, p.width - p.dim)))
            if len(x):
                u, c = np.unique(np.concatenate([h for _, probe, h in buckets(x, p, rot) if probe == 0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["h", "c"])

    picked = src.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", F.col("v").cast("array<float>").alias("v")).where("v is not null")
    counts = picked.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counts.where((F.col("c") >= min(40, p.tile)) & (F.col("c") * every > p.tile)).collect()
    return np.array(sorted((r.h, -(-r.c * every // p.tile)) for r in rows), np.int64).reshape(-1, 2)


def found(chunks: DataFrame, k: int = 5, floor: float = 0.85) -> DataFrame:
    """p1_found: pairs of child chunks, one among the ``k`` most similar of the other, with a cosine of at least ``floor``."""
    near = nearest(chunks.where("chunk_level = 'child'"), "chunk_id", "embedding", k, floor)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()
