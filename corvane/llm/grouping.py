"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def row_hash(words: np.ndarray, seed: int) -> np.ndarray:
    """One int64 for each row of a matrix of uint64; position and seed count."""
    # the seed is mixed first: seeds that differ in a few bits must not meet small words
    out = np.repeat(mix64(np.array([seed], np.uint64)), len(words))
    for j in range(words.shape[1]):
        out = mix64(out ^ words[:, j])
    return out.view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Arrow tables that hold whole groups of rows equal in ``keys``, with the groups' starts.

    The rows come in sorted by ``keys`` (integers). At most one group and one
    batch are held back, so the memory follows the largest group.
    """

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        first = tuple(t.column(k)[0].as_py() for k in keys)
        end = tuple(t.column(k)[len(t) - 1].as_py() for k in keys)
        if held and first == last and end == last:
            held.append(t)
            continue
        t = pa.concat_tables([*held, t]).combine_chunks()
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, s[-1]).combine_chunks(), s[:-1]
        held, last = [t.slice(s[-1])], end
    if held:
        t = pa.concat_tables(held).combine_chunks()
        yield t, np.zeros(1, np.int64)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Union-find in rounds: ``(node, root)`` for every node of ``edges``.

    Large-star and small-star steps in turn: each node links its larger
    neighbours, then its smaller ones, to the least node it knows, until
    nothing changes. No component and no list of neighbours is collected:
    every step is a minimum over a group, pre-aggregated before the shuffle.
    Empty edges give an empty result; edges with a null end count for nothing.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    cur = cut_lineage(cur.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # rows are distinct: two states are equal if their numbers and two sums of hashes are
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.xxhash64(F.lit(3), "v", "u") % (1 << 31))).first())
    now = state(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = cut_lineage(small)
        before, now = now, state(nxt)
        changed, cur = now != before, nxt
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
