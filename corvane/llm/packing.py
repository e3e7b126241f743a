"""Problem 8: filling containers of fixed capacity.

Bounded-space online best-fit: a fixed number of containers is open, a bitset
keyed by free space finds the one that an item leaves least space in, and where
a new one is needed and none may be opened the fullest closes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = 64
#: Items of one shard on average; shards are packed apart and leave at most OPEN partly filled containers each.
SHARD = 20000


class BestFit:
    """Packs sizes one after the other; :meth:`put` gives the container's number."""

    def __init__(self, capacity: int, most_open: int = OPEN) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.by_free: dict[int, list[int]] = {}
        self.bits = self.open = self.next = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_no = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_no

    def _give(self, bin_no: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(bin_no)
            self.bits |= 1 << free
            self.open += 1

    def put(self, size: int) -> int:
        if not 0 <= size <= self.capacity:
            raise ValueError("an item must fit an empty container")
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_no = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_no, free = self.next, self.capacity
            self.next += 1
        self._give(bin_no, free - size)
        return bin_no


def pack(items: DataFrame, capacities: dict[str, int], rows: int, id_col: str = "doc_id", most_open: int = OPEN) -> DataFrame:
    """(container_kind, container_id, id, piece_no, tokens) for every item (id, tokens) and kind of container.

    Each item has one row a kind; one above the capacity is cut into full
    containers and a rest, pieces numbered from 0. Items of 0 tokens take no
    space but have a container. An id given twice is two items. Null ids or
    sizes have no rows. The items are dealt to shards of about ``SHARD`` items
    (``rows`` is their number) by a hash of the id and packed there in the
    order of another, so the result doesn't hang on partitions. A container id
    is unique within its kind.
    """
    shards = max(1, -(-rows // SHARD))
    kinds = sorted(capacities.items())
    kind = items.schema[id_col].dataType.simpleString()
    d = items.select(F.col(id_col).alias("id"), F.col("tokens").cast("bigint").alias("tokens")).where("id is not null and tokens is not null")
    d = d.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("turn", F.xxhash64(F.lit(3), "id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, bins = None, {}
        for part in parts:
            out: list[tuple] = []
            for i, tokens, s in zip(part["id"], part["tokens"], part["shard"]):
                if s != shard:
                    shard, bins = s, {k: BestFit(c, most_open) for k, c in kinds}
                for k, c in kinds:
                    b = bins[k]
                    whole, rest = divmod(int(tokens), c) if tokens > c else (0, int(tokens))
                    for n in range(whole):
                        out.append((k, f"{s}-{b.next}", i, n, c))
                        b.next += 1
                    if rest or not whole:
                        out.append((k, f"{s}-{b.put(rest)}", i, whole, rest))
            yield pd.DataFrame(out, columns=["container_kind", "container_id", "id", "piece_no", "tokens"])

    dealt = d.repartition(min(shards, 20000), "shard").sortWithinPartitions("shard", "turn", "id", "tokens")
    return dealt.mapInPandas(run, f"container_kind string, container_id string, id {kind}, piece_no int, tokens bigint")


def capacities_of(containers: DataFrame) -> dict[str, int]:
    """The kinds of container; the table has at most 1,000 rows, a kind once, and capacities above 0."""
    rows = containers.where("container_kind is not null and capacity_tokens is not null").select("container_kind", "capacity_tokens").limit(1001).collect()
    if len(rows) > 1000 or any(r.capacity_tokens < 1 for r in rows) or len({r.container_kind for r in rows}) < len(rows):
        raise ValueError("containers need at most 1,000 different kinds with a capacity of at least 1")
    return {r.container_kind: int(r.capacity_tokens) for r in rows}
