"""Problem 2: records that share most of their words.

SuperMinHash signatures (each word puts a random permutation of ranks over the
slots, the least rank stays, and a record stops as soon as no later rank can
win), bands of slots, exact verification of the candidates, and union-find.
Equal word sets are one class from the start and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.grouping import components, mix64, row_hash, whole_groups
from corvane.llm.similar_vectors import _binary, _matrix

BANDS, ROWS = 24, 6
SKETCH = 32
TILE = 1024
SALT = 16


def super_min_hash(hashes: np.ndarray, offsets: np.ndarray, slots: int, seed: int = 0) -> tuple[np.ndarray, int]:
    """Signatures of sets of 64-bit hashes; set ``i`` is ``hashes[offsets[i]:offsets[i + 1]]``.

    In round ``r`` every element draws the slot its permutation has at place
    ``r`` (one step of a shuffle) and a fraction ``u``; the slot keeps the least
    ``r + u``. A set whose slots are all below ``r + 1`` is finished. Also gives
    the rounds that were needed. An empty set keeps infinity in every slot.
    """
    n = len(offsets) - 1
    sig = np.full((n, slots), np.inf)
    words, code = np.unique(hashes, return_inverse=True)
    base = mix64(words.view(np.uint64) ^ np.uint64(seed))
    perm = np.tile(np.arange(slots, dtype=np.int16), (len(words), 1))
    sets = np.repeat(np.arange(n), np.diff(offsets))
    every = np.arange(len(words))
    live = np.ones(n, bool)
    r = 0
    while r < slots and len(sets):
        with np.errstate(over="ignore"):
            z = mix64(base + np.uint64(2 * r + 1) * np.uint64(0xD1B54A32D192ED03))
        frac = (z >> np.uint64(11)).astype(np.float64) * 2.0**-53
        jump = r + (mix64(z) % np.uint64(slots - r)).astype(np.int64)
        drawn = perm[every, jump].copy()
        perm[every, jump] = perm[:, r]
        perm[:, r] = drawn
        np.minimum.at(sig, (sets, drawn[code]), r + frac[code])
        r += 1
        live &= sig.max(1) > r
        keep = live[sets]
        sets, code = sets[keep], code[keep]
        if len(code) < len(words):  # words of finished sets draw no more
            used, code = np.unique(code, return_inverse=True)
            base, perm, every = base[used], perm[used], np.arange(len(used))
            words = words[used]
    return sig, r


def word_hashes(text: str = "text") -> F.Column:
    """Sorted distinct 64-bit hashes of the words of a column: longest runs of letters and digits, in lower case."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))))


def classes(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, c1, c2, words, t1, t2): rows with enough words; rows with equal (c1, c2) have the same words, with equal (t1, t2) the same text."""
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    d = d.select("id", word_hashes().alias("words"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")).where(F.size("words") >= max(1, min_words))
    return d.select("id", F.xxhash64("words").alias("c1"), F.xxhash64(F.lit(7), "words", F.lit(11)).alias("c2"), "words", "t1", "t2")


def class_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a1, a2, b1, b2, similarity): classes of :func:`classes` whose Jaccard similarity is at least ``threshold``."""
    reps = rows.groupBy("c1", "c2").agg(F.first("words").alias("words"))
    slots = BANDS * ROWS

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                b = big.slice(lo, 2048)
                col = b.column(2)
                sizes = col.value_lengths().to_numpy()
                h = col.flatten().to_numpy()
                sig, _ = super_min_hash(h, np.r_[0, np.cumsum(sizes)], slots)
                bits = sig.view(np.uint64)
                c1, c2 = b.column(0), b.column(1)
                # one bit a slot and function, for a first look inside the bucket
                wide = np.concatenate([mix64(bits ^ np.uint64(s + 1)) >> np.uint64(63) for s in range(-(-SKETCH * 8 // slots))], 1)[:, : SKETCH * 8]
                look = _binary(np.packbits(wide.astype(np.uint8), axis=1))
                n = pa.array(sizes.astype(np.int32))
                for k in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(row_hash(bits[:, k * ROWS : (k + 1) * ROWS], k + 1)), c1, c2, n, look], ["bucket", "c1", "c2", "n", "look"])

    # salted, as one bucket may hold a third of all rows; its size is added up from the parts
    bands = reps.mapInArrow(band, "bucket bigint, c1 bigint, c2 bigint, n int, look binary").withColumn("salt", F.pmod("c2", F.lit(SALT)).cast("int")).repartition("bucket", "salt")
    held = bands.groupBy("bucket", "salt").agg(F.count("*").alias("held")).groupBy("bucket").agg(F.sum("held").alias("held")).where("held > 1")
    many = held.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALT)))))
    near = bands.join(many, ["bucket", "salt"]).withColumn("g", F.ceil(F.col("held") / TILE).cast("int"))
    # a bucket above TILE rows is cut into g parts; every two parts meet in one tile
    near = near.withColumn("own", F.pmod("c1", F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tiles = near.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "c1", "c2", "n", "look")
    tiles = tiles.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    # where the sketches of two sets at the threshold differ less than 6 deviations from the mean
    p = (1 + threshold) / 2
    most = int(SKETCH * 8 * (1 - p) + 6 * np.sqrt(SKETCH * 8 * p * (1 - p))) + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["bucket", "lo", "hi"]):
            look = _matrix(t.column("look"), np.uint64, SKETCH // 8)
            c1, c2, n = (t.column(c).to_numpy() for c in ("c1", "c2", "n"))
            lo, hi, own = (t.column(c).to_numpy() for c in ("lo", "hi", "own"))
            ends = np.r_[starts[1:], len(t)]
            two = ends - starts == 2
            left, right = [starts[two]], [starts[two] + 1]
            for s, e in zip(starts[~two], ends[~two]):
                for at in range(s, e, 512):
                    d = np.bitwise_count(look[at : min(e, at + 512), None] ^ look[None, s:e]).sum(2)
                    i, j = np.nonzero(d <= most)
                    i, j = i + at, j + s
                    keep = i < j if lo[s] == hi[s] else own[i] < own[j]
                    left.append(i[keep])
                    right.append(j[keep])
            i, j = np.concatenate(left), np.concatenate(right)
            far = np.bitwise_count(look[i] ^ look[j]).sum(1) > most if len(i) else np.zeros(0, bool)
            keep = ~far & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & ((c1[i] != c1[j]) | (c2[i] != c2[j]))
            i, j = i[keep], j[keep]
            swap = (c1[i] > c1[j]) | ((c1[i] == c1[j]) & (c2[i] > c2[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c1[i], c2[i], c1[j], c2[j])], ["a1", "a2", "b1", "b2"])

    cand = tiles.mapInArrow(meet, "a1 bigint, a2 bigint, b1 bigint, b2 bigint").distinct()
    side = lambda s: reps.select(F.col("c1").alias(s + "1"), F.col("c2").alias(s + "2"), F.col("words").alias(s + "w"))
    both = cand.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    same = F.size(F.array_intersect("aw", "bw"))
    sim = same / (F.size("aw") + F.size("bw") - same)
    return both.select("a1", "a2", "b1", "b2", sim.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def links(df: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_text", threshold: float = 0.8, min_words: int = 20, expand: int = 64) -> DataFrame:
    """Pairs ``(id_a, id_b, similarity)`` of different ids, the smaller first, whose word sets agree to at least ``threshold``.

    Rows with a null id or text, or fewer than ``min_words`` words, have no
    pairs; an id delivered twice counts once for each different text. Every
    link between different texts is given. Only a text that more than
    ``expand`` ids have as exact copies keeps one representative, its least id,
    which is linked to each copy and stands for them in links to other texts;
    so the result follows the number of rows. Word sets that many different
    texts share are joined in tiles. A missed link needs all 24 bands of 6
    slots to differ: at 0.8 fewer than 1 in 1000.
    """
    rows = classes(df, id_col, text_col, min_words)
    pairs = class_pairs(rows, threshold)
    text = ["c1", "c2", "t1", "t2"]
    member = rows.select("id", *text).distinct()
    copied = member.groupBy(*text).agg(F.min("id").alias("rep"), F.count("*").alias("held")).where(F.col("held") > expand).drop("held")
    star = member.join(copied, text).where("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    # the ids that stand for their text in links to other texts
    stand = member.join(copied, text, "left").where("rep is null or id = rep").select("c1", "c2", "id").distinct()
    size = stand.groupBy("c1", "c2").agg(F.count("*").alias("held")).where("held > 1")
    g = F.ceil(F.col("held") / TILE).cast("int")
    own, every = F.pmod(F.xxhash64("id"), F.col("g")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    inside = stand.join(size.select("c1", "c2", g.alias("g")), ["c1", "c2"])
    full = inside.select("c1", "c2", own.alias("tile"), F.col("id").alias("id_a")).join(inside.select("c1", "c2", every.alias("tile"), F.col("id").alias("id_b")), ["c1", "c2", "tile"])
    full = full.where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    large = size.where(F.col("held") > TILE).select("c1", "c2", g.alias("g"))
    cut = stand.join(large, ["c1", "c2"], "left").withColumn("g", F.coalesce("g", F.lit(1))).select("c1", "c2", own.alias("tile"), "id")
    across = pairs
    for s in "ab":
        name = lambda c: F.col(c).alias({"c1": s + "1", "c2": s + "2", "id": "i" + s}.get(c, c))  # noqa: B023, E731
        across = across.join(large.select(*map(name, ("c1", "c2", "g"))), [s + "1", s + "2"], "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("tile", every).drop("g")
        across = across.join(cut.select(*map(name, ("c1", "c2", "tile", "id"))), [s + "1", s + "2", "tile"]).drop("tile")
    across = across.where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")
    return full.unionByName(star).unionByName(across).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def groups(df: DataFrame, id_col: str = "chunk_id", text_col: str = "chunk_text", threshold: float = 0.8, min_words: int = 20) -> DataFrame:
    """One row for every id with enough words: ``(id, group_id, class_links)``.

    ``group_id`` is the least id that can be reached over links; ``class_links``
    the number of other word sets the row's own is linked to. Union-find runs
    over classes of equal word sets, so copies cost nothing there.
    """
    rows = classes(df, id_col, text_col, min_words)
    size = rows.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    # a word set is named by its least id; an id with two texts joins their sets
    name = lambda s: size.select(F.col("c1").alias(s + "1"), F.col("c2").alias(s + "2"), F.col("rep").alias("r" + s))
    edge = class_pairs(rows, threshold).join(name("a"), ["a1", "a2"]).join(name("b"), ["b1", "b2"]).select("ra", "rb")
    own = rows.select("id", "c1", "c2").distinct().join(size, ["c1", "c2"]).select("id", "rep")
    own = own.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    root = components(edge.unionByName(own.where("rep <> other").select(F.col("rep").alias("ra"), F.col("other").alias("rb"))), "ra", "rb")
    degree = edge.select(F.col("ra").alias("rep")).unionByName(edge.select(F.col("rb").alias("rep"))).groupBy("rep").agg(F.count("*").alias("class_links"))
    out = own.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("class_links", F.lit(0)).alias("class_links"))


def found(chunks: DataFrame) -> DataFrame:
    """p2_found: pairs of child chunks with a similarity of word sets of at least 0.8, both with 20 words or more."""
    return links(chunks.where("chunk_level = 'child'")).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))
