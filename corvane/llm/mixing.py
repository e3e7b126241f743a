"""Problem 9: mixing sources to target weights.

The weights are the target shares (or any base shares) to a power. The power is
1 as long as no source would have to be repeated more than it may be; otherwise
it is found by bisection, as it is for a target entropy. A source's budget is
then spent in whole passes over its records and a last pass in the order of a
permutation, cut where the budget ends: block by block, so that no source is
ever sorted in one place.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks of a source's permutation; a block is the unit of the running sums.
BLOCKS = 4096


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    """Shares above 0 to a power, of sum 1."""
    live = {s: v for s, v in shares.items() if v > 0}
    top = max(live.values(), default=1.0)
    raw = {s: (v / top) ** power for s, v in live.items()}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(v * log(v) for v in shares.values() if v > 0)


def _bisect(holds, low: float, high: float) -> float:
    """The largest power in [low, high] that holds, where smaller ones hold too; ``low`` if none does."""
    if holds(high):
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def power_for_entropy(shares: dict[str, float], target: float) -> float:
    """The power at which the shares have the target entropy, 0 (even) to 64 (the largest alone)."""
    return _bisect(lambda p: entropy(tempered(shares, p)) >= target - 1e-12, 0.0, 64.0)


def plan(tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, power, total tokens) for sources with the given tokens, target shares and repeat limits.

    A listed source without tokens, with share 0 or that may not be used is
    left out and the others' shares are scaled to 1. Without ``total`` the
    total is the largest at which every source reaches its share with no
    record repeated more than allowed, and the power is 1. With ``total`` and
    a limit in the way, the power is the largest up to 1 that keeps all
    limits; if not even equal weights keep them, each source over its limit
    gives what it may and the rest share what is left.
    """
    room = {s: tokens[s] * repeats.get(s, 1) for s in shares if shares[s] > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 1) > 0}
    base = {s: shares[s] for s in room}
    if not base:
        return {}, 1.0, 0.0
    w = tempered(base, 1.0)
    if total is None:
        return w, 1.0, min(room[s] / w[s] for s in w)
    total = min(total, sum(room.values()))
    keeps = lambda p: all(v * total <= room[s] * (1 + 1e-12) for s, v in tempered(base, p).items())
    if keeps(1.0):
        return w, 1.0, float(total)
    if keeps(0.0):
        power = _bisect(keeps, 0.0, 1.0)
        return tempered(base, power), power, float(total)
    full: set[str] = set()
    while True:
        left = total - sum(room[s] for s in full)
        rest = {s: v for s, v in base.items() if s not in full}
        share = left / len(rest) if rest else 0
        over = {s for s in rest if share > room[s]}
        if not over:
            return {s: (room[s] if s in full else share) / total for s in base}, 0.0, float(total)
        full |= over


def select(records: DataFrame, weights: dict[str, float], tokens: dict[str, int], total: float) -> DataFrame:
    """(id, source, tokens, times): the records (id, source, tokens) that are drawn and how often.

    Every record of a source is used in each whole pass; the last pass takes
    the records in the order of a hash up to the budget: whole blocks by a
    running sum over the blocks' sums, and inside the block where it ends by a
    running sum over its records; the record on the edge is taken if half of it
    fits. So a source misses its budget by at most half a record.
    """
    spark = records.sparkSession
    plans = []
    for s, w in weights.items():
        budget = int(w * total + 1e-6)
        plans.append((s, budget // tokens[s], budget % tokens[s]))
    goal = spark.createDataFrame(plans, "source string, passes bigint, rest bigint") if plans else spark.createDataFrame([], "source string, passes bigint, rest bigint")
    h = F.xxhash64(F.lit(41), "id")
    r = records.select("id", "source", "tokens").join(F.broadcast(goal), "source").withColumn("h", h).withColumn("block", F.shiftrightunsigned("h", 52).cast("int"))
    sums = r.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("size"))
    order = Window.partitionBy("source").orderBy("block")
    sums = sums.withColumn("ends", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = sums.where("ends > rest").groupBy("source").agg(F.min("block").alias("last"), F.min(F.struct("block", (F.col("ends") - F.col("size")).alias("before"))).getField("before").alias("before"))
    r = r.join(F.broadcast(last), "source", "left")
    within = Window.partitionBy("source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = r.where("block = last").withColumn("ends", F.sum("tokens").over(within)).withColumn("extra", (F.col("before") + F.col("ends") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    rest = r.where("last is null or block <> last").withColumn("extra", F.coalesce((F.col("block") < F.col("last")).cast("int"), F.lit(1)))
    cols = ["id", "source", "tokens", (F.col("passes") + F.col("extra")).alias("times")]
    return rest.select(*cols).unionByName(edge.select(*cols)).where("times > 0")


def draw(records: DataFrame, targets: DataFrame, total: int | None = None, entropy_of_targets: bool = False) -> tuple[DataFrame, DataFrame]:
    """The selection (id, source, tokens, times) and the report of the shares reached.

    With ``entropy_of_targets`` the base shares are those of the sources' own
    tokens, and the power is bisected until the weights are as even as the
    targets are (their entropy).

    ``records`` (id, source, tokens), ``targets`` (source, target_share,
    max_repeats; at most 10,000 sources, each once). Sources that aren't listed
    aren't drawn; null sources, ids and sizes neither, nor records of 0 tokens.
    The report has every listed source: its target, the weight it was given,
    the tokens drawn, the share reached and the most uses of one record.
    """
    rows = targets.where("source is not null").limit(10001).collect()
    if len(rows) > 10000 or len({r.source for r in rows}) < len(rows):
        raise ValueError("targets need at most 10,000 sources, each once")
    shares = {r.source: float(r.target_share or 0) for r in rows}
    repeats = {r.source: int(r.max_repeats) if r.max_repeats is not None else 1 for r in rows}
    good = records.where("id is not null and source is not null and tokens > 0")
    held = {r.source: int(r.n) for r in good.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    if entropy_of_targets:
        own = {s: n / sum(held.values()) for s, n in held.items()}
        goal = entropy(tempered({s: shares[s] for s in own}, 1.0))
        first = power_for_entropy(own, goal)
        weights, power, total_tokens = plan(held, tempered(own, first), repeats, total)
        power *= first
    else:
        weights, power, total_tokens = plan(held, shares, repeats, total)
    chosen = select(good, weights, held, total_tokens)
    return chosen, report(records.sparkSession, chosen, shares, weights, power)


def report(spark: SparkSession, chosen: DataFrame, shares: dict[str, float], weights: dict[str, float], power: float) -> DataFrame:
    """(source, target_share, weight, power, records, drawn_tokens, reached_share, most_uses) for every listed source."""
    rows = [(s, v, weights.get(s, 0.0), power) for s, v in shares.items()]
    goal = spark.createDataFrame(rows, "source string, target_share double, weight double, power double")
    per = chosen.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("times")).alias("drawn_tokens"), F.max("times").alias("most_uses"))
    all_of = per.agg(F.sum("drawn_tokens").alias("all_tokens"))
    out = goal.join(per, "source", "left").crossJoin(F.broadcast(all_of))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("source", "target_share", "weight", "power", zero("records").alias("records"), zero("drawn_tokens").alias("drawn_tokens"), F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"), zero("most_uses").alias("most_uses"))
