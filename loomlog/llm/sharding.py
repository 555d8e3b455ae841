"""Sharding [native]: a uniform shuffle of a whole table into shards of exact size.

Law ``rows``. The rows of partition p that go to shard s are counted before any row moves: the matrix of these
counts has the distribution that a uniform permutation of all rows gives it (multivariate hypergeometric, with the
partition sizes as row sums and the exact shard sizes as column sums). Each partition then permutes its rows and
deals them out by its row of the matrix, and each shard permutes what it gets. Only counts reach the driver, one
for each partition.
"""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import gapless_rank, stable


def _log_pmf(good: int, bad: int, draws: int, k: int) -> float:
    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    return choose(good, k) + choose(bad, draws - k) - choose(good + bad, draws)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken without replacement; inverts the distribution outwards from its mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    u = rng.random()
    p = math.exp(_log_pmf(good, bad, draws, mode))
    left, right, below, above = mode, mode, p, p
    u -= p
    while u >= 0 and (left > low or right < high):
        if right < high:
            above *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= above
            if u < 0:
                return right
        if left > low:
            below *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= below
            if u < 0:
                return left
    return mode


def communication_matrix(partitions: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Random counts with row sums ``partitions`` and column sums ``shards``, as a uniform permutation would give them."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for size in partitions:
        row, draws, rest = [], size, sum(left)
        for s, there in enumerate(left):
            rest -= there
            k = hypergeometric(rng, there, rest, draws)
            row.append(k)
            draws -= k
            left[s] = there - k
        matrix.append(row)
    return matrix


#: Most partitions that deal: the matrix and its broadcast have a row for each.
MOST_PARTITIONS = 4096
#: A partition's number is above these bits of monotonically_increasing_id, the row's place in it below.
_PLACE_BITS = 33


def shuffle_to_shards(rows: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard) to every row.

    Every assignment with shard sizes at most one apart is equally likely (up to the 64-bit random keys), and so is
    every order within a shard. The same layout of input partitions and seed give the same result. Nulls, repeated
    rows, ties and texts of any length are rows like any others; an empty table gives an empty one; input columns named
    ``shard`` or ``slot`` are replaced, others stay. Equal texts are spread independently. The table is written once to
    the checkpoint folder as it comes: give it narrow, and join texts later. The local permutation is a sort within
    each partition, which moves no row to another one; rows move once to be dealt into their places.
    """
    place = F.monotonically_increasing_id()
    fixed = stable(rows.drop("shard", "slot").coalesce(MOST_PARTITIONS).withColumn("_ll_rid", place))
    pid = F.shiftright("_ll_rid", _PLACE_BITS)
    counts = sorted((r["p"], r["n"]) for r in fixed.groupBy(pid.alias("p")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    random.Random(seed).shuffle(sizes)
    matrix = communication_matrix([n for _, n in counts], sizes, seed + 1)
    ends = [(p, list(itertools.accumulate(row))) for (p, _), row in zip(counts, matrix, strict=True)]
    bounds = rows.sparkSession.createDataFrame(ends, "_ll_pid bigint, _ll_ends array<bigint>")
    # the written table is read in the partitions it was written in: a row's place after the sort is its local rank
    mixed = fixed.sortWithinPartitions(F.xxhash64(F.lit(seed + 2), F.col("_ll_rid")), "_ll_rid").withColumn("_ll_at", place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    dealt = mixed.withColumn("_ll_pid", pid).join(F.broadcast(bounds), "_ll_pid")
    dealt = dealt.withColumn("shard", F.size(F.filter("_ll_ends", lambda e: e <= F.col("_ll_at")))).drop("_ll_ends", "_ll_at", "_ll_pid")
    return gapless_rank(stable(dealt), "shard", F.xxhash64(F.lit(seed + 3), F.col("_ll_rid")), total, "slot").drop("_ll_rid")

