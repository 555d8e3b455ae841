import random
from collections import Counter

import pytest
from oddities import BASE, empty, odd

from loomlog.llm import sharding


@pytest.mark.parametrize(("good", "bad", "draws"), [(5, 7, 4), (30, 3, 20), (1, 1, 1), (0, 9, 3), (9, 0, 3), (400, 600, 100)])
def test_hypergeometric(good, bad, draws):
    rng = random.Random(1)
    n = 20_000
    got = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    from math import comb

    for k in range(draws + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if k <= good and draws - k <= bad else 0
        assert abs(got[k] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-9 + (0 if p else 0)


def test_large_counts_are_possible():
    rng = random.Random(2)
    k = sharding.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 10**9)
    assert abs(k - 4 * 10**8) < 10**6


def test_matrix_sums():
    rng = random.Random(3)
    partitions, shards = [rng.randrange(50) for _ in range(30)], [0] * 7
    for _ in range(sum(partitions)):
        shards[rng.randrange(7)] += 1
    m = sharding.communication_matrix(partitions, shards, 5)
    assert [sum(r) for r in m] == partitions and [sum(c) for c in zip(*m, strict=True)] == shards
    assert sharding.communication_matrix([], [0, 0], 1) == []


def check(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_exact_sizes_and_a_uniform_shuffle(spark):
    df = spark.range(0, 3000, 1, 7).withColumnRenamed("id", "doc_id")
    rows = sharding.shuffle_to_shards(df, 24).collect()
    check(rows, 24)
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    again = sharding.shuffle_to_shards(df, 24).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    assert {tuple(r) for r in rows} != {tuple(r) for r in sharding.shuffle_to_shards(df, 24, seed=1).collect()}
    # neither shard nor place depends on where a row came from
    first = [r for r in rows if r["doc_id"] < 1500]
    assert abs(sum(r["shard"] for r in first) / 1500 - 11.5) < 1
    assert abs(sum(r["slot"] for r in first) / 1500 - 62) < 5


def test_pairs_of_rows_meet_as_chance_has_it(spark):
    met = 0
    for seed in range(60):
        rows = {r["id"]: r["shard"] for r in sharding.shuffle_to_shards(spark.range(0, 8, 1, 2), 2, seed).collect()}
        met += sum(rows[a] == rows[b] for a in range(8) for b in range(a))
    assert abs(met / 60 / 28 - 3 / 7) < 0.01  # sizes of 4: exactly that share of pairs in every run


def test_odd_and_empty_tables(spark):
    rows = sharding.shuffle_to_shards(odd(spark), 4).collect()
    check(rows, 4)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in BASE)
    assert sharding.shuffle_to_shards(empty(spark), 4).collect() == []
