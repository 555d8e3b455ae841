import math
import random
from collections import defaultdict

import pytest
from oddities import BASE, documents, empty, odd
from pyspark.sql import functions as F

from loomlog.llm import mixing


def reshared(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by sharing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return full | target
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 500, 10_000]) for s in ["a", "B", "é", "", None, "zz", "z"][: rng.randint(1, 7)]}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in got)


def check(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 2
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        epochs = {r["times"] for r in own if r["size"]}
        assert len(epochs) <= 2 and max(epochs, default=0) - min(epochs, default=0) <= 1  # complete epochs first
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6


def test_budgets_are_met_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, ""]), rng.randrange(1, 400), rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, weight double")
    one = mixing.mix(df).collect()
    check(one)
    assert {(r["doc_id"], r["times"]) for r in one} == {(r["doc_id"], r["times"]) for r in mixing.mix(df.repartition(7)).collect()}
    assert {(r["doc_id"], r["times"]) for r in one} != {(r["doc_id"], r["times"]) for r in mixing.mix(df, seed=1).collect()}


def test_rows_without_words_in_a_source_at_its_limit(spark):
    rows = [(i, "small", i % 2 * 5, 1.0) for i in range(40)] + [(100 + i, "large", 50, 1.0) for i in range(400)] + [(900, "none", 0, 1.0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, weight double")).collect()
    check(got)
    small = [r for r in got if r["source"] == "small"]
    assert {r["target"] for r in small} == {200.0} and {r["times"] for r in small} == {2}
    assert [r["times"] for r in got if r["source"] == "none"] == [0]


def test_better_documents_are_taken_more_often(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("weight"))
    rows = mixing.mix(df, share=0.3).collect()
    good = sum(r["times"] for r in rows if r["doc_id"] % 2 == 0) / 3000
    poor = sum(r["times"] for r in rows if r["doc_id"] % 2) / 3000
    # taken with the probability that an exponential of that rate is below the same bound
    bound = -math.log(1 - good)
    assert abs(poor - (1 - math.exp(-0.25 * bound))) < 0.03


def test_odd_and_empty_tables(spark):
    rows = mixing.mix(mixing.sized(odd(spark))).collect()
    assert len(rows) == len(BASE)
    check(rows)
    import re

    words = defaultdict(list)
    for i, t, *_ in BASE:
        words[i].append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r["size"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in words.items()}
    assert mixing.mix(mixing.sized(empty(spark))).collect() == []
    nothing = mixing.mix(mixing.sized(documents(spark, [(1, ""), (2, None)]))).collect()
    assert [(r["target"], r["taken"]) for r in nothing] == [(0, 0), (0, 0)]
    assert mixing.mix(spark.createDataFrame([(None, None, None, None)], "doc_id bigint, source string, size bigint, weight double")).first()["taken"] == 0
