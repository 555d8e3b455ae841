"""Change-log operators against the sequential store and the literal cases of the store's rules."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomlog.functions import binary, hashing
from loomlog.operators import blocked, cluster, layout, merge, metrics, oplog, state
from simulator import Store, random_ops

OPS = "seq bigint, op string, key string, value string"


def frame(spark, ops):
    return spark.createDataFrame([(s, o, k, v) for s, o, k, v in ops], OPS)


def run(ops, shards=8):
    store = Store(shards)
    for op in ops:
        store.apply(*op)
    return store


def as_state(df):
    return {r["key"]: {c: r[c] for c in ("value", "version", "write_id", "tombstone", "shard")} for r in df.collect()}


def puts(*pairs):
    return [(i, *p) for i, p in enumerate(pairs)]


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_equal_the_sequential_store(spark, seed):
    ops = random_ops(seed, 600, 12)
    store = run(ops)
    df = frame(spark, ops)
    log = oplog.build(df)
    assert sorted(tuple(r) for r in log.collect()) == sorted(store.log)
    assert as_state(state.materialize(log)) == store.entries
    told = {r["seq"]: r["status"] for r in oplog.statuses(df).collect()}
    assert told == {s: x[0] for s, x in store.replies.items() if ops[s][1] != "GET"}
    reads = {r["seq"]: (r["status"], r["value"]) for r in state.reads_as_of(df).collect()}
    assert reads == {s: x for s, x in store.replies.items() if ops[s][1] == "GET"}


def test_fifty_small_logs(spark):
    every, expected = [], {}
    for seed in range(50):
        ops = [(s + seed * 1000, o, f"{seed}-{k}" if k and len(k) < 1000 else k, v) for s, o, k, v in random_ops(100 + seed, 60, 4)]
        every += ops
    expected = run(every).entries
    assert as_state(state.materialize(oplog.build(frame(spark, every)))) == expected


@pytest.mark.parametrize(
    ("ops", "key", "value", "version", "tombstone"),
    [
        (puts(("PUT", "a", "1"), ("PUT", "a", "2")), "a", "2", 2, False),
        (puts(("PUT", "a", "1"), ("DELETE", "a", None)), "a", None, 2, True),
        (puts(("PUT", "a", "1"), ("DELETE", "a", None), ("PUT", "a", "2")), "a", "2", 3, False),
        (puts(("PUT", "a", "1"), ("DELETE", "a", None), ("DELETE", "a", None)), "a", None, 2, True),
        (puts(("PUT", "a", "")), "a", "", 1, False),
    ],
)
def test_literal_cases(spark, ops, key, value, version, tombstone):
    e = as_state(state.materialize(oplog.build(frame(spark, ops))))[key]
    assert (e["value"], e["version"], e["tombstone"]) == (value, version, tombstone)


def test_limits_are_checked_in_order_and_use_up_no_number(spark):
    ops = puts(("PUT", "", "x" * ((1 << 20) + 1)), ("PUT", "k" * 1025, ""), ("PUT", "k", "x" * ((1 << 20) + 1)), ("PUT", "é" * 513, ""), ("PUT", "k" * 1024, "x" * (1 << 20)), ("DELETE", "", None))
    df = frame(spark, ops)
    told = {r["seq"]: r["status"] for r in oplog.statuses(df).collect()}
    assert told == {0: "EMPTY_KEY", 1: "KEY_TOO_LARGE", 2: "VALUE_TOO_LARGE", 3: "KEY_TOO_LARGE", 4: "OK", 5: "NOT_FOUND"}
    assert [(r["write_id"], r["version"]) for r in oplog.build(df).collect()] == [(1, 1)]


def test_a_failed_delete_uses_up_no_write_id(spark):
    log = oplog.build(frame(spark, puts(("DELETE", "a", None), ("PUT", "a", "1"))), 1).collect()
    assert [(r["write_id"], r["op"]) for r in log] == [(1, "PUT")]


def test_hash_and_shards(spark):
    rng = random.Random(1)
    keys = [bytes(rng.randrange(256) for _ in range(rng.randrange(30))) for _ in range(300)] + [b"", "é".encode()]
    h = hashing.fnv1a(F.col("k"))
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select("k", h.alias("h"), *[hashing.shard(F.col("k"), n).alias(f"m{n}") for n in (1, 3, 6, 8, 16, 2**31 - 1)]).collect()
    for r in rows:
        want = hashing.fnv1a_int(bytes(r["k"]))
        assert (r["h"]["hi"] << 32 | r["h"]["lo"]) == want
        assert all(r[f"m{n}"] == want % n for n in (1, 3, 6, 8, 16, 2**31 - 1))
    with pytest.raises(ValueError):
        hashing.unsigned_mod(h, 0)


def test_shards_are_even_and_empty_shards_have_rows(spark):
    keys = spark.range(120_000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    assert all(abs(r["deviation"]) < 0.1 for r in layout.distribution(keys, 8).collect())
    assert len(layout.distribution(keys.limit(1), 8).collect()) == 8
    assert [r["keys"] for r in layout.distribution(keys.limit(0), 3).collect()] == [0, 0, 0]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_blocked_windows_equal_plain_ones(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(9)])) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "p string, o bigint, v bigint")
    for f, value in ((blocked.lag, F.col("v")), (blocked.prior_max, F.col("v")), (blocked.prior_sum, F.col("v"))):
        got = {(r["p"], r["o"]): r["x"] for r in f(df, ["p"], "o", value, "x", width).collect()}
        for p in ("a", "b", None):
            own = sorted((o, v) for q, o, v in rows if q == p)
            for k, (o, _) in enumerate(own):
                before = [v for _, v in own[:k]]
                some = [v for v in before if v is not None]
                want = {"lag": before[-1] if before else None, "prior_max": max(some, default=None), "prior_sum": sum(some)}[f.__name__]
                assert got[p, o] == want


@pytest.mark.parametrize("block", [1, 3, 50])
def test_the_log_does_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(blocked, "BLOCK", block)
    ops = random_ops(block, 250, 5)
    log = oplog.build(frame(spark, ops), 4).collect()
    want = Store(4)
    for op in ops:
        want.apply(*op)
    assert sorted(map(tuple, log)) == sorted(want.log)
    assert {r["seq"]: r["status"] for r in oplog.statuses(frame(spark, ops)).collect()} == {q: s for q, (s, _) in want.replies.items() if ops[q][1] != "GET"}
    # in two batches, the second on what the first has left
    first, second = frame(spark, ops[:120]), frame(spark, ops[120:])
    one = oplog.build(first, 4).cache()
    known = state.materialize(one).select("key", "version", (~F.col("tombstone")).alias("live"))
    two = oplog.build(second, 4, known, state.boundary(one).withColumnRenamed("boundary_write_id", "write_id"))
    assert sorted(map(tuple, one.collect() + two.collect())) == sorted(want.log)


def test_recovery_skips_up_to_the_boundary_and_counts_what_it_scans(spark):
    ops = random_ops(7, 300, 8)
    log = oplog.build(frame(spark, ops)).cache()
    bounds = log.groupBy("shard").agg(F.floor(F.max("write_id") / 2).alias("boundary_write_id"))
    old = state.materialize(log.join(bounds, "shard").where(F.col("write_id") <= F.col("boundary_write_id")).drop("boundary_write_id"))
    assert as_state(state.recover(old, bounds, log)) == run(ops).entries
    counts = state.replay_counts(bounds, log).collect()
    assert sum(r["scanned"] for r in counts) == log.count() and all(r["applied"] == r["scanned"] - r["scanned"] // 2 for r in counts)


def test_replication_takes_only_what_is_above_all_before(spark):
    rng = random.Random(5)
    came = [(s, a, rng.randrange(1, 60)) for s in range(3) for a in range(80)]
    got = {(r["shard"], r["arrival"]) for r in merge.accept_replicated(spark.createDataFrame(came, "shard int, arrival bigint, write_id bigint")).collect()}
    high, want = {}, set()
    for s, a, w in came:
        if w > high.get(s, 0):
            high[s] = w
            want.add((s, a))
    assert got == want


def test_migration_keeps_the_newest_in_any_order(spark):
    for rows in ([("k", 10, 3), ("k", 4, 1)], [("k", 4, 1), ("k", 10, 3)]):
        assert [tuple(r) for r in merge.newest_wins(spark.createDataFrame(rows, "key string, write_id bigint, version bigint")).collect()] == [("k", 10, 3)]


def test_reshard_keeps_everything(spark):
    before = state.materialize(oplog.build(frame(spark, random_ops(3, 400, 60)), 4))
    after = layout.reshard(before, 6)
    row = layout.lost_and_added(before, after).first()
    assert row["before"] == row["after"] and row["lost"] == row["added"] == row["changed"] == 0
    assert all(r["shard"] == hashing.shard_of(r["key"], 6) for r in after.collect())


def test_segments_and_truncation(spark):
    log = spark.createDataFrame([(0, i, "k", "v" * n) for i, n in enumerate([10, 50, 70, 200, 1, 1], 1)], "shard int, write_id bigint, key string, value string")
    cut = layout.assign_segments(log, 128).select("shard", "write_id", "segment")
    assert [r["segment"] for r in cut.orderBy("write_id").collect()] == [1, 1, 2, 3, 4, 4]
    bounds = spark.createDataFrame([(0, 3)], "shard int, boundary_write_id bigint")
    assert sorted(r["segment"] for r in layout.truncatable(cut, bounds).collect()) == [1, 2]
    everything = spark.createDataFrame([(0, 99)], "shard int, boundary_write_id bigint")
    assert 4 not in {r["segment"] for r in layout.truncatable(cut, everything).collect()}


def greedy(sizes, limit):
    segment, used, out = 1, 0, []
    for size in sizes:
        if used and used + size > limit:
            segment, used = segment + 1, 0
        used += size
        out.append(segment)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_segments_by_blocks_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    largest, limit = rng.choice([(5, 100), (60, 120), (300, 128), (10, 400)])
    sizes = {s: [33 + 1 + rng.randrange(largest) for _ in range(rng.choice([1, 40, 90]))] for s in range(4)}
    rows = [(s, i, "k", "v" * (n - 34)) for s, own in sizes.items() for i, n in enumerate(own, 1)]
    log = spark.createDataFrame(rows, "shard int, write_id bigint, key string, value string")
    cut = layout.assign_segments(log, limit, width=rng.choice([1, 4, 16, 1000]), piece=rng.choice([1, 3, 1024])).collect()
    for s, own in sizes.items():
        assert [r["segment"] for r in sorted((r for r in cut if r["shard"] == s), key=lambda r: r["write_id"])] == greedy(own, limit)


def shard_in_batches(rows):
    """One shard's sizes as a Python worker gets them, in batches that are made when they are asked for."""
    for i in range(1, rows + 1, 10_000):
        ids = np.arange(i, min(i + 10_000, rows + 1))
        yield pd.DataFrame({"shard": 0, "_block": ids // layout.SEGMENT_BLOCK, "write_id": ids, "bytes": 40 + ids * 7919 % 50})


def peak_bytes(made):
    tracemalloc.start()
    try:
        for _ in made:
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("limit", [4096, 1 << 40])
def test_answers_of_a_larger_shard_need_no_more_memory(limit):
    small, large = (peak_bytes(layout._answering(limit)(shard_in_batches(n))) for n in (1 << 17, 1 << 20))
    assert large < 1.2 * small and large < 32 << 20


def test_places_in_a_larger_shard_need_no_more_memory():
    def placed(rows, limit=4096):
        begins = pd.concat(layout._chaining(layout._answering(limit)(shard_in_batches(rows)))).set_index("_block")
        known = (batch.assign(segment=begins["segment"].loc[batch["_block"]].to_numpy(), used=begins["used"].loc[batch["_block"]].to_numpy()) for batch in shard_in_batches(rows))
        return layout._placing(limit, layout.SEGMENT_PIECE)(known)

    small, large = peak_bytes(placed(1 << 17)), peak_bytes(placed(1 << 20))
    assert large < 1.2 * small and large < 32 << 20


def test_segments_over_blocks_of_the_default_width(spark):
    rows, limit = 3 * layout.SEGMENT_BLOCK + 5, 4096
    log = spark.range(1, rows + 1).select(F.lit(0).alias("shard"), F.col("id").alias("write_id"), F.lit("k").alias("key"), F.expr("repeat('v', cast(id * 7919 % 50 as int))").alias("value"))
    cut = layout.assign_segments(log, limit).select("write_id", "segment").toPandas().sort_values("write_id")
    assert cut["segment"].tolist() == greedy([34 + i * 7919 % 50 for i in range(1, rows + 1)], limit)


def test_throttle(spark):
    log = spark.createDataFrame([(0, 1, "k", "v" * 9), (0, 2, "k", None), (1, 1, "kk", "vvv")], "shard int, write_id bigint, key string, value string")
    assert {(r["shard"], r["write_id"]): r["done_ms"] for r in layout.throttled(log, 10).collect()} == {(0, 1): 1000, (0, 2): 1100, (1, 1): 500}
    assert {r["done_ms"] for r in layout.throttled(log, 0).collect()} == {0}


def test_epochs(spark):
    events = spark.createDataFrame([(0, 1, 5), (0, 2, 4), (0, 3, 9), (0, 4, 5)], "node int, arrival bigint, term bigint")
    assert [r["verdict"] for r in cluster.fence(events, 5).orderBy("arrival").collect()] == ["ACCEPT", "REJECT", "ADOPT", "REJECT"]


@pytest.mark.parametrize(
    ("peers", "decision", "port"),
    [
        ([(7001, 1, 0, True)], "PROMOTE", 7000),
        ([(7001, 1, 50, True)], "STAND_BACK", 7001),
        ([(7001, 1, 50, False)], "PROMOTE", 7000),
        ([(7001, 1, 10, True), (6999, 1, 10, True)], "STAND_BACK", 6999),
        ([(7001, 2, 0, True)], "ADOPT", None),
        ([], "PROMOTE", 7000),
    ],
)
def test_elections(spark, peers, decision, port):
    df = spark.createDataFrame(peers, "port bigint, epoch bigint, total bigint, reachable boolean")
    row = cluster.election(df, 7000, 10, 1).first()
    assert (row["decision"], row["winner_port"]) == (decision, port)
    assert cluster.links_after_promotion(cluster.election(df, 7000, 10, 1), df).count() == (len(peers) if decision == "PROMOTE" else 0)


@pytest.mark.parametrize(
    ("role", "opcode", "outcome", "term", "shard", "status"),
    [
        ("leader", "PUT", "OK", 0, 0, "OK"),
        ("leader", "PUT", "EMPTY_KEY", 0, 0, "BAD_REQUEST"),
        ("leader", "GET", "NOT_FOUND", 0, 0, "NOT_FOUND"),
        ("follower", "DELETE", "OK", 0, 0, "NOT_LEADER"),
        ("leader", "REPLICATE", None, 1, 0, "BAD_REQUEST"),
        ("follower", "REPLICATE", None, 3, 0, "STALE_TERM"),
        ("follower", "REPLICATE", None, 7, 0, "OK"),
        ("follower", "CATCHUP_QUERY", None, 3, 8, "BAD_REQUEST"),
        ("follower", "CATCHUP_QUERY", None, 3, 7, "STALE_TERM"),
        ("leader", "HEARTBEAT", None, 3, 0, "STALE_TERM"),
        ("leader", "HEARTBEAT", None, 9, 0, "OK"),
        ("follower", "ELECTION_QUERY", None, 0, 0, "OK"),
        ("leader", "NOTHING", None, 0, 0, "BAD_REQUEST"),
    ],
)
def test_dispatch(spark, role, opcode, outcome, term, shard, status):
    col = lambda x, t: F.lit(x).cast(t)
    told = cluster.dispatch(col(role, "string"), col(opcode, "string"), col(outcome, "string"), term=col(term, "bigint"), epoch=col(7, "bigint"), shard=col(shard, "bigint"), shards=8)
    assert spark.range(1).select(told.alias("s")).first()["s"] == status


def test_percentiles_are_by_floor_index(spark):
    rng = random.Random(2)
    rows = [("a", float(i)) for i in range(1, 101)] + [("b", rng.choice([0.5, 1.5, 9.0])) for _ in range(37)] + [("c", 3.0), ("d", None)]
    got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in metrics.floor_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in "abc":
        own = sorted(v for h, v in rows if h == g)
        assert got[g] == tuple(own[min(p * len(own) // 100, len(own) - 1)] for p in (50, 95, 99))
    assert got["a"][0] == 51.0 and "d" not in got


def test_replica_difference_and_responses(spark):
    a = spark.createDataFrame([(0, "x", "1", 1, 1, False), (0, "y", "1", 1, 2, False)], "shard int, key string, value string, version bigint, write_id bigint, tombstone boolean")
    b = spark.createDataFrame([(0, "x", "2", 2, 3, False), (0, "z", None, 2, 4, True)], a.schema)
    assert {(r["key"], r["difference"]) for r in cluster.replica_diff(a, b).collect()} == {("x", "CHANGED"), ("y", "MISSING"), ("z", "EXTRA")}
    q, r = (spark.createDataFrame([(i,) for i in ids], "request_id bigint") for ids in ([1, 2, 3], [2, 3, 4]))
    assert tuple(cluster.match_responses(q, r).first()) == (3, 3, 1, 1)


def test_replies_that_are_too_short_decode_to_zero(spark):
    row = spark.createDataFrame([(bytearray(b"\0\0"), bytearray((7).to_bytes(8, "big") + (9).to_bytes(8, "big")))], "s binary, l binary")
    got = row.select(binary.decode_last_applied(F.col("s")).alias("a"), binary.decode_last_applied(F.col("l")).alias("b"), binary.decode_election_reply(F.col("s")).alias("c"), binary.decode_election_reply(F.col("l")).alias("d")).first()
    assert (got["a"], got["b"], tuple(got["c"]), tuple(got["d"])) == (0, 7, (0, 0), (7, 9))


def test_peers_and_roles(spark):
    df = spark.createDataFrame([("a:1,,b.example:6380",), ("",)], "peers string")
    assert [tuple(r) for r in cluster.parse_peers(df).collect()] == [("a", 1), ("b.example", 6380)]
    for bad in ("a", "a:", "a:x"):
        with pytest.raises(Exception, match="not host:port"):
            cluster.parse_peers(spark.createDataFrame([(bad,)], "peers string")).collect()
    roles = lambda r: spark.createDataFrame([(r,)], "r string").select(cluster.checked_role(F.col("r")).alias("r")).collect()
    assert roles("leader")[0]["r"] == "leader"
    with pytest.raises(Exception, match="not a role"):
        roles("king")
    state_ = spark.createDataFrame([(0, "a"), (3, "b"), (3, "c")], "shard int, key string")
    assert cluster.shards_with_data(state_).first()["shards"] == 2


def test_workload_mix(spark):
    ops = spark.range(10_000).withColumnRenamed("id", "seq")
    for read, write in ((90, 10), (10, 90), (45, 45)):
        got = {r["op"]: r["n"] for r in metrics.mix_counts(metrics.workload_mix(ops, read, write)).collect()}
        assert got.get("GET") == read * 100 and got.get("PUT") == write * 100 and got.get("DELETE", 0) == (100 - read - write) * 100
