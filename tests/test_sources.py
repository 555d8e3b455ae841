"""Codecs, the durable table and streams."""

import struct

import pytest
from pyspark.sql import functions as F

from loomlog import schemas
from loomlog.functions import binary
from loomlog.operators import layout, oplog, state
from loomlog.sources import codec
from loomlog.sources.table import ChangeLog
from loomlog.streaming import state as streams
from simulator import Store, random_ops

OPS = "seq bigint, op string, key string, value string"


def entries(df):
    return {r["key"]: (r["value"], r["version"], r["tombstone"]) for r in df.collect()}


def expected(ops, shards=8):
    store = Store(shards)
    for op in ops:
        store.apply(*op)
    return {k: (e["value"], e["version"], e["tombstone"]) for k, e in store.entries.items()}


def records():
    return [("PUT", 1, 1, b"k1", b"v1"), ("PUT", 2, 1, b"k2", b""), ("DELETE", 3, 2, b"k1", b"")]


def test_log_cut_at_every_byte():
    data = b"".join(codec.encode_record(*r) for r in records())
    ends, at = [0], 0
    for r in records():
        at += len(codec.encode_record(*r))
        ends.append(at)
    for n in range(len(data) + 1):
        whole = sum(e <= n for e in ends) - 1
        assert codec.scan_segment(data[:n]) == (records()[:whole], ends[whole])


def test_a_flipped_byte_ends_the_scan():
    data = bytearray(b"".join(codec.encode_record(*r) for r in records()))
    data[len(codec.encode_record(*records()[0])) + 10] ^= 1
    assert codec.scan_segment(bytes(data))[0] == records()[:1]


def test_columns_encode_what_the_decoder_reads(spark):
    rows = [(op, w, v, bytearray(k), bytearray(x)) for op, w, v, k, x in records()]
    df = spark.createDataFrame(rows, "op string, write_id bigint, version bigint, key binary, value binary")
    made = df.select(binary.encode_record(*[F.col(c) for c in df.columns]).alias("b"), binary.record_size(F.col("key"), F.col("value")).alias("n")).collect()
    assert [bytes(r["b"]) for r in made] == [codec.encode_record(*r) for r in records()]
    assert all(len(r["b"]) == r["n"] for r in made)


def test_reading_log_files(spark, tmp_path):
    one, two = codec.encode_record(*records()[0]), codec.encode_record(*records()[1])
    for name, data in (("shard_0/0000000001.wal", one), ("shard_0/0000000002.wal", two + one[:5]), ("shard_1/0000000001.wal", two[:-5]), ("shard_1/notes.wal", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = codec.read_wal(spark, str(tmp_path))
    assert sorted((r["write_id"], bytes(r["key"])) for r in got.collect()) == [(1, b"k1"), (2, b"k2")]
    (tmp_path / "shard_0/0000000001.wal").write_bytes(one[:10] + bytes([one[10] ^ 1]) + one[11:])
    with pytest.raises(Exception, match="closed segment is damaged"):
        codec.read_wal(spark, str(tmp_path)).collect()
    good = codec.read_wal(spark, str(tmp_path / "shard_1"))
    assert good.collect() == []


def test_writing_log_files(spark, tmp_path):
    log = oplog.build(spark.createDataFrame(random_ops(21, 200, 9), OPS), 3)
    cut = layout.assign_segments(log, 400)
    files = codec.write_wal(cut, str(tmp_path / "wal")).collect()
    assert sum(r["bytes"] for r in files) == sum(33 + len(r["key"].encode()) + len(r["value"] or "") for r in log.collect())
    back = codec.read_wal(spark, str(tmp_path / "wal")).collect()
    assert sorted((r["op"], r["write_id"], r["version"], bytes(r["key"]).decode()) for r in back) == sorted((r["op"], r["write_id"], r["version"], r["key"]) for r in log.collect())


def test_snapshot_and_manifest_files(spark, tmp_path):
    data = codec.encode_snapshot(3, [(b"a", b"1", 1, 1, False), (b"b", b"", 2, 3, True)])
    assert codec.decode_snapshot(data) == (3, [(b"a", b"1", 1, 1, False), (b"b", b"", 2, 3, True)])
    (tmp_path / "s").write_bytes(data)
    assert {(bytes(r["key"]), r["tombstone"], r["boundary_write_id"]) for r in codec.read_snapshot_files(spark, str(tmp_path / "s")).collect()} == {(b"a", False, 3), (b"b", True, 3)}
    for bad in (b"", b"KVSX" + data[4:], data[:4] + b"\2" + data[5:], data[:-1]):
        if bad != data[:-1] or len(bad):
            with pytest.raises(codec.CorruptLog):
                codec.decode_snapshot(bad)
    assert codec.decode_manifest(codec.encode_manifest(2, 6)) == (2, 6)
    for bad in (b"", codec.encode_manifest(2, 6) + b"x", b"KVSN" + codec.encode_manifest(2, 6)[4:]):
        with pytest.raises(codec.CorruptLog):
            codec.decode_manifest(bad)


def frame(code, request_id, payload):
    return struct.pack(">IBQ", len(payload) + 9, code, request_id) + payload


def test_frames(spark):
    put = frame(1, 7, struct.pack(">I", 1) + b"kv")
    parser = codec.FrameParser()
    got = [f for b in put + frame(2, 8, b"k") for f in parser.feed(bytes([b]))]
    assert [(c, i) for c, i, _ in got] == [(1, 7), (2, 8)]
    assert codec.parse_request(1, got[0][2]) == {"key": b"k", "value": b"v"}
    replicate = struct.pack(">QBQQI", 3, 2, 9, 4, 1) + b"k"
    assert codec.parse_request(4, replicate) == {"term": 3, "op": "DELETE", "write_id": 9, "version": 4, "key": b"k", "value": b""}
    assert codec.parse_request(5, struct.pack(">QQ", 1, 2)) == {"term": 1, "shard": 2}
    assert codec.parse_request(6, struct.pack(">Q", 4)) == {"term": 4} and codec.parse_request(7, b"") == {}
    for code, payload in ((1, struct.pack(">I", 9) + b"k"), (1, b"\0"), (4, replicate[:20]), (5, b"x" * 17), (6, b""), (7, b"x"), (0x7F, b"")):
        assert codec.parse_request(code, payload) is None
    streams_ = spark.createDataFrame([("a", bytearray(put + frame(0x7F, 9, b"") + put)), ("b", bytearray(put + struct.pack(">I", 3) + put)), ("c", bytearray(struct.pack(">I", 0xFFFFFFFF))), ("d", bytearray(put[:-1]))], "connection string, content binary")
    got = sorted((r["connection"], r["position"], r["status"]) for r in codec.decode_frames(streams_).collect())
    assert got == [("a", 0, "OK"), ("a", 1, "BAD_REQUEST"), ("a", 2, "OK"), ("b", 0, "OK"), ("b", 1, "CLOSED"), ("c", 0, "CLOSED")]


def test_table_batches_snapshot_and_reopen(spark, tmp_path):
    root = str(tmp_path / "t")
    table = ChangeLog(spark, root, 4)
    ops = random_ops(11, 300, 10)
    for part in (ops[:100], ops[100:200], ops[200:]):
        table.append(spark.createDataFrame(part, OPS))
    assert entries(table.state()) == expected(ops, 4)
    whole = oplog.build(spark.createDataFrame(ops, OPS), 4)
    assert sorted(tuple(r)[:6] for r in table.log().collect()) == sorted(tuple(r)[:6] for r in whole.collect())
    table.take_snapshot()
    assert table.segments() == [] and table.log().count() == 0
    table.append(spark.createDataFrame([(0, "PUT", "new", "1")], OPS))
    again = ChangeLog(spark, root, 9)
    assert again.shards == 4 and again.get("new") == "1" and again.peek("new")["version"] == 1
    assert entries(again.state()) == expected(ops, 4) | {"new": ("1", 1, False)}
    assert again.size() >= again.live_count()
    again.take_snapshot()
    assert entries(ChangeLog(spark, root).state()) == expected(ops, 4) | {"new": ("1", 1, False)}


def test_a_point_read_opens_one_shard(spark, tmp_path):
    table = ChangeLog(spark, str(tmp_path / "t"), 8)
    table.append(spark.createDataFrame([(i, "PUT", f"k{i}", str(i)) for i in range(50)] + [(99, "DELETE", "k7", None)], OPS))
    assert (table.get("k3"), table.get("k7"), table.get("none")) == ("3", None, None) and table.peek("k7")["tombstone"]
    plan = table.entry("k3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,k3)" in plan


def test_rebalance_twice_and_rollback(spark, tmp_path):
    root = str(tmp_path / "t")
    ops = random_ops(12, 200, 30)
    table = ChangeLog(spark, root, 4)
    table.append(spark.createDataFrame(ops, OPS))
    want = entries(table.state())
    table.stage_rebalance(6)  # broken off before the commit
    table = ChangeLog(spark, root, 4)
    assert (table.generation, table.shards) == (0, 4) and "gen_1" not in table.files.names("")
    assert entries(table.state()) == want
    for n in (6, 3):
        table.rebalance(n)
        assert table.shards == n and entries(table.state()) == want and table.rebalance_state == "done"
    table.append(spark.createDataFrame([(0, "DELETE", "absent", None), (1, "PUT", "z", "")], OPS))
    assert ChangeLog(spark, root, 4).shards == 3 and ChangeLog(spark, root).get("z") == ""
    with pytest.raises(ValueError):
        table.rebalance(0)


@pytest.mark.parametrize("snapshot", [False, True])
def test_what_is_written_between_staging_and_commit_is_kept(spark, tmp_path, snapshot):
    ops = random_ops(16, 400, 25)
    table = ChangeLog(spark, str(tmp_path / "t"), 4)
    table.append(spark.createDataFrame(ops[:150], OPS))
    table.stage_rebalance(6)
    table.append(spark.createDataFrame(ops[150:250], OPS))
    if snapshot:
        table.take_snapshot()  # the log of these writes is gone
    table.append(spark.createDataFrame(ops[250:300] + [(900, "PUT", "only now", "1")], OPS))
    with pytest.raises(ValueError, match="staged"):
        table.commit_rebalance(5)
    table.commit_rebalance(6)
    with pytest.raises(ValueError, match="staged"):
        table.commit_rebalance(6)
    again = ChangeLog(spark, table.files.root)
    late = {"only now": ("1", 1, False)}
    assert again.shards == 6 and entries(again.state()) == expected(ops[:300], 6) | late and again.get("only now") == "1"
    again.append(spark.createDataFrame(ops[300:], OPS))
    assert entries(again.state()) == expected(ops, 6) | late
    ids = [(r["shard"], r["write_id"]) for r in again.log().collect()]
    assert len(set(ids)) == len(ids)


def test_replica_takes_duplicates_and_restarts(spark, tmp_path):
    ops = random_ops(13, 200, 10)
    log = oplog.build(spark.createDataFrame(ops, OPS), 4)
    path, check = str(tmp_path / "records"), str(tmp_path / "check")
    log.withColumn("arrival", F.col("write_id")).select("arrival", "write_id", "version", "op", "key", "value").coalesce(1).write.parquet(path)
    replica = ChangeLog(spark, str(tmp_path / "replica"), 4)
    records_ = spark.readStream.schema("arrival bigint, write_id bigint, version bigint, op string, key string, value string").parquet(path)
    streams.follow(records_, replica, check)
    replica.append_replicated(spark.read.parquet(path))
    assert entries(replica.state()) == entries(state.materialize(log))
    streams.follow(records_, ChangeLog(spark, str(tmp_path / "replica")), check)
    assert replica.log().count() == log.count()


def test_a_replica_tails_what_comes(spark, tmp_path):
    log = oplog.build(spark.createDataFrame(random_ops(15, 200, 10), OPS), 4)
    records_ = log.withColumn("arrival", F.col("write_id")).select("arrival", "write_id", "version", "op", "key", "value")
    path, replica = str(tmp_path / "records"), ChangeLog(spark, str(tmp_path / "replica"), 4)
    records_.where("write_id <= 10").coalesce(1).write.parquet(path)
    query = streams.tail(spark.readStream.schema(records_.schema).parquet(path), replica, str(tmp_path / "check"))
    try:
        query.processAllAvailable()
        assert replica.log().count() == log.where("write_id <= 10").count()
        records_.coalesce(1).write.mode("append").parquet(path)
        query.processAllAvailable()
    finally:
        query.stop()
    assert entries(replica.state()) == entries(state.materialize(log))


def test_entry_stream_goes_on_after_a_restart(spark, tmp_path):
    ops = random_ops(14, 120, 6)
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = [(s, s, o, k, v) for s, o, k, v in ops]
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, schemas.OPS).coalesce(1).write.mode("append").parquet(path)
        streams.write_entries(streams.ops_stream(spark, path), out, check)
    assert entries(streams.latest(spark.read.parquet(out))) == expected(ops)


def test_a_replica_catches_up_from_a_snapshot_and_from_the_log(spark, tmp_path):
    ops = random_ops(31, 400, 12)
    frame = lambda rows: spark.createDataFrame([(q, o, k, v) for q, o, k, v in rows], OPS)
    leader, replica = ChangeLog(spark, str(tmp_path / "leader"), 4), ChangeLog(spark, str(tmp_path / "replica"), 4)
    leader.append(frame(ops[:100]))
    replica.catch_up(leader)  # from the log alone: there is no snapshot
    assert entries(replica.state()) == entries(leader.state()) == expected(ops[:100], 4)
    leader.append(frame(ops[100:250]))
    leader.take_snapshot()
    leader.append(frame(ops[250:]))
    replica.catch_up(leader)  # the log that it needs is gone: entries first
    assert entries(replica.state()) == entries(leader.state()) == expected(ops, 4)
    replica.catch_up(leader)  # nothing new
    assert entries(replica.state()) == expected(ops, 4)
    assert leader.entries_loaded() == len(expected(ops[:250], 4))
    with pytest.raises(ValueError, match="layouts"):
        ChangeLog(spark, str(tmp_path / "other"), 3).catch_up(leader)


def test_responses_as_bytes_and_as_columns(spark):
    rows = [("OK", 7, bytearray(b"value")), ("NOT_FOUND", 8, None), ("STALE_TERM", 2**40, bytearray(b"\0" * 8))]
    got = spark.createDataFrame(rows, "s string, id bigint, p binary").select(binary.encode_response(F.col("s"), F.col("id"), F.col("p")).alias("b")).collect()
    assert [bytes(r["b"]) for r in got] == [codec.encode_response(s, i, bytes(p or b"")) for s, i, p in rows]
    assert bytes(got[0]["b"]) == b"\0\0\0\x0e\0" + (7).to_bytes(8, "big") + b"value"
