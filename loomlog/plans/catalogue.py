"""The catalogue of registered change-log queries. Their SQL twins are in sql.py."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog import schemas, scratch
from loomlog.functions import binary, hashing
from loomlog.operators import cluster, layout, merge, metrics, oplog, state
from loomlog.plans import bridge, sql
from loomlog.sources import codec
from loomlog.sources.table import ChangeLog
from loomlog.streaming import state as streams

SEGMENT_BYTES = 4096
RATE = 50_000


def q01_put_validation(spark: SparkSession, d: str) -> DataFrame:
    ops = bridge.ops_validate(spark, d)
    return ops.select("seq", oplog.put_status(F.col("key"), F.col("value")).alias("status"))


def q02_effective_log(spark: SparkSession, d: str) -> DataFrame:
    return oplog.effective(bridge.ops(spark, d)).select("seq", "op", "key", "value")


def q03_key_versions(spark: SparkSession, d: str) -> DataFrame:
    return oplog.effective(bridge.ops(spark, d)).select("seq", "key", "version")


def q04_shard_write_ids(spark: SparkSession, d: str) -> DataFrame:
    return bridge.log(spark, d).select("seq", "key", "shard", "write_id", "version")


def q05_delete_status(spark: SparkSession, d: str) -> DataFrame:
    return oplog.statuses(bridge.ops(spark, d)).where(F.col("op") == "DELETE").select("seq", "status")


def q06_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return state.materialize(bridge.log(spark, d)).select("shard", "key", "value", "version", "write_id", "tombstone")


def q07_live_kv(spark: SparkSession, d: str) -> DataFrame:
    return state.live(state.materialize(bridge.log(spark, d)))


def q08_get_asof(spark: SparkSession, d: str) -> DataFrame:
    return state.reads_as_of(bridge.ops(spark, d))


def q09_size_vs_live(spark: SparkSession, d: str) -> DataFrame:
    return state.sizes(state.materialize(bridge.log(spark, d)))


def q10_resurrected_keys(spark: SparkSession, d: str) -> DataFrame:
    found = oplog.mutations_with_previous(bridge.ops(spark, d)).where((F.col("op") == "PUT") & (F.col("previous") == "DELETE"))
    return found.groupBy("key").agg(F.count("*").alias("resurrections"), F.min("seq").alias("first_seq"))


def q11_recover_snapshot_tail(spark: SparkSession, d: str) -> DataFrame:
    log = bridge.stored_log(spark, d)
    bounds = bridge.half_boundaries(log)
    return state.recover(bridge.snapshot_at(log, bounds), bounds, log).select("shard", "key", "value", "version", "write_id", "tombstone")


def q12_scanned_vs_applied(spark: SparkSession, d: str) -> DataFrame:
    log = bridge.stored_log(spark, d)
    return state.replay_counts(bridge.half_boundaries(log), log)


def q13_segment_assignment(spark: SparkSession, d: str) -> DataFrame:
    return layout.assign_segments(bridge.stored_log(spark, d), SEGMENT_BYTES).select("shard", "write_id", "segment")


def q14_replicate_dedup(spark: SparkSession, d: str) -> DataFrame:
    return merge.accept_replicated(bridge.arrivals(bridge.stored_log(spark, d))).select("shard", "arrival", "write_id", "key", "op")


def q15_migrate_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    return merge.newest_wins(bridge.arrivals(bridge.log(spark, d))).select("key", "shard", "write_id", "version", "op")


def q16_merge_rules_diff(spark: SparkSession, d: str) -> DataFrame:
    came = bridge.arrivals(bridge.stored_log(spark, d))
    high = merge.newest_wins(merge.accept_replicated(came)).select("key", F.col("write_id").alias("replicated_id"))
    newest = merge.newest_wins(came).select("key", F.col("write_id").alias("migrated_id"))
    return newest.join(high, "key", "left").select("key", "migrated_id", "replicated_id", (F.col("replicated_id").eqNullSafe(F.col("migrated_id"))).alias("same"))


def q17_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    h = hashing.fnv1a(F.col("key"))
    return bridge.keys_wide(spark, d).withColumn("h", h).select("key", F.col("h.hi").alias("hi"), F.col("h.lo").alias("lo"))


def q18_shard_distribution(spark: SparkSession, d: str) -> DataFrame:
    return layout.distribution(bridge.keys_wide(spark, d), 8)


def q19_reshard_placement(spark: SparkSession, d: str) -> DataFrame:
    return layout.placement(bridge.keys_wide(spark, d), 8, 6)


def q20_reshard_moved_keys(spark: SparkSession, d: str) -> DataFrame:
    return layout.moved_matrix(layout.placement(bridge.keys_wide(spark, d), 8, 6))


def q21_reshard_no_loss(spark: SparkSession, d: str) -> DataFrame:
    before = state.materialize(bridge.stored_log(spark, d, 8))
    return layout.lost_and_added(before, layout.reshard(before, 6))


def q22_dispatch_status(spark: SparkSession, d: str) -> DataFrame:
    """Every client operation as it fares on a leader and on a follower."""
    ops = bridge.ops(spark, d)
    writes = oplog.statuses(ops).select("seq", "op", "status")
    reads = state.reads_as_of(ops).select("seq", F.lit("GET").alias("op"), "status")
    asked = writes.unionByName(reads).crossJoin(F.broadcast(spark.createDataFrame([("leader",), ("follower",)], "role string")))
    none = F.lit(0)
    status = cluster.dispatch(F.col("role"), F.col("op"), F.col("status"), term=none, epoch=none, shard=none, shards=8)
    return asked.groupBy("role", "op", status.alias("status")).agg(F.count("*").alias("n"))


def q23_epoch_fencing(spark: SparkSession, d: str) -> DataFrame:
    return cluster.fence(bridge.cluster_events(spark, d)).select("arrival", "node", "term", "epoch", "verdict")


def q24_election_winner(spark: SparkSession, d: str) -> DataFrame:
    return cluster.election(bridge.peers(spark, d), own_port=6380, own_total=5000, own_epoch=1)


def q25_total_committed(spark: SparkSession, d: str) -> DataFrame:
    return cluster.total_committed(bridge.log(spark, d))


def q26_heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    return cluster.heartbeat_gaps(bridge.cluster_events(spark, d)).select("node", "arrival", "gap_ms", "timed_out")


def q27_catchup_mode(spark: SparkSession, d: str) -> DataFrame:
    log = bridge.stored_log(spark, d)
    return cluster.catchup_mode(bridge.positions(log), bridge.half_boundaries(log))


def q28_replication_lag(spark: SparkSession, d: str) -> DataFrame:
    log = bridge.stored_log(spark, d)
    return cluster.lag(log, bridge.replica(log))


def q29_replica_diff(spark: SparkSession, d: str) -> DataFrame:
    log = bridge.stored_log(spark, d)
    return cluster.replica_diff(state.materialize(log), state.materialize(bridge.replica(log)))


def q30_latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.floor_percentiles(bridge.table(spark, d, "events"), "event_type", "value")


def q31_workload_mix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mix_counts(metrics.workload_mix(bridge.ops(spark, d), 90, 10))


def q32_copied_bytes(spark: SparkSession, d: str) -> DataFrame:
    return layout.copied_bytes(state.materialize(bridge.log(spark, d)), RATE)


def q33_truncatable_segments(spark: SparkSession, d: str) -> DataFrame:
    log = bridge.stored_log(spark, d)
    return layout.truncatable(layout.assign_segments(log, SEGMENT_BYTES), bridge.half_boundaries(log))


def q34_wal_record_bytes(spark: SparkSession, d: str) -> DataFrame:
    return bridge.log(spark, d).select("shard", "write_id", binary.record_size(F.col("key"), F.col("value")).alias("bytes"))


def q35_wal_crc(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col(c) for c in ("op", "write_id", "version", "key", "value")]
    return bridge.log(spark, d).select("shard", "write_id", binary.record_crc(*parts).alias("crc32"), F.lower(F.hex(binary.encode_record(*parts))).alias("record"))


def _segments_of(log: DataFrame, cut: int) -> DataFrame:
    """Log files of about SEGMENT_BYTES as they would lie on disk; ``cut`` bytes are torn off the active one of each shard."""
    whole = codec.pack_segments(layout.assign_segments(log, SEGMENT_BYTES))
    kept = F.when(F.col("active"), F.substring("content", F.lit(1), F.octet_length("content") - cut)).otherwise(F.col("content"))
    name = F.concat(binary.shard_dir(F.lit(0), F.col("shard")), F.lit("/"), binary.segment_name(F.col("segment")))
    return whole.select(name.alias("segment"), kept.alias("content"), "active")


def q36_wal_decode(spark: SparkSession, d: str) -> DataFrame:
    """The log written as segments, torn by five bytes at each shard's end, and read again."""
    found = codec.decode_wal(_segments_of(bridge.stored_log(spark, d), 5))
    shard = F.regexp_extract("segment", r"shard_(\d+)/", 1).cast("int")
    return found.select(shard.alias("shard"), "write_id", "version", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def q37_frame_decode(spark: SparkSession, d: str) -> DataFrame:
    """Client operations as the bytes of one connection for each key and thousand requests, parsed again."""
    ops = bridge.ops(spark, d)
    code = F.when(F.col("op") == "PUT", binary.OPCODES["PUT"]).when(F.col("op") == "GET", binary.OPCODES["GET"]).otherwise(binary.OPCODES["DELETE"])
    frame = binary.encode_frame(code, F.col("request_id"), binary.request_payload(F.col("op"), F.col("key"), F.col("value")))
    name = F.concat_ws("/", "key", F.floor(F.col("seq") / 1000).cast("string"))
    streams_ = ops.select(name.alias("connection"), "seq", frame.alias("frame")).groupBy("connection").agg(codec.joined("frame", "seq").alias("content"))
    found = codec.decode_frames(streams_)
    return found.select("connection", "position", "status", "opcode", "request_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def q38_stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Entries kept up by a stateful stream over the events."""
    base = scratch.folder(spark)
    events = spark.readStream.schema(bridge.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    streams.write_entries(bridge.from_events(events), f"{base}/entries", f"{base}/checkpoint")
    return streams.latest(spark.read.parquet(f"{base}/entries")).select("key", "value", "version", "tombstone")


def q39_stream_replica(spark: SparkSession, d: str) -> DataFrame:
    """A replica fed by a stream of duplicated and late records, in two runs; then its state."""
    base = scratch.folder(spark)
    bridge.arrivals(bridge.stored_log(spark, d)).select("arrival", "write_id", "version", "op", "key", "value").write.parquet(f"{base}/records")
    replica = ChangeLog(spark, f"{base}/replica", 8)
    records = spark.readStream.schema("arrival bigint, write_id bigint, version bigint, op string, key string, value string").parquet(f"{base}/records")
    streams.follow(records, replica, f"{base}/checkpoint")
    return replica.state().select("shard", "key", "value", "version", "write_id", "tombstone")


def q40_manifest_rollback(spark: SparkSession, d: str) -> DataFrame:
    """A table whose resharding is broken off before its commit, opened again: the old layout, with everything in it."""
    root = f"{scratch.folder(spark)}/table"
    table = ChangeLog(spark, root, 8)
    table.append(bridge.ops(spark, d))
    table.take_snapshot()
    table.stage_rebalance(6)
    again = ChangeLog(spark, root, 4)
    return again.state().select("shard", "key", "version", "tombstone")


def _catching_up(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, positions, shipped): a leader with a snapshot at half of each shard, its log cut off there, and followers."""
    log = bridge.stored_log(spark, d)
    bounds, at = bridge.half_boundaries(log), bridge.positions(log)
    tail = log.join(bounds, "shard").where(F.col("write_id") > F.col("boundary_write_id")).drop("boundary_write_id")
    return log, at, cluster.shipped(bridge.snapshot_at(log, bounds), bounds, tail, at)


def q41_catch_up_state(spark: SparkSession, d: str) -> DataFrame:
    """Followers' state after they caught up: from the snapshot where they were behind it, else from the log alone."""
    log, at, sent = _catching_up(spark, d)
    there = log.join(at, "shard").where(F.col("write_id") <= F.col("last_applied")).drop("last_applied")
    fresh = sent.join(at, "shard").where(F.col("write_id") > F.col("last_applied")).drop("last_applied")
    came = merge.accept_replicated(scratch.written(fresh))
    names = ["shard", "write_id", "version", "op", "key", "value"]
    return state.materialize(there.select(names).unionByName(came.select(names))).select("shard", "key", "value", "version", "write_id", "tombstone")


def q42_catch_up_shipped(spark: SparkSession, d: str) -> DataFrame:
    log, at, sent = _catching_up(spark, d)
    fresh = F.count_if(F.col("write_id") > F.col("last_applied"))
    return sent.join(at, "shard").groupBy("shard", "mode").agg(F.count("*").alias("shipped"), fresh.alias("fresh"), F.max("write_id").alias("upto"))


def q43_replay_after(spark: SparkSession, d: str) -> DataFrame:
    """Log files read again after a boundary, the active ones torn."""
    log = bridge.stored_log(spark, d)
    after = bridge.half_boundaries(log).select(F.col("shard").alias("_s"), F.col("boundary_write_id").alias("after"))
    files = _segments_of(log, 5).withColumn("_shard", F.regexp_extract("segment", r"shard_(\d+)/", 1).cast("int"))
    found = codec.decode_wal(files.join(after, F.col("_shard") == F.col("_s")))
    return found.select(F.regexp_extract("segment", r"shard_(\d+)/", 1).cast("int").alias("shard"), "write_id", "op", F.col("key").cast("string").alias("key"))


def q44_node_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Every request between nodes with its status and the bytes of the response; node 0 leads, the others follow."""
    found = cluster.fence(bridge.node_requests(spark, d))
    role = cluster.checked_role(F.when(F.col("node") == 0, "leader").otherwise("follower"))
    status = cluster.dispatch(role, F.col("opcode"), F.lit(None).cast("string"), term=F.col("term"), epoch=F.col("epoch"), shard=F.col("shard"), shards=8)
    found = found.select("arrival", "node", "opcode", "epoch", "shard", status.alias("status"))
    reply = F.when(F.col("opcode") == "CATCHUP_QUERY", binary.encode_last_applied(F.col("arrival") * 3)).when(F.col("opcode") == "ELECTION_QUERY", binary.encode_election_reply(F.col("epoch"), F.col("arrival") * 5))
    response = binary.encode_response(F.col("status"), F.col("arrival"), binary.status_payload(F.col("status"), reply, F.col("epoch")))
    return found.select("arrival", "node", "opcode", "status", F.lower(F.hex(response)).alias("response"))


def q45_node_frames(spark: SparkSession, d: str) -> DataFrame:
    """Requests between nodes as bytes, a connection for each node and thousand requests, parsed again."""
    found = bridge.node_requests(spark, d)
    opcode, value = F.col("opcode"), F.when(F.col("op") == "PUT", F.lit("v"))
    payload = (
        F.when(opcode == "REPLICATE", binary.replicate_payload(F.col("term"), F.col("op"), F.col("arrival") + 1, F.col("shard") + 1, F.col("key"), value))
        .when(opcode == "CATCHUP_QUERY", binary.catchup_payload(F.col("term"), F.col("shard")))
        .when(opcode == "HEARTBEAT", binary.unsigned(F.col("term"), 8))
        .otherwise(F.lit(b""))
    )
    payload = F.when(F.col("cut"), F.substring(payload, F.lit(1), F.lit(7))).otherwise(payload)
    code = F.lit(0)
    for name, number in binary.OPCODES.items():
        code = F.when(opcode == name, number).otherwise(code)
    name = F.concat_ws("/", F.col("node").cast("string"), F.floor(F.col("arrival") / 1000).cast("string"))
    blobs = found.select(name.alias("connection"), "arrival", binary.encode_frame(code, F.col("arrival"), payload).alias("frame")).groupBy("connection").agg(codec.joined("frame", "arrival").alias("content"))
    text = lambda c: F.col(c).cast("string").alias(c)
    return codec.decode_frames(blobs).select("connection", "position", "status", "opcode", "request_id", "term", "shard", "op", "write_id", "version", text("key"), text("value"))


def q46_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads between nodes as columns, and what short replies decode to."""
    log = bridge.log(spark, d)
    term, hexed = binary.current_term(F.lit(None)), lambda c, name: F.lower(F.hex(c)).alias(name)
    reply = binary.decode_election_reply(binary.encode_election_reply(F.col("version"), F.col("write_id")))
    return log.select(
        "shard", "write_id", binary.owning_node().alias("owner"),
        hexed(binary.replicate_payload(term, F.col("op"), F.col("write_id"), F.col("version"), F.col("key"), F.col("value")), "replicate"),
        hexed(binary.catchup_payload(term, F.col("shard")), "catchup"),
        binary.decode_last_applied(binary.encode_last_applied(F.col("write_id"))).alias("last_applied"),
        binary.decode_last_applied(binary.unsigned(F.col("write_id"), 7)).alias("too_short"),
        reply["epoch"].alias("reply_epoch"), reply["total"].alias("reply_total"),
    )


def q47_keys_lost_with_the_leader(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledged keys that a survivor with a fortieth of the log does not have."""
    log = bridge.stored_log(spark, d)
    upto = log.groupBy("shard").agg(F.floor(F.max("write_id") / 40).alias("upto"))
    return cluster.missing_keys(log, state.materialize(log.join(upto, "shard").where(F.col("write_id") <= F.col("upto")).drop("upto")))


def q48_responses_matched(spark: SparkSession, d: str) -> DataFrame:
    """Requests and responses by request_id, where every 97th is not answered and every 89th is answered once more, unasked."""
    asked = bridge.ops(spark, d).select("request_id")
    answers = asked.where(F.col("request_id") % 97 != 0).unionByName(asked.where((F.col("request_id") > 0) & (F.col("request_id") % 89 == 0)).select((-F.col("request_id")).alias("request_id")))
    return cluster.match_responses(asked, answers)


def q49_table_accounts(spark: SparkSession, d: str) -> DataFrame:
    """A table of two batches with a snapshot between them: what opening it loads and replays."""
    ops = bridge.ops(spark, d)
    half = ops.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    table = ChangeLog(spark, f"{scratch.folder(spark)}/table", 8)
    table.append(ops.where(F.col("seq") < half))
    table.take_snapshot()
    table.append(ops.where(F.col("seq") >= half))
    counts = table.log().agg(F.count("*").alias("replayed"))
    return cluster.shards_with_data(table.state()).join(counts).select("shards", F.lit(table.entries_loaded()).cast("long").alias("entries_loaded"), "replayed", F.lit(len(table.segments())).cast("long").alias("segments"))


def q50_highest_epoch(spark: SparkSession, d: str) -> DataFrame:
    return cluster.epoch_at_end(cluster.fence(bridge.cluster_events(spark, d)))


def q51_links_after_promotion(spark: SparkSession, d: str) -> DataFrame:
    peers = bridge.peers(spark, d)
    return cluster.links_after_promotion(cluster.election(peers, own_port=6380, own_total=20_000, own_epoch=1), peers)


def q52_entries_as_records(spark: SparkSession, d: str) -> DataFrame:
    return merge.entries_to_records(state.materialize(bridge.log(spark, d)))


def q53_parse_peers(spark: SparkSession, d: str) -> DataFrame:
    s = bridge.table(spark, d, "supplier")
    port = lambda n: (F.col("s_suppkey") + n).cast("string")
    text = F.concat(F.lit("host-"), F.col("s_suppkey").cast("string"), F.lit(":"), port(6380), F.lit(",,other:"), port(1), F.lit(","))
    return cluster.parse_peers(s.select(text.alias("peers")))


def q54_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Rates by type of event, against that of views."""
    e = bridge.table(spark, d, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"))
    found = metrics.throughput(e, "event_type", "at_ms")
    view = F.max(F.when(F.col("event_type") == "view", F.col("per_second"))).over(Window.partitionBy(F.lit(0)))
    found = found.withColumn("_view", view)
    return found.select("event_type", "n", "millis", "per_second", metrics.speed_up(F.col("_view"), F.col("per_second")).alias("speed_up"), metrics.dip_percent(F.col("_view"), F.col("per_second")).alias("dip_percent"))


def q55_segment_names(spark: SparkSession, d: str) -> DataFrame:
    """The files of each shard's log: how many, the first and the active one."""
    cut = layout.assign_segments(bridge.stored_log(spark, d), SEGMENT_BYTES)
    name = lambda n: F.concat(binary.shard_dir(F.lit(0), F.col("shard")), F.lit("/"), binary.segment_name(n))
    found = cut.groupBy("shard").agg(F.count_distinct("segment").alias("segments"), F.min("segment").alias("_low"), F.max("segment").alias("_high"))
    return found.select("shard", "segments", name(F.col("_low")).alias("lowest"), name(F.col("_high")).alias("active"))


def q56_throttled_copy(spark: SparkSession, d: str) -> DataFrame:
    return layout.throttled(bridge.stored_log(spark, d), RATE).select("shard", "write_id", "done_ms")


def q57_workload_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of each kind of workload: for two workers where the form names one."""
    ops = bridge.ops(spark, d).select("seq")
    forms = [metrics.workload_keys(ops, form, 2).withColumn("form", F.lit(form)) for form in metrics.KEY_FORMS]
    return functools.reduce(DataFrame.unionByName, forms)


def q58_table_rebalanced(spark: SparkSession, d: str) -> DataFrame:
    """A stored table moved from 8 to 3 shards and opened again: what it holds against what was applied."""
    ops = bridge.ops(spark, d)
    table = ChangeLog(spark, f"{scratch.folder(spark)}/table", 8)
    table.append(ops)
    table.rebalance(3)
    again = ChangeLog(spark, table.files.root)
    return layout.lost_and_added(state.materialize(bridge.log(spark, d)), again.state()).withColumns({"shards": F.lit(again.shards), "status": F.lit(table.rebalance_state)})


def q59_rebalanced_while_written(spark: SparkSession, d: str) -> DataFrame:
    """A stored table whose new layout is staged halfway through its operations, committed at the end and opened again."""
    ops = bridge.ops(spark, d)
    half = ops.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    table = ChangeLog(spark, f"{scratch.folder(spark)}/table", 8)
    table.append(ops.where(F.col("seq") < half))
    table.stage_rebalance(6)
    table.append(ops.where(F.col("seq") >= half))
    table.commit_rebalance(6)
    return ChangeLog(spark, table.files.root).state().select("key", "value", "version", "tombstone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return sql.twins()
