"""Cluster analytics: dispatch by role, epoch fencing, elections, heartbeats, catch-up, replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators import blocked, merge


def dispatch(role: Column, opcode: Column, outcome: Column, *, term: Column, epoch: Column, shard: Column, shards: int) -> Column:
    """Status of a request. ``outcome`` is what the store says to a PUT, GET or DELETE (OK, NOT_FOUND or a failed check)."""
    leader = role == "leader"
    client = opcode.isin("PUT", "GET", "DELETE")
    stale = term < epoch
    checked = F.when(outcome.isin("OK", "NOT_FOUND"), outcome).otherwise("BAD_REQUEST")
    return (
        F.when(client & leader, checked)
        .when(client, "NOT_LEADER")
        .when((opcode == "REPLICATE") & leader, "BAD_REQUEST")
        .when(opcode == "REPLICATE", F.when(stale, "STALE_TERM").otherwise("OK"))
        .when((opcode == "CATCHUP_QUERY") & (leader | (shard >= shards)), "BAD_REQUEST")
        .when(opcode == "CATCHUP_QUERY", F.when(stale, "STALE_TERM").otherwise("OK"))
        .when(opcode == "HEARTBEAT", F.when(stale, "STALE_TERM").otherwise("OK"))
        .when(opcode == "ELECTION_QUERY", "OK")
        .otherwise("BAD_REQUEST")
    )


def fence(events: DataFrame, initial: int = 1) -> DataFrame:
    """(node, arrival, term, ...) with ``epoch`` before each event and ``verdict``: REJECT below it, ACCEPT at it, ADOPT above it."""
    found = blocked.prior_max(events, ["node"], "arrival", F.col("term"), "_seen")
    found = found.withColumn("epoch", F.greatest(F.coalesce("_seen", F.lit(initial)), F.lit(initial)).cast("long")).drop("_seen")
    return found.withColumn("verdict", F.when(F.col("term") < F.col("epoch"), "REJECT").when(F.col("term") == F.col("epoch"), "ACCEPT").otherwise("ADOPT"))


def election(peers: DataFrame, own_port: int, own_total: int, own_epoch: int) -> DataFrame:
    """One row: what a candidate does after asking its peers (port, epoch, total, reachable).

    With a respondent at the proposed epoch or above it adopts that epoch. Otherwise the most committed node wins,
    ties going to the lowest port: PROMOTE if that is the candidate, else STAND_BACK for the winner.
    """
    asked = peers.where(F.col("reachable"))
    proposed = own_epoch + 1
    most = asked.agg(
        F.max("epoch").alias("highest"),
        F.max(F.when(F.col("epoch") < proposed, F.struct(F.col("total").cast("long").alias("total"), (-F.col("port")).cast("long").alias("by_port")))).alias("best"),
        F.count("*").alias("respondents"),
    )
    best = F.greatest(F.coalesce("best", F.struct(F.lit(own_total).cast("long").alias("total"), F.lit(-own_port).cast("long").alias("by_port"))), F.struct(F.lit(own_total).cast("long").alias("total"), F.lit(-own_port).cast("long").alias("by_port")))
    ahead = F.coalesce(F.col("highest") >= proposed, F.lit(False))
    decision = F.when(ahead, "ADOPT").when(best["by_port"] == -own_port, "PROMOTE").otherwise("STAND_BACK")
    return most.select(
        decision.alias("decision"),
        F.when(ahead, F.col("highest")).otherwise(F.lit(proposed)).cast("long").alias("epoch"),
        F.when(~ahead, -best["by_port"]).cast("long").alias("winner_port"),
        F.when(~ahead, best["total"]).cast("long").alias("winner_total"),
        F.col("respondents").cast("long").alias("respondents"),
    )


def links_after_promotion(decision: DataFrame, peers: DataFrame) -> DataFrame:
    """A new leader opens a link to every peer; no promotion, no links."""
    won = decision.where(F.col("decision") == "PROMOTE").select("epoch")
    return peers.select("port").join(F.broadcast(won.limit(1)))


def total_committed(log: DataFrame) -> DataFrame:
    """One row: sum over shards of the highest write_id."""
    last = log.groupBy("shard").agg(F.max("write_id").alias("last"))
    return last.agg(F.coalesce(F.sum("last"), F.lit(0)).cast("long").alias("total"))


def heartbeat_gaps(events: DataFrame, timeout_ms: int = 150) -> DataFrame:
    """(node, arrival, at_ms): milliseconds since the node's event before, and whether a follower would have stood for election."""
    found = blocked.lag(events, ["node"], "arrival", F.col("at_ms"), "_before")
    return found.withColumn("gap_ms", F.col("at_ms") - F.col("_before")).withColumn("timed_out", F.coalesce(F.col("gap_ms") >= timeout_ms, F.lit(False))).drop("_before")


def catchup_mode(positions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """For each shard: SNAPSHOT where the follower is behind the leader's snapshot, else TAIL."""
    found = boundaries.join(positions, "shard", "left").withColumn("last_applied", F.coalesce("last_applied", F.lit(0)))
    return found.select("shard", "last_applied", "boundary_write_id", F.when(F.col("last_applied") < F.col("boundary_write_id"), "SNAPSHOT").otherwise("TAIL").alias("mode"))


def shipped(snapshot: DataFrame, boundaries: DataFrame, log: DataFrame, positions: DataFrame) -> DataFrame:
    """What a leader sends to a follower at ``positions`` (shard, last_applied): records (shard, arrival, write_id, version, op, key, value, mode).

    A follower behind the leader's snapshot gets the shard's entries as records, then the log after the boundary;
    others get the log after their position. Entries must arrive by write_id, or the rule of replication would drop
    the lower ones: arrival is the write_id, which the tail continues.
    """
    modes = boundaries.select("shard", "boundary_write_id").join(positions.select("shard", "last_applied"), "shard", "full_outer")
    modes = modes.select("shard", F.coalesce("boundary_write_id", F.lit(0)).alias("_from"), F.coalesce("last_applied", F.lit(0)).alias("_at"))
    behind = F.col("_at") < F.col("_from")
    entries = merge.entries_to_records(snapshot.join(modes.where(behind).select("shard"), "shard", "left_semi")).withColumn("mode", F.lit("SNAPSHOT"))
    tail = log.join(modes, "shard", "left").where(F.col("write_id") > F.coalesce(F.when(behind, F.col("_from")).otherwise(F.col("_at")), F.lit(0)))
    sent = entries.unionByName(tail.select("shard", "write_id", "version", "op", "key", "value", F.lit("TAIL").alias("mode")))
    return sent.withColumn("arrival", F.col("write_id"))


def lag(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Records of each shard that the follower has not acknowledged."""
    l = leader.groupBy("shard").agg(F.max("write_id").alias("leader_id"))  # noqa: E741
    f = follower.groupBy("shard").agg(F.max("write_id").alias("ack_index"))
    return l.join(f, "shard", "left").select("shard", "leader_id", F.coalesce("ack_index", F.lit(0)).alias("ack_index"), (F.col("leader_id") - F.coalesce("ack_index", F.lit(0))).alias("lag"))


def replica_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of two states that differ: MISSING on the right, EXTRA on the right, or CHANGED."""
    left = a.select("shard", "key", F.struct("value", "version", "write_id", "tombstone").alias("l"))
    right = b.select("shard", "key", F.struct("value", "version", "write_id", "tombstone").alias("r"))
    both = left.join(right, ["shard", "key"], "full_outer")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("shard", "key", F.when(F.col("r").isNull(), "MISSING").when(F.col("l").isNull(), "EXTRA").otherwise("CHANGED").alias("difference"), F.col("l.version").alias("left_version"), F.col("r.version").alias("right_version"))


def missing_keys(acknowledged: DataFrame, survivor: DataFrame) -> DataFrame:
    return acknowledged.select("key").distinct().join(survivor.select("key"), "key", "left_anti")


def match_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """One row: requests, responses, and how many of either have no partner by request_id."""
    both = requests.select("request_id", F.lit(1).alias("q")).join(responses.select("request_id", F.lit(1).alias("r")), "request_id", "full_outer")
    return both.agg(F.count("q").alias("requests"), F.count("r").alias("responses"), F.count_if(F.col("r").isNull()).alias("unanswered"), F.count_if(F.col("q").isNull()).alias("unasked"))


def epoch_at_end(events: DataFrame) -> DataFrame:
    """Highest epoch and last verdict of each node, from fenced events."""
    return events.groupBy("node").agg(F.max(F.greatest("epoch", "term")).alias("epoch"), F.max_by("verdict", "arrival").alias("last_verdict"))


def parse_peers(text: DataFrame, column: str = "peers") -> DataFrame:
    """(host, port) of lists ``host:port,host:port``; empty parts are skipped, one without a colon or a port is an error."""
    part = text.select(F.explode(F.split(column, ",")).alias("part")).where(F.col("part") != "")
    host, port = F.substring_index("part", ":", 1), F.substring_index("part", ":", -1)
    good = F.contains(F.col("part"), F.lit(":")) & port.rlike(r"^[0-9]{1,5}$")
    checked = F.when(good, port).otherwise(F.raise_error(F.concat(F.lit("not host:port: "), F.col("part"))))
    return part.select(host.alias("host"), checked.cast("int").alias("port"))


def checked_role(role: Column) -> Column:
    """leader or follower; anything else is an error."""
    return F.when(role.isin("leader", "follower"), role).otherwise(F.raise_error(F.concat(F.lit("not a role: "), role)))


def shards_with_data(state: DataFrame) -> DataFrame:
    return state.agg(F.count_distinct("shard").alias("shards"))
