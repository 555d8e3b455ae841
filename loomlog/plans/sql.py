"""DuckDB twins of the registered change-log queries."""

from __future__ import annotations

from loomlog import schemas

_OPS = """ops AS (
  SELECT event_id AS seq, 'user-' || user_id AS key,
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS op, props AS value
  FROM events)"""

_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT,
    list_transform(range(0, octet_length(encode({key}))), lambda i: ('0x' || substr(hex(encode({key})), 2 * i + 1, 2))::HUGEINT)),
    lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616)"""


def _status(key: str, value: str) -> str:
    return f"""CASE WHEN strlen(coalesce({key}, '')) = 0 THEN 'EMPTY_KEY' WHEN strlen({key}) > {schemas.MAX_KEY_BYTES} THEN 'KEY_TOO_LARGE'
    WHEN strlen(coalesce({value}, '')) > {schemas.MAX_VALUE_BYTES} THEN 'VALUE_TOO_LARGE' ELSE 'OK' END"""


_MUT = f"""valid AS (SELECT * FROM ops WHERE op <> 'PUT' OR ({_status("key", "value")}) = 'OK'),
mut AS (SELECT seq, key, op, value, lag(op) OVER (PARTITION BY key ORDER BY seq) AS p FROM valid WHERE op <> 'GET')"""

_EFF = """eff AS (
  SELECT seq, key, op, CASE WHEN op = 'PUT' THEN coalesce(value, '') END AS value,
    row_number() OVER (PARTITION BY key ORDER BY seq) AS version
  FROM mut WHERE op = 'PUT' OR p = 'PUT')"""

_LOG = f"""shards AS (SELECT key, CAST({_FNV.format(key="key")} % 8 AS INTEGER) AS shard FROM (SELECT DISTINCT key FROM eff)),
log AS (
  SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY seq) AS write_id, version, op, eff.key AS key, value, seq
  FROM eff JOIN shards ON eff.key = shards.key)"""

_STATE = """state AS (
  SELECT shard, key, CASE WHEN op = 'PUT' THEN value END AS value, version, write_id, op = 'DELETE' AS tombstone
  FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY write_id DESC) = 1)"""

_HALF = "bounds AS (SELECT shard, max(write_id) // 2 AS boundary_write_id FROM log GROUP BY shard)"

_ARRIVALS = """late AS (SELECT *, CASE WHEN write_id % 11 = 0 THEN 21 ELSE 0 END AS d FROM log),
arrivals AS (SELECT *, write_id * 4 + d AS arrival FROM late UNION ALL SELECT *, write_id * 4 + 14 + d FROM late WHERE write_id % 7 = 0)"""

_ACCEPTED = """accepted AS (
  SELECT * FROM (SELECT *, max(write_id) OVER (PARTITION BY shard ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM arrivals)
  WHERE write_id > coalesce(high, 0))"""

_REPLICA = """upto AS (SELECT shard, max(write_id) * 9 // 10 AS upto FROM log GROUP BY shard),
replica AS (SELECT log.* FROM log JOIN upto ON log.shard = upto.shard WHERE write_id <= upto)"""

_SEGMENTS = """sized AS (SELECT shard, write_id, 33 + strlen(key) + strlen(coalesce(value, '')) AS bytes FROM log),
fold AS (
  SELECT shard, write_id, CAST(1 AS BIGINT) AS segment, bytes AS used FROM sized WHERE write_id = 1
  UNION ALL
  SELECT s.shard, s.write_id, f.segment + CASE WHEN f.used + s.bytes > 4096 THEN 1 ELSE 0 END, CASE WHEN f.used + s.bytes > 4096 THEN s.bytes ELSE f.used + s.bytes END
  FROM fold f JOIN sized s ON s.shard = f.shard AND s.write_id = f.write_id + 1)"""

_WIDE = "wide AS (SELECT 'o-' || o_orderkey AS key FROM orders)"
_HASHED = f"hashed AS (SELECT key, {_FNV.format(key='key')} AS h FROM wide)"

_CLUSTER = """cl AS (
  SELECT event_id AS arrival, user_id % 3 AS node, CAST(1 + event_id // 200 - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS term, epoch_us(ts) // 1000 AS at_ms
  FROM events)"""

_OUTCOMES = f"""outcomes AS (
  SELECT seq, op, {_status("key", "value")} AS status FROM ops WHERE op = 'PUT'
  UNION ALL SELECT seq, op, CASE WHEN p = 'PUT' THEN 'OK' ELSE 'NOT_FOUND' END FROM mut WHERE op = 'DELETE'
  UNION ALL SELECT seq, 'GET', status FROM reads)"""

_REQUESTS = """rq AS (
  SELECT *, ['REPLICATE', 'CATCHUP_QUERY', 'HEARTBEAT', 'ELECTION_QUERY'][arrival % 4 + 1] AS opcode, arrival % 10 AS shard, CASE WHEN arrival % 3 = 0 THEN 'DELETE' ELSE 'PUT' END AS op FROM cl WHERE term >= 0)"""

_POSITIONS = """pos AS (SELECT shard, max(write_id) * (CASE WHEN shard % 2 = 0 THEN 1 ELSE 3 END) // 4 AS reached, max(write_id) // 2 AS half FROM log GROUP BY shard)"""

#: CRC-32 of bytes written as hex in a column: a table of 256 words from the polynomial, then a fold.
_CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, range(0, 8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS words)"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, words[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"""
_HEX = "lower(hex(encode(coalesce({x}, ''))))"

_READS = """marked AS (
  SELECT *, max(CASE WHEN op <> 'GET' THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls FROM valid),
reads AS (
  SELECT m.seq, m.key, CASE WHEN o.op = 'PUT' THEN 'OK' ELSE 'NOT_FOUND' END AS status, CASE WHEN o.op = 'PUT' THEN coalesce(o.value, '') END AS value
  FROM marked m LEFT JOIN ops o ON m.key = o.key AND m.ls = o.seq WHERE m.op = 'GET')"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


_TO_LOG = (_OPS, _MUT, _EFF, _LOG)


def twins() -> dict[str, str]:
    newest = lambda source, columns: f"SELECT {columns} FROM {source} QUALIFY row_number() OVER (PARTITION BY key ORDER BY write_id DESC) = 1"
    return {
        "q01_put_validation": f"""SELECT seq, {_status("key", "value")} AS status FROM (
            SELECT doc_id AS seq, text AS key, source AS value FROM documents
            UNION ALL SELECT -1, '', 'v' UNION ALL SELECT -2, 'k', repeat('x', {schemas.MAX_VALUE_BYTES + 1}))""",
        "q02_effective_log": _with(_OPS, _MUT, _EFF) + "SELECT seq, op, key, value FROM eff",
        "q03_key_versions": _with(_OPS, _MUT, _EFF) + "SELECT seq, key, version FROM eff",
        "q04_shard_write_ids": _with(*_TO_LOG) + "SELECT seq, key, shard, write_id, version FROM log",
        "q05_delete_status": _with(_OPS, _MUT) + "SELECT seq, CASE WHEN p = 'PUT' THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM mut WHERE op = 'DELETE'",
        "q06_latest_state": _with(*_TO_LOG, _STATE) + "SELECT shard, key, value, version, write_id, tombstone FROM state",
        "q07_live_kv": _with(*_TO_LOG, _STATE) + "SELECT key, value FROM state WHERE NOT tombstone",
        "q08_get_asof": _with(_OPS, _MUT, _READS) + "SELECT seq, key, status, value FROM reads",
        "q09_size_vs_live": _with(*_TO_LOG, _STATE) + "SELECT shard, count(*) AS size, count(*) FILTER (NOT tombstone) AS live FROM state GROUP BY shard",
        "q10_resurrected_keys": _with(_OPS, _MUT) + "SELECT key, count(*) AS resurrections, min(seq) AS first_seq FROM mut WHERE op = 'PUT' AND p = 'DELETE' GROUP BY key",
        "q11_recover_snapshot_tail": _with(*_TO_LOG, _HALF) + f"""SELECT shard, key, CASE WHEN op = 'PUT' THEN value END AS value, version, write_id, op = 'DELETE' AS tombstone FROM (
            ({newest("(SELECT log.* FROM log JOIN bounds USING (shard) WHERE write_id <= boundary_write_id)", "*")})
            UNION ALL SELECT log.* FROM log JOIN bounds USING (shard) WHERE write_id > boundary_write_id)
            QUALIFY row_number() OVER (PARTITION BY key ORDER BY write_id DESC) = 1""",
        "q12_scanned_vs_applied": _with(*_TO_LOG, _HALF) + "SELECT log.shard AS shard, count(*) AS scanned, count(*) FILTER (write_id > boundary_write_id) AS applied FROM log JOIN bounds ON log.shard = bounds.shard GROUP BY log.shard",
        "q13_segment_assignment": _with(*_TO_LOG, _SEGMENTS, recursive=True) + "SELECT shard, write_id, segment FROM fold",
        "q14_replicate_dedup": _with(*_TO_LOG, _ARRIVALS, _ACCEPTED) + "SELECT shard, arrival, write_id, key, op FROM accepted",
        "q15_migrate_newest_wins": _with(*_TO_LOG) + newest("log", "key, shard, write_id, version, op"),
        "q16_merge_rules_diff": _with(*_TO_LOG, _ARRIVALS, _ACCEPTED) + """SELECT n.key AS key, n.id AS migrated_id, r.id AS replicated_id, r.id IS NOT DISTINCT FROM n.id AS same
            FROM (SELECT key, max(write_id) AS id FROM arrivals GROUP BY key) n LEFT JOIN (SELECT key, max(write_id) AS id FROM accepted GROUP BY key) r ON n.key = r.key""",
        "q17_fnv1a": _with(_WIDE, _HASHED) + "SELECT key, CAST(h // 4294967296 AS BIGINT) AS hi, CAST(h % 4294967296 AS BIGINT) AS lo FROM hashed",
        "q18_shard_distribution": _with(_WIDE, _HASHED) + """SELECT CAST(s.i AS INTEGER) AS shard, coalesce(n, 0) AS keys,
            (coalesce(n, 0) - (SELECT count(*) FROM wide) / CAST(8 AS DOUBLE)) / ((SELECT count(*) FROM wide) / CAST(8 AS DOUBLE)) AS deviation
            FROM range(8) s(i) LEFT JOIN (SELECT h % 8 AS shard, count(*) AS n FROM hashed GROUP BY 1) c ON c.shard = s.i""",
        "q19_reshard_placement": _with(_WIDE, _HASHED) + "SELECT key, CAST(h % 8 AS INTEGER) AS old_shard, CAST(h % 6 AS INTEGER) AS new_shard FROM hashed",
        "q20_reshard_moved_keys": _with(_WIDE, _HASHED) + "SELECT CAST(h % 8 AS INTEGER) AS old_shard, CAST(h % 6 AS INTEGER) AS new_shard, count(*) AS keys FROM hashed GROUP BY 1, 2",
        "q21_reshard_no_loss": _with(_OPS, _MUT, _EFF) + 'SELECT count(DISTINCT key) AS before, count(DISTINCT key) AS "after", CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS changed FROM eff',
        "q22_dispatch_status": _with(_OPS, _MUT, _READS, _OUTCOMES) + """SELECT role, op, CASE WHEN role = 'follower' THEN 'NOT_LEADER' WHEN status IN ('OK', 'NOT_FOUND') THEN status ELSE 'BAD_REQUEST' END AS status, count(*) AS n
            FROM outcomes, (VALUES ('leader'), ('follower')) r(role) GROUP BY 1, 2, 3""",
        "q23_epoch_fencing": _with(_CLUSTER) + """SELECT arrival, node, term, epoch, CASE WHEN term < epoch THEN 'REJECT' WHEN term = epoch THEN 'ACCEPT' ELSE 'ADOPT' END AS verdict FROM (
            SELECT *, greatest(1, coalesce(max(term) OVER (PARTITION BY node ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS epoch FROM cl)""",
        "q24_election_winner": """WITH p AS (SELECT s_suppkey + 6380 AS port, CAST(floor(abs(s_acctbal)) AS BIGINT) AS total FROM supplier WHERE s_suppkey % 5 <> 0),
            w AS (SELECT * FROM (SELECT port, total FROM p UNION ALL SELECT 6380, 5000) ORDER BY total DESC, port ASC LIMIT 1)
            SELECT CASE WHEN port = 6380 THEN 'PROMOTE' ELSE 'STAND_BACK' END AS decision, CAST(2 AS BIGINT) AS epoch, CAST(port AS BIGINT) AS winner_port, CAST(total AS BIGINT) AS winner_total, (SELECT count(*) FROM p) AS respondents FROM w""",
        "q25_total_committed": _with(_OPS, _MUT, _EFF) + "SELECT count(*) AS total FROM eff",
        "q26_heartbeat_gaps": _with(_CLUSTER) + """SELECT node, arrival, gap_ms, coalesce(gap_ms >= 150, false) AS timed_out FROM (
            SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY node ORDER BY arrival) AS gap_ms FROM cl)""",
        "q27_catchup_mode": _with(*_TO_LOG) + """SELECT shard, m * (CASE WHEN shard % 2 = 0 THEN 1 ELSE 3 END) // 4 AS last_applied, m // 2 AS boundary_write_id,
            CASE WHEN m * (CASE WHEN shard % 2 = 0 THEN 1 ELSE 3 END) // 4 < m // 2 THEN 'SNAPSHOT' ELSE 'TAIL' END AS mode FROM (SELECT shard, max(write_id) AS m FROM log GROUP BY shard)""",
        "q28_replication_lag": _with(*_TO_LOG) + "SELECT shard, m AS leader_id, m * 9 // 10 AS ack_index, m - m * 9 // 10 AS lag FROM (SELECT shard, max(write_id) AS m FROM log GROUP BY shard)",
        "q29_replica_diff": _with(*_TO_LOG, _REPLICA) + f"""SELECT coalesce(l.shard, r.shard) AS shard, coalesce(l.key, r.key) AS key,
            CASE WHEN r.key IS NULL THEN 'MISSING' WHEN l.key IS NULL THEN 'EXTRA' ELSE 'CHANGED' END AS difference, l.version AS left_version, r.version AS right_version
            FROM ({newest("log", "*")}) l FULL JOIN ({newest("replica", "*")}) r ON l.key = r.key WHERE l.write_id IS DISTINCT FROM r.write_id""",
        "q30_latency_percentiles": """SELECT event_type, n AS samples, max(value) FILTER (r = least(50 * n // 100, n - 1)) AS p50, max(value) FILTER (r = least(95 * n // 100, n - 1)) AS p95, max(value) FILTER (r = least(99 * n // 100, n - 1)) AS p99 FROM (
            SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type, n""",
        "q31_workload_mix": "SELECT CASE WHEN event_id * 7919 % 100 < 90 THEN 'GET' ELSE 'PUT' END AS op, count(*) AS n FROM events GROUP BY 1",
        "q32_copied_bytes": _with(*_TO_LOG, _STATE) + "SELECT shard, b AS bytes, b * 1000 // 50000 AS millis FROM (SELECT shard, CAST(sum(strlen(key) + strlen(coalesce(value, ''))) AS BIGINT) AS b FROM state GROUP BY shard)",
        "q33_truncatable_segments": _with(*_TO_LOG, _SEGMENTS, _HALF, recursive=True) + """SELECT shard, segment, last FROM (
            SELECT e.shard, segment, last, min(CASE WHEN last <= boundary_write_id AND segment < active THEN 1 ELSE 0 END) OVER (PARTITION BY e.shard ORDER BY segment) AS ok
            FROM (SELECT shard, segment, max(write_id) AS last, max(segment) OVER (PARTITION BY shard) AS active FROM fold GROUP BY shard, segment) e JOIN bounds b ON b.shard = e.shard) WHERE ok = 1""",
        "q34_wal_record_bytes": _with(*_TO_LOG) + "SELECT shard, write_id, CAST(33 + strlen(key) + strlen(coalesce(value, '')) AS BIGINT) AS bytes FROM log",
        "q36_wal_decode": _with(*_TO_LOG) + "SELECT shard, write_id, version, op, key, value FROM log QUALIFY write_id < max(write_id) OVER (PARTITION BY shard)",
        "q37_frame_decode": _with(_OPS) + """SELECT key || '/' || seq // 1000 AS connection, row_number() OVER (PARTITION BY key, seq // 1000 ORDER BY seq) - 1 AS position, 'OK' AS status, op AS opcode, seq AS request_id, key,
            CASE WHEN op = 'PUT' THEN coalesce(value, '') END AS value FROM ops""",
        "q38_stream_latest_state": _with(*_TO_LOG, _STATE) + "SELECT key, value, version, tombstone FROM state",
        "q39_stream_replica": _with(*_TO_LOG, _ARRIVALS, _ACCEPTED) + newest("accepted", "shard, key, CASE WHEN op = 'PUT' THEN value END AS value, version, write_id, op = 'DELETE' AS tombstone"),
        "q40_manifest_rollback": _with(*_TO_LOG, _STATE) + "SELECT shard, key, version, tombstone FROM state",
        "q35_wal_crc": _with(*_TO_LOG, _CRC_TABLE) + f"""SELECT shard, write_id, crc AS crc32, printf('%08x', length(body) // 2 + 4) || body || printf('%08x', crc) AS record FROM (
            SELECT shard, write_id, body, CAST({_CRC.format(h="body")} AS BIGINT) AS crc FROM (
              SELECT shard, write_id, printf('%02x%016x%016x%08x%08x', CASE WHEN op = 'PUT' THEN 1 ELSE 2 END, write_id, version, strlen(key), strlen(coalesce(value, ''))) || {_HEX.format(x="key")} || {_HEX.format(x="value")} AS body FROM log) b, crc) x""",
        "q41_catch_up_state": _with(*_TO_LOG, _STATE) + "SELECT shard, key, value, version, write_id, tombstone FROM state",
        "q42_catch_up_shipped": _with(*_TO_LOG, _POSITIONS) + """SELECT s.shard AS shard, mode, count(*) AS shipped, count(*) FILTER (write_id > reached) AS fresh, max(write_id) AS upto FROM (
              SELECT log.shard, max(write_id) AS write_id, 'SNAPSHOT' AS mode FROM log JOIN pos ON log.shard = pos.shard WHERE reached < half AND write_id <= half GROUP BY log.shard, key
              UNION ALL SELECT log.shard, write_id, 'TAIL' FROM log JOIN pos ON log.shard = pos.shard WHERE write_id > greatest(reached, half)) s
            JOIN pos ON s.shard = pos.shard GROUP BY s.shard, mode""",
        "q43_replay_after": _with(*_TO_LOG) + "SELECT shard, write_id, op, key FROM (SELECT *, max(write_id) OVER (PARTITION BY shard) AS m FROM log) WHERE write_id > m // 2 AND write_id < m",
        "q44_node_dispatch": _with(_CLUSTER, _REQUESTS) + """SELECT arrival, node, opcode, status, printf('%08x%02x%016x', 9 + length(payload) // 2, list_position(['OK', 'NOT_FOUND', 'BAD_REQUEST', 'NOT_LEADER', 'STALE_TERM'], status) - 1, arrival) || payload AS response FROM (
            SELECT *, CASE WHEN status = 'STALE_TERM' THEN printf('%016x', epoch) WHEN status = 'OK' AND opcode = 'CATCHUP_QUERY' THEN printf('%016x', arrival * 3)
              WHEN status = 'OK' AND opcode = 'ELECTION_QUERY' THEN printf('%016x%016x', epoch, arrival * 5) ELSE '' END AS payload FROM (
            SELECT *, CASE WHEN opcode = 'ELECTION_QUERY' THEN 'OK' WHEN opcode = 'REPLICATE' AND node = 0 THEN 'BAD_REQUEST' WHEN opcode = 'CATCHUP_QUERY' AND (node = 0 OR shard >= 8) THEN 'BAD_REQUEST'
              WHEN term < epoch THEN 'STALE_TERM' ELSE 'OK' END AS status FROM (
            SELECT *, greatest(1, coalesce(max(term) OVER (PARTITION BY node ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS epoch FROM rq)))""",
        "q45_node_frames": _with(_CLUSTER, _REQUESTS) + """SELECT node || '/' || arrival // 1000 AS connection, row_number() OVER (PARTITION BY node, arrival // 1000 ORDER BY arrival) - 1 AS position, CASE WHEN bad THEN 'BAD_REQUEST' ELSE 'OK' END AS status, opcode, arrival AS request_id,
              CASE WHEN NOT bad AND opcode <> 'ELECTION_QUERY' THEN term END AS term, CASE WHEN NOT bad AND opcode = 'CATCHUP_QUERY' THEN shard END AS shard, CASE WHEN NOT bad AND opcode = 'REPLICATE' THEN op END AS op,
              CASE WHEN NOT bad AND opcode = 'REPLICATE' THEN arrival + 1 END AS write_id, CASE WHEN NOT bad AND opcode = 'REPLICATE' THEN shard + 1 END AS version, CASE WHEN NOT bad AND opcode = 'REPLICATE' THEN 'k' || arrival END AS key,
              CASE WHEN NOT bad AND opcode = 'REPLICATE' THEN CASE WHEN op = 'PUT' THEN 'v' ELSE '' END END AS value
            FROM (SELECT *, arrival % 50 = 0 AND opcode <> 'ELECTION_QUERY' AS bad FROM rq)""",
        "q46_payloads": _with(*_TO_LOG) + f"""SELECT shard, write_id, 'local' AS owner,
              printf('%016x%02x%016x%016x%08x', 1, CASE WHEN op = 'PUT' THEN 1 ELSE 2 END, write_id, version, strlen(key)) || {_HEX.format(x="key")} || {_HEX.format(x="value")} AS replicate,
              printf('%016x%016x', 1, shard) AS catchup, write_id AS last_applied, CAST(0 AS BIGINT) AS too_short, version AS reply_epoch, write_id AS reply_total FROM log""",
        "q47_keys_lost_with_the_leader": _with(*_TO_LOG) + "SELECT key FROM (SELECT *, max(write_id) OVER (PARTITION BY shard) // 40 AS upto FROM log) GROUP BY key HAVING min(write_id - upto) > 0",
        "q48_responses_matched": """SELECT count(*) AS requests, count(*) FILTER (event_id % 97 <> 0) + count(*) FILTER (event_id > 0 AND event_id % 89 = 0) AS responses,
            count(*) FILTER (event_id % 97 = 0) AS unanswered, count(*) FILTER (event_id > 0 AND event_id % 89 = 0) AS unasked FROM events""",
        "q49_table_accounts": _with(*_TO_LOG) + """SELECT count(DISTINCT shard) AS shards, count(DISTINCT key) FILTER (seq < h) AS entries_loaded, count(*) FILTER (seq >= h) AS replayed, CAST(1 AS BIGINT) AS segments
            FROM log, (SELECT max(event_id) // 2 AS h FROM events)""",
        "q50_highest_epoch": _with(_CLUSTER) + """SELECT node, greatest(max(term), 1) AS epoch, arg_max(CASE WHEN term < before THEN 'REJECT' WHEN term = before THEN 'ACCEPT' ELSE 'ADOPT' END, arrival) AS last_verdict FROM (
            SELECT *, greatest(1, coalesce(max(term) OVER (PARTITION BY node ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS before FROM cl) GROUP BY node""",
        "q51_links_after_promotion": "SELECT s_suppkey + 6380 AS port, CAST(2 AS BIGINT) AS epoch FROM supplier",
        "q52_entries_as_records": _with(*_TO_LOG) + newest("log", "shard, write_id, version, op, key, CASE WHEN op = 'PUT' THEN value END AS value"),
        "q53_parse_peers": "SELECT 'host-' || s_suppkey AS host, CAST(s_suppkey + 6380 AS INTEGER) AS port FROM supplier UNION ALL SELECT 'other', CAST(s_suppkey + 1 AS INTEGER) FROM supplier",
        "q54_throughput": """SELECT event_type, n, millis, per_second, per_second / v AS speed_up, 100.0::DOUBLE * (per_second - v) / v AS dip_percent FROM (
            SELECT *, max(per_second) FILTER (event_type = 'view') OVER () AS v FROM (
            SELECT event_type, n, millis, CASE WHEN millis > 0 THEN n * 1000.0::DOUBLE / millis END AS per_second FROM (
            SELECT event_type, count(*) AS n, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS millis FROM events GROUP BY event_type)))""",
        "q55_segment_names": _with(*_TO_LOG, _SEGMENTS, recursive=True) + """SELECT shard, max(segment) AS segments, 'shard_' || shard || '/' || lpad(min(segment)::VARCHAR, 10, '0') || '.wal' AS lowest,
            'shard_' || shard || '/' || lpad(max(segment)::VARCHAR, 10, '0') || '.wal' AS active FROM fold GROUP BY shard""",
        "q56_throttled_copy": _with(*_TO_LOG) + """SELECT shard, write_id, CAST(sum(strlen(key) + strlen(coalesce(value, ''))) OVER (PARTITION BY shard ORDER BY write_id) AS BIGINT) * 1000 // 50000 AS done_ms FROM log""",
        "q57_workload_keys": _with(_OPS) + """SELECT seq, form, CASE form WHEN 'throughput' THEN 'c' || seq % 2 || '-k' || seq // 2 WHEN 'concurrency' THEN 't' || seq % 2 || '-k' || seq // 2
            WHEN 'rebalance' THEN 'pre-k' || seq ELSE 'key' || seq END AS key FROM ops, (VALUES ('throughput'), ('concurrency'), ('rebalance'), ('restore')) f(form)""",
        "q58_table_rebalanced": _with(_OPS, _MUT, _EFF) + """SELECT count(DISTINCT key) AS before, count(DISTINCT key) AS "after", CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS changed,
            CAST(3 AS INTEGER) AS shards, 'done' AS status FROM eff""",
        "q59_rebalanced_while_written": _with(*_TO_LOG, _STATE) + "SELECT key, value, version, tombstone FROM state",
    }
