"""Big-endian integers and record codecs as columns: what the log, the snapshot and the wire hold, built in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record types, bytes of a log record besides key and value, of a snapshot's header, of a manifest,
# opcodes and status codes.
RECORD_TYPES = {"PUT": 1, "DELETE": 2}
RECORD_OVERHEAD = 33
SNAPSHOT_MAGIC, MANIFEST_MAGIC, FORMAT_VERSION = b"KVSN", b"KVSM", 1
OPCODES = {"PUT": 1, "GET": 2, "DELETE": 3, "REPLICATE": 4, "CATCHUP_QUERY": 5, "HEARTBEAT": 6, "ELECTION_QUERY": 7}
STATUS = {"OK": 0, "NOT_FOUND": 1, "BAD_REQUEST": 2, "NOT_LEADER": 3, "STALE_TERM": 4}


def unsigned(n: Column, size: int) -> Column:
    """``size`` bytes, big-endian, of a number that is not negative."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def read_unsigned(data: Column, start: int | Column, size: int) -> Column:
    """Number in ``size`` bytes from ``start`` (from 1); 0 where the data is too short, as replies are read."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.when(F.octet_length(data) >= at + size - 1, F.conv(F.hex(F.substring(data, at, F.lit(size))), 16, 10).cast("decimal(20,0)").cast("long")).otherwise(F.lit(0).cast("long"))


def as_bytes(value: Column) -> Column:
    return F.coalesce(value.cast("binary"), F.lit(b""))


def record_size(key: Column, value: Column) -> Column:
    return (F.lit(RECORD_OVERHEAD) + F.octet_length(as_bytes(key)) + F.octet_length(as_bytes(value))).cast("long")


def record_body(op: Column, write_id: Column, version: Column, key: Column, value: Column) -> Column:
    kind = F.when(op == "PUT", RECORD_TYPES["PUT"]).otherwise(RECORD_TYPES["DELETE"])
    k, v = as_bytes(key), as_bytes(value)
    return F.concat(unsigned(kind, 1), unsigned(write_id, 8), unsigned(version, 8), unsigned(F.octet_length(k), 4), unsigned(F.octet_length(v), 4), k, v)


def record_crc(op: Column, write_id: Column, version: Column, key: Column, value: Column) -> Column:
    return F.crc32(record_body(op, write_id, version, key, value))


def encode_record(op: Column, write_id: Column, version: Column, key: Column, value: Column) -> Column:
    """A whole log record: length of what follows, body, checksum."""
    body = record_body(op, write_id, version, key, value)
    return F.concat(unsigned(F.octet_length(body) + 4, 4), body, unsigned(F.crc32(body), 4))


def encode_frame(code: Column, request_id: Column, payload: Column) -> Column:
    """Length of what follows, opcode or status, request id, payload."""
    return F.concat(unsigned(F.octet_length(payload) + 9, 4), unsigned(code, 1), unsigned(request_id, 8), payload)


def encode_response(status: Column, request_id: Column, payload: Column) -> Column:
    """A response's frame: its status takes the opcode's place; a null payload is an empty one."""
    code = F.lit(None).cast("int")
    for name, number in STATUS.items():
        code = F.when(status == name, number).otherwise(code)
    return encode_frame(code, request_id, as_bytes(payload))


def status_payload(status: Column, reply: Column, epoch: Column) -> Column:
    """What a response carries: the epoch where a term is stale, the reply where all is well, else nothing."""
    return F.when(status == "STALE_TERM", unsigned(epoch, 8)).when(status == "OK", as_bytes(reply)).otherwise(F.lit(b""))


def request_payload(op: Column, key: Column, value: Column) -> Column:
    """Payload of PUT (length of key, key, value), GET and DELETE (key)."""
    k = as_bytes(key)
    return F.when(op == "PUT", F.concat(unsigned(F.octet_length(k), 4), k, as_bytes(value))).otherwise(k)


def replicate_payload(term: Column, op: Column, write_id: Column, version: Column, key: Column, value: Column) -> Column:
    kind = F.when(op == "PUT", RECORD_TYPES["PUT"]).otherwise(RECORD_TYPES["DELETE"])
    k = as_bytes(key)
    return F.concat(unsigned(term, 8), unsigned(kind, 1), unsigned(write_id, 8), unsigned(version, 8), unsigned(F.octet_length(k), 4), k, as_bytes(value))


def catchup_payload(term: Column, shard: Column) -> Column:
    return F.concat(unsigned(term, 8), unsigned(shard, 8))


def encode_last_applied(n: Column) -> Column:
    return unsigned(n, 8)


def decode_last_applied(payload: Column) -> Column:
    return read_unsigned(payload, 1, 8)


def encode_election_reply(epoch: Column, total: Column) -> Column:
    return F.concat(unsigned(epoch, 8), unsigned(total, 8))


def decode_election_reply(payload: Column) -> Column:
    """struct(epoch, total); both 0 where the payload is too short."""
    whole = F.octet_length(payload) >= 16
    part = lambda at: F.when(whole, read_unsigned(payload, at, 8)).otherwise(F.lit(0).cast("long"))
    return F.struct(part(1).alias("epoch"), part(9).alias("total"))


def current_term(epoch: Column) -> Column:
    return F.coalesce(epoch.cast("long"), F.lit(1).cast("long"))


def owning_node() -> Column:
    return F.lit("local")


def segment_name(number: Column) -> Column:
    """Ten digits, more where the number has more, and the suffix."""
    text = number.cast("string")
    return F.concat(F.when(F.length(text) < 10, F.lpad(text, 10, "0")).otherwise(text), F.lit(".wal"))


def shard_dir(generation: Column, shard: Column) -> Column:
    """Folder of a shard below the root: generation 0 has none of its own."""
    name = F.concat(F.lit("shard_"), shard.cast("string"))
    return F.when(generation == 0, name).otherwise(F.concat(F.lit("gen_"), generation.cast("string"), F.lit("/"), name))
