"""Decoders of binary logs, snapshots, manifests and frames: plain functions, and readers over Spark's binaryFile source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomlog import schemas, scratch
from loomlog.functions import binary
from loomlog.functions.binary import FORMAT_VERSION, MANIFEST_MAGIC, OPCODES, RECORD_TYPES, SNAPSHOT_MAGIC, STATUS

_KINDS = {code: name for name, code in RECORD_TYPES.items()}
_OPS = {code: name for name, code in OPCODES.items()}
_BODY = struct.Struct(">BQQII")
#: The smallest length a record can announce, and the largest a frame may (fixed values: 9, 29, and the limits of key and value).
LEAST_RECORD = _BODY.size + 4
LEAST_FRAME, MOST_FRAME = 9, 9 + 29 + schemas.MAX_KEY_BYTES + schemas.MAX_VALUE_BYTES


class CorruptLog(ValueError):
    """A file that must be whole is not."""


def encode_record(op: str, write_id: int, version: int, key: bytes, value: bytes = b"") -> bytes:
    body = _BODY.pack(RECORD_TYPES[op], write_id, version, len(key), len(value)) + key + value
    return struct.pack(">I", len(body) + 4) + body + struct.pack(">I", zlib.crc32(body))


def scan_segment(data: bytes) -> tuple[list[tuple[str, int, int, bytes, bytes]], int]:
    """Records of the valid prefix, and its length. The scan stops at the first record that is short, misshapen or fails its checksum."""
    at, out = 0, []
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        end = at + 4 + size
        if size < LEAST_RECORD or end > len(data):
            break
        body = data[at + 4 : end - 4]
        kind, write_id, version, key_size, value_size = _BODY.unpack_from(body)
        if kind not in _KINDS or _BODY.size + key_size + value_size != len(body) or struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(body):
            break
        key_end = _BODY.size + key_size
        out.append((_KINDS[kind], write_id, version, body[_BODY.size : key_end], body[key_end:]))
        at = end
    return out, at


def encode_snapshot(boundary: int, entries: list[tuple[bytes, bytes, int, int, bool]]) -> bytes:
    """entries: (key, value, version, write_id, tombstone)."""
    parts = [SNAPSHOT_MAGIC, struct.pack(">BQQ", FORMAT_VERSION, boundary, len(entries))]
    for key, value, version, write_id, tombstone in entries:
        parts += [struct.pack(">IIQQB", len(key), len(value), version, write_id, tombstone), key, value]
    return b"".join(parts)


def decode_snapshot(data: bytes) -> tuple[int, list[tuple[bytes, bytes, int, int, bool]]]:
    """Boundary and entries; CorruptLog where magic or version is wrong or the file ends early."""
    if data[:4] != SNAPSHOT_MAGIC or len(data) < 21 or data[4] != FORMAT_VERSION:
        raise CorruptLog("not a snapshot of this version")
    boundary, count = struct.unpack_from(">QQ", data, 5)
    at, entries = 21, []
    for _ in range(count):
        if at + 25 > len(data):
            raise CorruptLog("the snapshot ends early")
        key_size, value_size, version, write_id, tombstone = struct.unpack_from(">IIQQB", data, at)
        at += 25
        if at + key_size + value_size > len(data):
            raise CorruptLog("the snapshot ends early")
        entries.append((data[at : at + key_size], data[at + key_size : at + key_size + value_size], version, write_id, bool(tombstone)))
        at += key_size + value_size
    return boundary, entries


def encode_manifest(generation: int, shards: int) -> bytes:
    return MANIFEST_MAGIC + struct.pack(">BQQ", FORMAT_VERSION, generation, shards)


def decode_manifest(data: bytes) -> tuple[int, int]:
    if len(data) != 21 or data[:4] != MANIFEST_MAGIC or data[4] != FORMAT_VERSION:
        raise CorruptLog("not a manifest of this version")
    return struct.unpack_from(">QQ", data, 5)


def encode_response(status: str, request_id: int, payload: bytes = b"") -> bytes:
    """Length of what follows, status, request id, payload."""
    return struct.pack(">IBQ", len(payload) + LEAST_FRAME, STATUS[status], request_id) + payload


@dataclass
class FrameParser:
    """Frames from bytes that come in pieces. After a frame of impossible length nothing more is read."""

    held: bytes = b""
    broken: bool = False

    def feed(self, data: bytes) -> list[tuple[int, int, bytes]]:
        """(opcode, request_id, payload) of the frames that are whole by now."""
        self.held += data
        out = []
        at = 0
        while not self.broken and at + 4 <= len(self.held):
            (size,) = struct.unpack_from(">I", self.held, at)
            if not LEAST_FRAME <= size <= MOST_FRAME:
                self.broken = True
            elif at + 4 + size > len(self.held):
                break
            else:
                code, request_id = struct.unpack_from(">BQ", self.held, at + 4)
                out.append((code, request_id, self.held[at + 13 : at + 4 + size]))
                at += 4 + size
        self.held = self.held[at:]
        return out


def parse_request(code: int, payload: bytes) -> dict | None:
    """Fields of a request, or None where its shape is wrong."""
    op = _OPS.get(code)
    if op == "PUT" and len(payload) >= 4:
        (size,) = struct.unpack_from(">I", payload)
        if size <= len(payload) - 4:
            return {"key": payload[4 : 4 + size], "value": payload[4 + size :]}
    elif op in ("GET", "DELETE"):
        return {"key": payload}
    elif op == "REPLICATE" and len(payload) >= 29:
        term, kind, write_id, version, size = struct.unpack_from(">QBQQI", payload)
        if kind in _KINDS and size <= len(payload) - 29:
            return {"term": term, "op": _KINDS[kind], "write_id": write_id, "version": version, "key": payload[29 : 29 + size], "value": payload[29 + size :]}
    elif op == "CATCHUP_QUERY" and len(payload) == 16:
        term, shard = struct.unpack(">QQ", payload)
        return {"term": term, "shard": shard}
    elif op == "HEARTBEAT" and len(payload) == 8:
        return {"term": struct.unpack(">Q", payload)[0]}
    elif op == "ELECTION_QUERY" and not payload:
        return {}
    return None


def _decoding(schema: T.StructType, decode: Callable[[str, bytes], Iterator[tuple]], rows: int = 10_000):
    """Arrow batches of what ``decode`` makes of each (name, content, ...), as tuples in the order of the schema.

    Columns are filled across inputs: many short files or connections make one batch.
    """
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for given in batches:
            for one in zip(*(c.to_pylist() for c in given.columns), strict=True):
                for row in decode(*one):
                    held.append(row)
                    if len(held) >= rows:
                        yield batch()
                        held = []
        if held:
            yield batch()

    return run


def decode_wal(segments: DataFrame) -> DataFrame:
    """Records of (segment, content, active): a torn tail of an active segment is left out, one of a closed segment is an error.

    With a column ``after`` only records of higher write_ids come (a replay): whole files are checked all the same.
    """

    def decode(name: str, data: bytes | None, active: bool, after: int) -> Iterator[tuple]:
        data = data or b""
        records, end = scan_segment(data)
        if end < len(data) and not active:
            raise CorruptLog(f"{name}: a closed segment is damaged after byte {end}")
        for k, (op, write_id, version, key, value) in enumerate(records):
            if write_id > after:
                yield name, k, op, write_id, version, key, value if op == "PUT" else None

    after = F.coalesce(F.col("after"), F.lit(0)) if "after" in segments.columns else F.lit(0)
    return segments.select("segment", "content", "active", after.cast("long")).mapInArrow(_decoding(schemas.WAL_RECORD, decode), schemas.WAL_RECORD)


#: Folders whose last segments are broadcast; a table has one for each shard.
MOST_FOLDERS = 100_000


def read_wal(spark: SparkSession, path: str, after: DataFrame | None = None) -> DataFrame:
    """Records of all segments below ``path``: ten or more digits and .wal; the last of each folder is the active one.

    after: (folder, write_id), below which a folder's records are left out; folder is its name, such as shard_3. What
    each folder's last segment is comes from the listing and is broadcast, so no content is shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wal").load(path)
    number = F.regexp_extract("path", r"/(\d{10,})\.wal$", 1)
    files = files.withColumns({"_folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "_number": F.when(number != "", number).cast("decimal(38,0)")}).where(F.col("_number").isNotNull())
    last = scratch.written(files.groupBy("_folder").agg(F.max("_number").alias("_last")))
    if after is not None:
        last = last.join(after.select(F.col("folder").alias("_name"), F.col("write_id").alias("after")), F.substring_index("_folder", "/", -1) == F.col("_name"), "left").drop("_name")
    if last.count() <= MOST_FOLDERS:
        last = F.broadcast(last)
    found = files.join(last, "_folder").withColumns({"segment": F.col("path"), "active": F.col("_number") == F.col("_last")})
    return decode_wal(found.select("segment", "content", "active", *(["after"] if after is not None else [])))


def last_write_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("segment").agg(F.max("write_id").alias("write_id"), F.count("*").alias("records"))


def decode_frames(streams: DataFrame) -> DataFrame:
    """Requests of (connection, content): one row for each frame, in order.

    ``status`` is OK, BAD_REQUEST for a frame of the wrong shape (the connection goes on), or CLOSED for the place
    where a length is impossible and the rest of the connection is lost.
    """

    fields = schemas.REQUEST.names[5:]

    def decode(name: str, data: bytes | None) -> Iterator[tuple]:
        parser, k = FrameParser(), 0
        for k, (code, request_id, payload) in enumerate(parser.feed(data or b""), 1):
            found = parse_request(code, payload)
            get = (found or {}).get
            yield name, k - 1, "BAD_REQUEST" if found is None else "OK", _OPS.get(code), request_id, *[get(f) for f in fields]
        if parser.broken:
            yield name, k, "CLOSED", None, None, *[None for _ in fields]

    return streams.select("connection", "content").mapInArrow(_decoding(schemas.REQUEST, decode), schemas.REQUEST)


def read_snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of binary snapshots: file, boundary_write_id, key, value (null for a tombstone), version, write_id, tombstone."""
    def decode(name: str, data: bytes | None) -> Iterator[tuple]:
        boundary, entries = decode_snapshot(data or b"")
        for key, value, version, write_id, tombstone in entries:
            yield name, boundary, key, None if tombstone else value, version, write_id, tombstone

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(_decoding(schemas.SNAPSHOT_ENTRY, decode), schemas.SNAPSHOT_ENTRY)


def pack_segments(log: DataFrame) -> DataFrame:
    """(shard, segment, content, active) of a log with ``segment``: the bytes of each segment, records in the order of write_id.

    A segment is as large as the limit it was cut by, so its records fit in a row.
    """
    record = binary.encode_record(*[F.col(c) for c in ("op", "write_id", "version", "key", "value")])
    whole = log.select("shard", "segment", "write_id", record.alias("record")).groupBy("shard", "segment").agg(joined("record", "write_id").alias("content"))
    last = log.groupBy("shard").agg(F.max("segment").alias("_last")).withColumnRenamed("shard", "_shard")
    return whole.join(last, F.col("shard") == F.col("_shard")).select("shard", "segment", "content", (F.col("segment") == F.col("_last")).alias("active"))


def joined(part: str, order: str):
    """Aggregate: the bytes of column ``part``, one row's after the other's in the order of a column."""
    return F.expr(f"listagg({part}) WITHIN GROUP (ORDER BY {order})")


def write_wal(log: DataFrame, root: str) -> DataFrame:
    """Writes a log with ``segment`` as binary segment files below ``root``, and returns (path, bytes) of each.

    A file is written beside its place and moved there, so a reader sees whole files, and a task that is run again
    writes the same ones. ``root`` is a path or URI that Arrow's file systems know and all executors share; a plain
    path is one of the machine itself, so only a local session takes it.
    """
    master = log.sparkSession.sparkContext.master
    if "://" not in root and not root.startswith("file:") and master != "local" and not master.startswith("local["):
        raise ValueError("on a cluster the root must be a URI of storage that all executors share")
    name = F.concat(binary.shard_dir(F.lit(0), F.col("shard")), F.lit("/"), binary.segment_name(F.col("segment")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            paths = [f"{base.rstrip('/')}/{n}" for n in batch.column(0).to_pylist()]
            for path, data in zip(paths, batch.column(1).to_pylist(), strict=True):
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{path}.new") as out:
                    out.write(data)
                system.move(f"{path}.new", path)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([len(d) for d in batch.column(1).to_pylist()], pa.int64())], names=["path", "bytes"])

    return pack_segments(log).select(name.alias("name"), "content").mapInArrow(write, "path string, bytes bigint")
