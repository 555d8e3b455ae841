"""A change log as a table on any Hadoop file system: generations, an atomic manifest, snapshots, resharding.

Layout below the root:

- ``MANIFEST``: generation and number of shards, 21 bytes; replacing it is the only commit of a new layout;
- ``gen_<k>/log/n=<segment>/``: one folder of Parquet for each appended batch, partitioned by shard;
- ``gen_<k>/snapshot/n=<n>/`` and ``gen_<k>/meta/n=<n>/``: state up to a boundary for each shard.

A batch or snapshot counts once its _SUCCESS file is there. Generations that the manifest doesn't name are left over
from a resharding that was not committed; opening the table removes them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog import schemas, scratch
from loomlog.functions import hashing
from loomlog.operators import blocked, cluster, layout, merge, oplog, state
from loomlog.sources import codec


class Files:
    """The few file operations that publishing needs, on the file system of a path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> bytes:
        size = self._fs.getFileStatus(self._path(name)).getLen()
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.read() & 0xFF for _ in range(size))
        finally:
            stream.close()

    def replace(self, name: str, data: bytes) -> None:
        """Writes a new file beside and renames it over the old one."""
        new = f"{name}.new"
        stream = self._fs.create(self._path(new), True)
        try:
            stream.write(bytearray(data))
            if hasattr(stream, "hsync"):
                stream.hsync()
        finally:
            stream.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._fs.getConf())
        context.rename(self._path(new), self._path(name), options)


class ChangeLog:
    """A durable, sharded change log. One writer at a time; readers see whole batches and whole layouts."""

    def __init__(self, spark: SparkSession, root: str, shards: int = schemas.DEFAULT_SHARDS) -> None:
        """Opens or creates the table. A committed manifest decides the number of shards, whatever is asked for."""
        if shards < 1:
            raise ValueError("a layout has at least one shard")
        self.spark, self.files = spark, Files(spark, root)
        if self.files.exists("MANIFEST"):
            self.generation, self.shards = codec.decode_manifest(self.files.read("MANIFEST"))
        else:
            self.generation, self.shards = 0, shards
            self.files.replace("MANIFEST", codec.encode_manifest(0, shards))
        for name in self.files.names(""):
            if re.fullmatch(r"gen_\d+", name) and name != self._gen():
                self.files.remove(name)
        self.rebalance_state = "idle"
        self._staged: tuple[int, list[str], DataFrame] | None = None

    # ---- layout ----

    def _gen(self) -> str:
        return f"gen_{self.generation}"

    def _done(self, kind: str) -> list[str]:
        base = f"{self._gen()}/{kind}"
        return [n[2:] for n in self.files.names(base) if n.startswith("n=") and self.files.exists(f"{base}/{n}/_SUCCESS")]

    def _read(self, kind: str, names: list[str], schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        base = f"{self.files.root}/{self._gen()}/{kind}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/n={n}" for n in names]).select(*schema.names)

    def segments(self) -> list[str]:
        return self._done("log")

    def log(self) -> DataFrame:
        """Records of all segments that are still there."""
        return self._read("log", self.segments(), schemas.OPLOG)

    def snapshot(self) -> DataFrame:
        return self._read("snapshot", self._done("snapshot")[-1:], schemas.STATE)

    def boundaries(self) -> DataFrame:
        return self._read("meta", self._done("snapshot")[-1:], schemas.SNAPSHOT_META)

    # ---- reads ----

    def state(self) -> DataFrame:
        """Latest entry of each key, tombstones included: the snapshot and the log after its boundaries."""
        if not self.segments():
            return self.snapshot()
        return state.recover(self.snapshot(), self.boundaries(), self.log())

    def entry(self, key: str) -> DataFrame:
        """The entry of one key. Its shard is a literal in both scans: other shards' folders are not opened."""
        own = (F.col("shard") == hashing.shard_of(key, self.shards)) & (F.col("key") == key)
        return state.recover(self.snapshot().where(own), self.boundaries(), self.log().where(own))

    def get(self, key: str) -> str | None:
        row = self.entry(key).where(~F.col("tombstone")).select("value").first()
        return None if row is None else row["value"]

    def peek(self, key: str):
        return self.entry(key).first()

    def size(self) -> int:
        """Entries, tombstones included."""
        return self.state().count()

    def live_count(self) -> int:
        return state.live(self.state()).count()

    def entries_loaded(self) -> int:
        """Entries of all shards' snapshots."""
        return self.boundaries().agg(F.coalesce(F.sum("entry_count"), F.lit(0))).first()[0]

    def last_applied(self) -> DataFrame:
        """Highest write_id of each shard that has one."""
        both = self.log().select("shard", "write_id").unionByName(self.boundaries().select("shard", F.col("boundary_write_id").alias("write_id")))
        return both.groupBy("shard").agg(F.max("write_id").alias("write_id"))

    # ---- writes ----

    def _publish(self, df: DataFrame, kind: str, name: str, partitioned: bool = True) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy("shard") if partitioned else writer).parquet(f"{self.files.root}/{self._gen()}/{kind}/n={name}")

    def append(self, ops: DataFrame) -> None:
        """Applies operations (seq, op, key, value), seq being unique in the batch, as one batch: all of it or nothing is there.

        Rejected PUTs and DELETEs of keys that are not live leave no record and use up no number. An operation is
        durable when its batch is.
        """
        keyed = ops.select("seq", "op", "key", "value")
        keys = keyed.where(F.col("op") != "GET").select("key").distinct().withColumn("shard", hashing.shard(F.col("key"), self.shards))
        known = self._entries_of(keys).select("key", "version", (~F.col("tombstone")).alias("live"))
        done = self.segments()
        self._publish(oplog.build(keyed, self.shards, known, self.last_applied()), "log", f"{int(done[-1]) + 1 if done else 1:010d}")

    def _entries_of(self, keys: DataFrame) -> DataFrame:
        """Entries of a batch's keys (key, shard), from what may hold them: their shards' folders, and the files with keys in their range."""
        keys = scratch.written(keys)
        reach = keys.agg(F.min("key"), F.max("key"), F.collect_set("shard")).first()
        if reach[0] is None:
            return self._read("snapshot", [], schemas.STATE)
        own = F.col("key").between(reach[0], reach[1]) & F.col("shard").isin(reach[2])
        some = lambda df: df.where(own).join(keys, ["shard", "key"], "left_semi")
        return state.recover(some(self.snapshot()), self.boundaries(), some(self.log()))

    def append_replicated(self, records: DataFrame) -> None:
        """Applies records (shard is worked out anew, arrival, write_id, version, op, key, value) by the replication rule."""
        high = self.last_applied().withColumnsRenamed({"shard": "_shard", "write_id": "_high"})
        sharded = records.withColumn("shard", hashing.shard(F.col("key"), self.shards))
        sharded = sharded.join(high, F.col("shard") == F.col("_shard"), "left").where(F.col("write_id") > F.coalesce("_high", F.lit(0)))
        fresh = blocked.prior_max(sharded, ["shard"], "arrival", F.col("write_id"), "_before").where(F.col("write_id") > F.coalesce("_before", F.lit(0)))
        done = self.segments()
        self._publish(fresh.withColumn("seq", F.col("arrival")).select(*schemas.OPLOG.names), "log", f"{int(done[-1]) + 1 if done else 1:010d}")

    def catch_up(self, leader: ChangeLog) -> None:
        """Brings this replica up to where a leader of the same layout is: from its snapshot where that is ahead, then from its log."""
        if leader.shards != self.shards:
            raise ValueError("positions of other layouts do not compare")
        at = self.last_applied().withColumnRenamed("write_id", "last_applied")
        self.append_replicated(cluster.shipped(leader.snapshot(), leader.boundaries(), leader.log(), at))

    def take_snapshot(self) -> None:
        """Writes the state of all shards with their boundaries, then drops the segments that it covers."""
        covered, name = self.segments(), f"{int((self._done('snapshot') or ['0'])[-1]) + 1:010d}"
        current, bounds = self.state(), self.last_applied()
        entries = current.groupBy("shard").agg(F.count("*").alias("entry_count"))
        meta = bounds.join(entries, "shard", "left").select(F.lit(self.generation).cast("long").alias("generation"), "shard", F.col("write_id").alias("boundary_write_id"), F.coalesce("entry_count", F.lit(0)).alias("entry_count"))
        self._publish(meta, "meta", name, partitioned=False)
        self._publish(current, "snapshot", name)
        for segment in covered:
            self.files.remove(f"{self._gen()}/log/n={segment}")
        for old in self._done("snapshot")[:-1]:
            self.files.remove(f"{self._gen()}/snapshot/n={old}")
            self.files.remove(f"{self._gen()}/meta/n={old}")

    def stage_rebalance(self, shards: int) -> str:
        """Writes a generation with ``shards`` shards beside the current one; nobody reads it before commit_rebalance().

        It is a copy as of now: the table can be written to meanwhile, and what comes then follows with the commit.
        """
        if shards < 1:
            raise ValueError("a layout has at least one shard")
        self.rebalance_state = "migrating"
        self._staged = (shards, self._published(), scratch.written(self.last_applied().withColumnsRenamed({"shard": "_shard", "write_id": "_at"})))
        new = f"gen_{self.generation + 1}"
        base = f"{self.files.root}/{new}"
        layout.reshard(self.state(), shards).select(*schemas.STATE.names).repartition(max(1, min(shards, 4096)), "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{base}/snapshot/n=0000000001")
        moved = self.spark.read.schema(schemas.STATE).parquet(f"{base}/snapshot/n=0000000001")
        bounds = moved.groupBy("shard").agg(F.max("write_id").alias("boundary_write_id"), F.count("*").alias("entry_count"))
        bounds.select(F.lit(self.generation + 1).cast("long").alias("generation"), "shard", "boundary_write_id", "entry_count").write.mode("overwrite").parquet(f"{base}/meta/n=0000000001")
        return new

    def _published(self) -> list[str]:
        return [*self.segments(), "snapshots", *self._done("snapshot")]

    def _copy_late(self, shards: int, at: DataFrame) -> None:
        """Entries that changed after the positions ``at`` become the first batch of the staged layout's log.

        They are numbered there like any writes, above what was copied; versions, values and tombstones are kept.
        """
        base = f"{self.files.root}/gen_{self.generation + 1}"
        late = self.state().join(at, F.col("shard") == F.col("_shard"), "left").where(F.col("write_id") > F.coalesce("_at", F.lit(0)))
        moved = scratch.written(layout.reshard(merge.entries_to_records(late), shards).withColumn("_rid", F.monotonically_increasing_id()))
        high = self.spark.read.schema(schemas.SNAPSHOT_META).parquet(f"{base}/meta/n=0000000001").select(F.col("shard").alias("_shard"), F.col("boundary_write_id").alias("_high"))
        placed = blocked.prior_sum(moved, ["shard"], "_rid", F.lit(1), "_n").join(high, F.col("shard") == F.col("_shard"), "left")
        placed = placed.withColumn("write_id", F.coalesce("_high", F.lit(0)) + F.col("_n") + 1).withColumn("seq", F.col("write_id"))
        placed.select(*schemas.OPLOG.names).write.mode("overwrite").partitionBy("shard").parquet(f"{base}/log/n=0000000001")

    def commit_rebalance(self, shards: int) -> None:
        """Makes the staged layout the table's, with all that was written since it was staged."""
        if self._staged is None or self._staged[0] != shards:
            raise ValueError("no such layout is staged")
        _, then, at = self._staged
        if self._published() != then:
            self._copy_late(shards, at)
        self._staged = None
        self.rebalance_state = "cutover"
        old = self._gen()
        self.files.replace("MANIFEST", codec.encode_manifest(self.generation + 1, shards))
        self.generation, self.shards = self.generation + 1, shards
        self.files.remove(old)
        self.rebalance_state = "done"

    def rebalance(self, shards: int) -> None:
        """Moves to another number of shards: copy to a new generation, replace the manifest, remove the old one."""
        self.stage_rebalance(shards)
        self.commit_rebalance(shards)
