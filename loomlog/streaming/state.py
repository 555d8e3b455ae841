"""Structured Streaming: state kept up from a stream of operations, and a replica fed from a stream of records."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomlog import schemas
from loomlog.operators import oplog
from loomlog.sources.table import ChangeLog

# the process that asks a stateful processor for its state schema is not sent this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRY = "value string, version bigint, seq bigint, tombstone boolean"
CHANGES = "key string, value string, version bigint, seq bigint, tombstone boolean"


class EntryProcessor(StatefulProcessor):
    """One entry for each key: applies valid mutations in the order of seq and emits the key's entry after each trigger.

    A trigger's rows are sorted; across triggers they must come in that order for each key, as files do. Older ones
    are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, version, last, tombstone = self._entry.get() if self._entry.exists() else (None, 0, -1, True)
        # of a key with many rows in one trigger nine bytes of each are held, and the newest value
        seqs, puts, newest = [], [], (last, value)
        for batch in rows:
            seq, put = batch["seq"].to_numpy(dtype=np.int64), (batch["op"] == "PUT").to_numpy()
            seqs.append(seq)
            puts.append(put)
            if put.any():
                k = int(np.argmax(np.where(put, seq, -1)))
                if seq[k] > newest[0]:
                    newest = (int(seq[k]), batch["value"].iloc[k])
        seq, put = np.concatenate(seqs), np.concatenate(puts)
        order = np.argsort(seq[seq > last])
        seq, put = seq[seq > last][order], put[seq > last][order]
        # a DELETE finds something exactly if the mutation before it was a PUT
        effective = put | np.concatenate([[not tombstone], put[:-1]]).astype(bool)[: len(put)]
        if effective.any():
            seq, put = seq[effective], put[effective]
            version, last, tombstone = version + len(seq), int(seq[-1]), not put[-1]
            value = None if tombstone else ("" if newest[1] is None else newest[1])
            self._entry.update((value, version, last, bool(tombstone)))
            yield pd.DataFrame({"key": [key[0]], "value": [value], "version": [version], "seq": [last], "tombstone": [bool(tombstone)]})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """State of this size belongs in RocksDB; transformWithState asks for it. A query keeps what is set when it starts."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.getAll.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def entry_changes(ops: DataFrame) -> DataFrame:
    """A stream of operations -> a stream of entries, one for each key that a trigger changed."""
    mutations = oplog.valid(ops).where(F.col("op") != "GET").select("key", "seq", "op", "value")
    return mutations.groupBy("key").transformWithStateInPandas(statefulProcessor=EntryProcessor(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what a stream has now to Parquet; run again with the same checkpoint, it goes on where it was."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(changes: DataFrame) -> DataFrame:
    """The last entry of each key among emitted changes."""
    e = F.max_by(F.struct("value", "version", "seq", "tombstone"), "version").alias("e")
    return changes.groupBy("key").agg(e).select("key", "e.*")


def write_entries(ops: DataFrame, path: str, checkpoint: str) -> None:
    def save(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb(ops.sparkSession):
        query = entry_changes(ops).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
        query.awaitTermination()


def _applied_to(records: DataFrame, table: ChangeLog, checkpoint: str) -> DataStreamWriter:
    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.append_replicated(batch)

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def follow(records: DataFrame, table: ChangeLog, checkpoint: str) -> None:
    """Feeds a replica from a stream of (arrival, write_id, version, op, key, value), as far as there are records now.

    At least once is enough: a record that comes again is at or below the shard's highest write_id and is dropped.
    """
    _applied_to(records, table, checkpoint).trigger(availableNow=True).start().awaitTermination()


def tail(records: DataFrame, table: ChangeLog, checkpoint: str, every: str = "20 milliseconds") -> StreamingQuery:
    """Like :func:`follow`, but goes on until the query that it returns is stopped, looking for new records at each interval.

    A follower that is behind the leader's snapshot catches up first: ``table.catch_up(leader)``; what it then gets
    a second time is dropped. With the same checkpoint, ``tail`` goes on where it or ``follow`` was stopped.
    """
    return _applied_to(records, table, checkpoint).trigger(processingTime=every).start()


def ops_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Operations from a folder of Parquet files, as they come."""
    return spark.readStream.schema(schemas.OPS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
