"""Exact dedup: a cuckoo-filter index of live digests.

The index has buckets of four slots. A slot holds the 16-bit fingerprint of a live digest, and beside it the digest's
entry; a digest lives in one of two buckets, so it can be taken out again, which a Bloom filter can't do. A miss needs
fingerprints alone. A hit is only likely, so it is verified against the content of the slot that hit: the full
256-bit digest. When an insertion finds no place after a bounded chain of evictions, the index doubles and the stored
entries are placed anew.

At scale each task keeps a small index as a combiner, so that a group of copies of any size is one entry for each
task when it is shuffled; entries then meet in index partitions by the first bits of their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import bitmap_of, buckets_for, map_in_arrow, may_be_in, spread_join, stable

SLOTS = 4
MAX_EVICTIONS = 200
#: Live digests that a combiner holds before it passes them on and starts anew.
COMBINER_KEYS = 100_000
#: Digests that one index partition is meant to hold.
PARTITION_KEYS = 200_000


class CuckooIndex:
    """Live digests with an entry [digest, largest id, count] each: insert, find, remove.

    Digests are byte strings of at least 16 bytes whose bits are evenly spread.
    """

    def __init__(self, capacity: int = 1024) -> None:
        self.resizes = self.false_hits = self.size = 0
        self._make(max(2, 1 << (int(capacity / (SLOTS * 0.9)) - 1).bit_length()))

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = [0] * (buckets * SLOTS)  # 0: the slot is free
        self.content: list[list | None] = [None] * (buckets * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _slot(self, digest: bytes) -> int:
        """The slot that holds the digest, or -1."""
        mark, a, b = self._places(digest)
        for bucket in (a, b) if a != b else (a,):
            at = bucket * SLOTS
            if mark in self.marks[at : at + SLOTS]:
                for slot in range(at, at + SLOTS):
                    if self.marks[slot] == mark:
                        if self.content[slot][0] == digest:
                            return slot
                        self.false_hits += 1
        return -1

    def find(self, digest: bytes) -> list | None:
        """The live entry, or None."""
        slot = self._slot(digest)
        return None if slot < 0 else self.content[slot]

    def insert(self, digest: bytes, largest: int | None, count: int = 1) -> bool:
        """Adds count copies; True if the digest was not live before."""
        entry = self.find(digest)
        if entry is not None:
            if largest is not None and (entry[1] is None or largest > entry[1]):
                entry[1] = largest
            entry[2] += count
            return False
        self.size += 1
        homeless = self._place([digest, largest, count])
        if homeless is not None:
            self._grow(homeless)
        return True

    def remove(self, digest: bytes, count: int = 1) -> bool:
        """Takes count copies away; the digest stops being live with the last. False if it was not live.

        The largest id of a digest that stays live is no longer known if it was that of a copy taken away.
        """
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.content[slot][2] -= count
        if self.content[slot][2] <= 0:
            self.marks[slot], self.content[slot] = 0, None
            self.size -= 1
        return True

    def _free(self, bucket: int) -> int:
        at = bucket * SLOTS
        return at + self.marks[at : at + SLOTS].index(0) if 0 in self.marks[at : at + SLOTS] else -1

    def _place(self, entry: list) -> list | None:
        """Puts an entry into one of its buckets, moving others on; returns the one that is left without a place, if any."""
        mark, a, b = self._places(entry[0])
        bucket = a if self._free(a) >= 0 else b
        for k in range(MAX_EVICTIONS):
            slot = self._free(bucket)
            if slot >= 0:
                self.marks[slot], self.content[slot] = mark, entry
                return None
            slot = bucket * SLOTS + (mark + k) % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.content[slot], entry = entry, self.content[slot]
            bucket = self._other(bucket, mark)
        return entry

    def _grow(self, homeless: list) -> None:
        """Doubles until every stored entry has a place."""
        stored = [*self.entries(), homeless]
        while True:
            self.resizes += 1
            self._make((self.mask + 1) * 2)
            if all(self._place(entry) is None for entry in stored):
                return

    def entries(self) -> Iterator[list]:
        return (entry for entry in self.content if entry is not None)


ENTRY = pa.schema([("digest", pa.binary()), ("largest", pa.int64()), ("n", pa.int64())])


def _batch(index: CuckooIndex) -> pa.RecordBatch:
    found = list(index.entries())
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*found, strict=True), ENTRY, strict=True)], schema=ENTRY)


def normalised_digest(text: bytes) -> bytes:
    """SHA-256 of the text with A-Z (and no other letters) in lower case."""
    return hashlib.sha256(text.lower()).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array([normalised_digest(t) for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), digests], names=["doc_id", "digest"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            index.insert(digest, doc_id)
        if index.size >= COMBINER_KEYS:
            yield _batch(index)
            index = CuckooIndex()
    if index.size:
        yield _batch(index)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part, one part's index is held at a time; a negative count is a deletion and comes last in its part."""
    index, part = CuckooIndex(), None
    for batch in batches:
        for p, digest, largest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if index.size:
                    yield _batch(index)
                index, part = CuckooIndex(), p
            if n < 0:
                index.remove(digest, -n)
            else:
                index.insert(digest, largest, n)
    if index.size:
        yield _batch(index)


def _in_parts(entries: DataFrame, rows: int) -> DataFrame:
    """The index of (digest, largest, n), by parts that ``rows`` digests at most are dealt over."""
    part = F.pmod(F.xxhash64("digest"), F.lit(buckets_for(rows, PARTITION_KEYS))).cast("int")
    # the first byte lets more tasks than parts share the work; equal digests always meet in one
    keyed = entries.select(part.alias("part"), "digest", "largest", "n").repartition("part", F.substring("digest", 1, 1))
    return map_in_arrow(keyed.sortWithinPartitions("part", F.col("n") < 0), _merge, "digest binary, largest bigint, n bigint")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row, written once: texts are read and hashed here and nowhere else."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return stable(map_in_arrow(rows, _digests, "doc_id bigint, digest binary"))


def live_digests(rows: DataFrame) -> DataFrame:
    """The index of (doc_id, digest): (digest, largest, n), one row for each different digest."""
    return stable(_in_parts(map_in_arrow(rows.select("doc_id", "digest"), _combine, "digest binary, largest bigint, n bigint"), rows.count()))


def without(index: DataFrame, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The index of ``rows`` after ``gone`` is taken out of it; both are (doc_id, digest), and rows of gone that were never in rows change nothing.

    Counts fall and digests without copies go. Where the copy with the largest id went, the largest one that is left
    is looked up among the rows of these digests alone. Each row of ``gone`` takes one equal row away.
    """
    there = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("_there"))
    fewer = gone.groupBy("doc_id", "digest").agg(F.count("*").alias("_gone")).withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    same = there["doc_id"].eqNullSafe(fewer["_doc"]) & (there["digest"] == fewer["_digest"])
    taken = stable(there.join(fewer, same).select("doc_id", "digest", F.least("_there", "_gone").alias("n"), (F.col("_gone") >= F.col("_there")).alias("all")))
    deletions = taken.groupBy("digest").agg(F.max(F.when(F.col("all"), F.col("doc_id"))).alias("largest"), (-F.sum("n")).alias("n"))
    left = stable(_in_parts(index.select("digest", "largest", "n").unionByName(deletions), index.count()))
    known = deletions.select(F.col("digest").alias("_digest"), F.col("largest").alias("_lost"))
    lost = stable(left.join(known, left["digest"] == F.col("_digest")).where(F.col("largest").eqNullSafe(F.col("_lost"))).select("digest"))
    rest = may_be_in(rows, bitmap_of(lost, F.xxhash64("digest")), F.xxhash64("digest")).join(lost, "digest", "left_semi")
    out = taken.where("all").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
    rest = rest.join(out, rest["doc_id"].eqNullSafe(F.col("_doc")) & (rest["digest"] == F.col("_digest")), "left_anti")
    again = rest.groupBy("digest").agg(F.max("doc_id").alias("_largest"), F.lit(True).alias("_again"))
    return left.join(again, "digest", "left").select("digest", F.when(F.col("_again"), F.col("_largest")).otherwise(F.col("largest")).alias("largest"), "n")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256 (hex).

    Texts are equal when they are identical after lower-casing A-Z; a null text is an empty one. Of equal texts the
    row with the largest doc_id stays (``kept``); a null doc_id is below all others. Rows that repeat the keeper's
    doc_id and text are all marked as kept, as they can't be told apart. Texts of any length are hashed whole; other
    columns, whatever they are called, are not looked at; an empty table gives an empty one.
    """
    rows = digests(docs)
    joined = spread_join(rows, live_digests(rows), "digest", "n")
    return joined.select("doc_id", F.col("largest").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("largest")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: DuckDB's version of op7, by a window over the normalised texts themselves.
SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
