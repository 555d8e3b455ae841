"""Best-fit packing with Martello-Toth dominance reduction.

Token counts are whole numbers up to the sequence length, so an instance of any number of documents is a histogram
with at most that many entries. The plan is made on the histogram: first the reduction fixes small sets of sizes
that dominate every other way to fill the sequence of their largest member, which shrinks the instance without
losing an optimum; then best fit, sizes falling, packs the rest. Sequences of equal content are planned as one
pattern with a multiplicity, so the work depends on the number of sizes, not of documents. Documents then find
their place by their rank among those of their size.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import gapless_rank, map_in_arrow, stable, text_or_empty

END_ID = 1
#: Rows of the plan that are broadcast, 48 bytes each; a plan has few for each length, whatever the number of documents.
MOST_PLACES = 200_000
#: Words whose ids a worker keeps before it starts anew.
CACHED_WORDS = 120_000


# ---- plan ----


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each with these (size, count), in order."""

    items: tuple[tuple[int, int], ...]
    times: int


class _Histogram:
    """Counts by size, with the present sizes sorted."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, room: int, held: tuple[int, ...] = ()) -> int:
        """Largest size of at most ``room`` that is there besides ``held``; 0 if none."""
        k = bisect_right(self.sizes, room) - 1
        while k >= 0 and self.n[self.sizes[k]] <= held.count(self.sizes[k]):
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def smallest(self, count: int, held: int) -> list[int]:
        """The ``count`` smallest items besides one of size ``held``."""
        out: list[int] = []
        for s in self.sizes:
            there = self.n[s] - (s == held)
            out += [s] * min(there, count - len(out))
            if len(out) == count:
                break
        return out


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some optimal packing has, and the counts that are left.

    For the largest size w with room r beside it, a set is fixed if it dominates all others that hold w:
    - nothing else fits: {w};
    - x fills r exactly, or x is the largest that fits and no two items fit together: {w, x};
    - at most two items fit together, and x is at least as large as the largest sum of two that fits: {w, x};
    - at most two fit, x is the largest that fits, y the largest that fits besides, and no pair that fits has a
      smaller member above y: {w, x, y}.
    Sizes to which no rule applies stay; passes go on until one changes nothing.
    """
    h, fixed = _Histogram(counts), []

    def fix(*sizes: int) -> None:
        times = min(h.n[s] // sizes.count(s) for s in set(sizes))
        for s in set(sizes):
            h.take(s, times * sizes.count(s))
        fixed.append(Pattern(tuple((s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)), times))

    changed = True
    while changed:
        changed, limit = False, capacity
        while (w := h.largest(limit)) > 0:
            room = capacity - w
            x = h.largest(room, (w,))
            least = h.smallest(3, w)
            if not x:
                fix(w)
            elif x == room or len(least) < 2 or sum(least[:2]) > room:
                fix(w, x)
            elif len(least) < 3 or sum(least) > room:
                top, pair = 0, bisect_right(h.sizes, room // 2)
                for q in reversed(h.sizes[:pair]):
                    if h.n[q] - (q == w) > 0 and (p := h.largest(room - q, (w, q))) >= q:
                        top = max(top, p + q)
                        if 2 * q + 1 < top and q + h.sizes[-1] < top:
                            break
                y = h.largest(room - x, (w, x))
                widest = next((q for q in reversed(h.sizes[:pair]) if h.n[q] - (q == w) > 0 and h.largest(room - q, (w, q)) >= q), 0)
                if x >= top:
                    fix(w, x)
                elif y and min(x, y) >= widest:
                    fix(w, x, y)
                else:
                    limit = w - 1
                    continue
            else:
                limit = w - 1
                continue
            changed = True
    return fixed, dict(h.n)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit with sizes falling; sequences of equal room and content are one group."""
    rooms: list[int] = []
    groups: dict[int, list[Pattern]] = {}

    def put(room: int, pattern: Pattern) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append(pattern)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, Pattern(((size, each),), left // each))
                if left % each:
                    put(capacity - left % each * size, Pattern(((size, left % each),), 1))
                break
            room = rooms[k]
            group = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            # the fullest sequence takes copies until no more fit: the next best fit is the same one
            each = min(room // size, left)
            times = min(group.times, left // each)
            put(room - each * size, Pattern((*group.items, (size, each)), times))
            if group.times > times:
                put(room, Pattern(group.items, group.times - times))
            left -= each * times
    return [p for own in groups.values() for p in own]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be from 1 to the capacity")
    fixed, rest = dominance_reduction(counts, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, ranks, count in each sequence, first sequence, offset) for each item of each pattern."""
    out, ranks, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for size, count in p.items:
            first = ranks.get(size, 0)
            out.append((size, first, count * p.times, count, sequence, offset))
            ranks[size] = first + count * p.times
            offset += size * count
        sequence += p.times
    return out


# ---- tokens ----

#: Separators that Python's split() knows and the tokenizer's white space lacks; "<|" begins its special tokens.
_ODD = re.compile("[\x1c-\x1f]")
_BEYOND_LATIN1 = re.compile("[^\x00-\xff]")
#: The tokenizer's own split into words, for lower-case Latin-1: contractions, letters, single digits, runs of other signs.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Words(dict):
    """Ids by word; works out what it lacks. When full, it becomes the old generation, from which words in use come back."""

    def __init__(self, ids) -> None:
        self.ids, self.old = ids, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        found = self[word] = self.old.get(word) or _packed(self.ids(word))
        return found


class WordTokenizer:
    """Ids of whole texts by a byte-level BPE tokenizer that never joins across words, word by word with a cache.

    Texts in Latin-1 are put in lower case and split by the tokenizer's rule first, where Python and the tokenizer
    agree, so that the cache holds less and only the merges are left to the tokenizer. Other texts are split at
    white space alone, and a text with anything that splitting could change is encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # how the tokenizer writes the bytes of a character before merging
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelling = {c: spelt.pre_tokenize_str(chr(c))[0][0] for c in range(0x100)}
        merge = self.tokenizer.model.tokenize
        self.words = _Words(lambda word: [t.id for t in merge(word if word.isascii() and word.isprintable() else word.translate(spelling))])
        self.chunks = _Words(self._whole)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" in text or _ODD.search(text):
            return _packed(self._whole(text))
        if _BEYOND_LATIN1.search(text):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return b"".join(map(self.words.__getitem__, _PARTS.findall(text.lower())))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        end, step = END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_to_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end id, cut after every ``capacity`` ids."""
    return map_in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), _cutter(tokenizer_path, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length`` from 1 to ``capacity``.

    In each sequence offsets begin at 0 and leave no gap. Other columns stay; clashing ones are replaced. Repeated
    rows are packed each; which of the rows of one length gets which place depends on a hash of the row. An empty
    table gives an empty one. The driver sees the histogram of lengths alone, ``capacity`` rows at most.
    """
    pieces = stable(pieces.drop("sequence_id", "offset"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = slots(plan(counts, capacity))
    places = pieces.sparkSession.createDataFrame(found, "_ll_size bigint, _ll_first bigint, _ll_ranks bigint, _ll_count bigint, _ll_sequence bigint, _ll_offset bigint")
    if len(found) <= MOST_PLACES:  # else the most frequent length is left to the engine's own splitting of skewed joins
        places = F.broadcast(places)
    ranked = gapless_rank(pieces.withColumn("_ll_rid", F.monotonically_increasing_id()), "length", F.xxhash64("_ll_rid"), sum(counts.values()), "_ll_rank")
    at = F.col("_ll_rank") - F.col("_ll_first")
    placed = ranked.join(places, (F.col("length") == F.col("_ll_size")) & (at >= 0) & (at < F.col("_ll_ranks")))
    placed = placed.withColumns({"sequence_id": F.col("_ll_sequence") + F.floor(at / F.col("_ll_count")), "offset": F.col("_ll_offset") + at % F.col("_ll_count") * F.col("length")})
    return placed.drop("_ll_rid", "_ll_rank", *places.columns)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096) -> DataFrame:
    """Tokenizes, cuts and packs documents (null or empty text: one end id).

    Texts of any length are encoded whole and cut into pieces of ``capacity`` ids; repeated rows and rows without a
    doc_id are packed each; other columns of docs, whatever they are called, are not looked at; an empty table gives
    an empty one.
    """
    return pack(cut_to_pieces(docs, tokenizer_path, capacity), capacity)
