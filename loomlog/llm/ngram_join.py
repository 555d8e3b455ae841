"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each text has a MinHash signature of its word shingles, cut into the labels of several trees. In a tree, texts are the
leaves of a prefix trie: sorted by label, the texts below a node of any depth are one run. Two texts of similarity s
share a prefix of d values in at least one of l trees with probability 1 - (1 - s^d)^l.

Matched prefixes are shortened adaptively. The first round takes the full depth and verifies the pairs that share a
node on the shingle sets themselves. The similarities of the links found say how many were missed (each link stands
for one over its probability of being found), and how many any shorter prefix would miss. The next round takes the
longest prefix that reaches the target recall, compares only pairs that no node of the round before has had together,
and so on until the estimate, from all links so far, is there. A node of which all texts are below one longer prefix
has nothing new and is left out.

Pairs of nodes of up to ``small`` texts are rows. Larger nodes are cut into blocks, by texts and by characters, and
each two blocks are a unit of work of bounded size: the intersections are counted on bit rows, and only the texts'
numbers of links and a spanning forest leave the unit. So no task holds a large node and no row is written for each
of its pairs; the time still grows with the number of these pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import bitmap_of, map_in_arrow, may_be_in, spread_join, stable, text_or_empty
from loomlog.llm.components import components

TREES, DEPTH = 20, 5
#: Similarities of links are counted in so many steps from the threshold to 1.
STEPS = 16
#: Pairs of nodes of up to this many texts are rows of their own.
SMALL = 24
#: Texts and characters that a block of a larger node is meant to hold.
BLOCK_TEXTS, BLOCK_CHARS = 512, 1 << 20
LINKS = "a binary, b binary, n bigint, steps array<bigint>"
#: Shingles whose bits are held at a time.
BITS = 1 << 15


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    return 1 - (1 - similarity**depth) ** trees


def estimated_recall(links: list[int], threshold: float, found_at: int, depth: int) -> float:
    """Share of all links that prefixes of ``depth`` find, from the numbers of links by step that ``found_at`` has found.

    A step counts as its lower end, and one link at the threshold is added: what few links say is not trusted.
    """
    steps = [threshold + k * (1 - threshold) / STEPS for k in range(STEPS)]
    there = [(n + (k == 0)) / recall(s, found_at) for k, (n, s) in enumerate(zip(links, steps, strict=True))]
    return sum(n * recall(s, depth) for n, s in zip(there, steps, strict=True)) / sum(there)


def next_depth(links: list[int], threshold: float, target: float, depth: int) -> int:
    """The longest prefix below ``depth`` that is expected to reach the target recall; ``depth`` if it does so itself; 1 at least."""
    while depth > 1 and estimated_recall(links, threshold, depth, depth) < target:
        shorter = depth - 1
        while shorter > 1 and estimated_recall(links, threshold, depth, shorter) < target:
            shorter -= 1
        return shorter
    return depth


def shingles(text: str, n: int) -> set[tuple[str, ...]]:
    """Runs of n words (separated by white space); of a shorter text all its words as one; none of a text without words."""
    words = text.split()
    return set(zip(*(islice(words, k, None) for k in range(n)), strict=False)) if len(words) >= n else {tuple(words)} - {()}


def _constants(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


class Signer:
    """MinHash signatures of texts: values of TREES * DEPTH random orders of the shingles."""

    def __init__(self, n: int = 5, seed: int = 0) -> None:
        self.n, self.words = n, {}
        self.a, self.b = _constants(TREES * DEPTH, seed)
        self.mix = _constants(n, seed + 1)[0]

    def _hash(self, word: str) -> int:
        if len(self.words) > 200_000:
            self.words = {}
        found = self.words[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def sign(self, texts: list[str]) -> np.ndarray:
        """(texts, TREES * DEPTH) of uint32; all ones for a text without words."""
        out = np.full((len(texts), TREES * DEPTH), 0xFFFFFFFF, dtype=np.uint32)
        rows, parts, known = [], [], self.words
        for k, text in enumerate(texts):
            words = text.split()
            if words:
                hashed = np.array([known[w] if w in known else self._hash(w) for w in words], dtype=np.uint64)
                m = max(1, len(words) - self.n + 1)
                s = np.zeros(m, dtype=np.uint64)
                for j in range(min(self.n, len(words))):
                    s = (s ^ (s >> np.uint64(29))) * self.mix[j] + hashed[j : j + m]
                rows.append(k)
                parts.append(s ^ (s >> np.uint64(32)))
        if rows:
            flat = np.concatenate(parts)
            starts = np.cumsum([0, *map(len, parts[:-1])])
            for k in range(TREES * DEPTH):
                out[rows, k] = np.minimum.reduceat((flat * self.a[k] + self.b[k]) >> np.uint64(32), starts)
        return out


def _signing(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n, seed)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            start = total = 0
            for k in range(len(texts) + 1):
                if k > start and (k == len(texts) or total > 1 << 18):
                    # big-endian: labels sort as their values do
                    signs = signer.sign(texts[start:k]).astype(">u4")
                    labels = [None if not t or t.isspace() else s.tobytes() for t, s in zip(texts[start:k], signs, strict=True)]
                    chars = pa.array([len(t) for t in texts[start:k]], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, k - start), batch.column(1).slice(start, k - start), pa.array(labels, pa.binary()), chars], names=["doc_id", "t", "labels", "chars"])
                    start, total = k, 0
                if k < len(texts):
                    total += len(texts[k])

    return run


def _label(tree: Column, depth: int = DEPTH) -> Column:
    """The first ``depth`` values of a tree's label."""
    return F.substring("labels", tree * (4 * DEPTH) + 1, F.lit(4 * depth))


def _node_keys(depth: int) -> Column:
    """For each tree a hash of the prefix; an equal hash of other prefixes only adds pairs to verify."""
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda tree: F.xxhash64(tree, _label(tree, depth)))


def _verifying(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, set()
        for batch in batches:
            found = []
            for b, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if b != last:
                    last, sets = b, shingles(text_b, n)
                other = shingles(text_a, n)
                both = len(sets & other)
                found.append(both / (len(sets) + len(other) - both) if both else 0.0)
            found = np.array(found)
            near = found >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in (batch.column(0), batch.column(1))] + [pa.array(found[near])], names=["a", "b", "similarity"])

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _members(texts: DataFrame, depth: int, before: int | None) -> DataFrame:
    """A row for each text in each node of ``depth`` that joins texts which no node of depth ``before`` has had together.

    texts: (t, labels, chars), one row for each different text. ``keys`` are the text's nodes in all trees, ``seen``
    those of the round before (none in the first).
    """
    seen = _node_keys(before) if before else F.array().cast("array<bigint>")
    leaves = texts.where(F.col("labels").isNotNull()).select("t", "labels", "chars", _node_keys(depth).alias("keys"), seen.alias("seen"))
    leaves = leaves.select("t", "chars", "labels", "keys", "seen", F.posexplode("keys").alias("tree", "key"))
    leaves = leaves.withColumn("label", _label(F.col("tree"))).drop("labels")
    child = F.get("seen", F.col("tree"))
    nodes = leaves.groupBy("key").agg(F.count("*").alias("size"), F.sum("chars").alias("chars"), F.min(child).alias("low"), F.max(child).alias("high"))
    nodes = stable(nodes.where((F.col("size") > 1) & (F.col("low").isNull() | (F.col("low") != F.col("high")))).drop("low", "high"))
    return stable(may_be_in(leaves.drop("chars"), bitmap_of(nodes, F.col("key")), F.col("key")).join(nodes, "key"))


def _pairs(members: DataFrame, small: int) -> DataFrame:
    """Pairs (a, b) of text keys of nodes of up to ``small`` texts, but those that an earlier tree or round has in one node too."""
    few = members.where(F.col("size") <= small).groupBy("key").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("label", "t", "keys", "seen"))).alias("ts"))
    few = few.select("tree", F.explode(F.flatten(F.transform("ts", lambda x, i: F.transform(F.slice("ts", i + 2, small), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    meet = lambda x, y: F.exists(F.zip_with(x, y, lambda u, v: u == v), lambda u: u)
    earlier = lambda side: F.slice(f"p.{side}.keys", F.lit(1), F.col("tree"))
    met = meet(earlier("a"), earlier("b")) | meet(F.col("p.a.seen"), F.col("p.b.seen"))
    return few.where(~met).select(F.col("p.a.t").alias("a"), F.col("p.b.t").alias("b"))


def _units(many: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of larger nodes (members of these), once for each unit (key, i, j) of the blocks i and j of a node, in the order of units and labels; rows: (t, text)."""
    needed = many.select("t").distinct()
    hashed = F.xxhash64("t")
    found = may_be_in(rows, bitmap_of(needed, hashed), hashed).groupBy("t").agg(F.first("text").alias("text"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_TEXTS, F.col("chars") / BLOCK_CHARS)).cast("int")
    cut = many.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("t", F.lit(1)), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = cut.join(found, "t").select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tree", "label", "t", "keys", "seen", "text")
    return units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "label", "t")


def _shared(sets: list[set], needed: np.ndarray) -> np.ndarray:
    """Numbers of equal elements of the sets, for each two that are needed."""
    ids, counts = {}, np.zeros(needed.shape, dtype=np.int64)
    cols = np.array([ids.setdefault(x, len(ids)) for s in sets for x in s], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(cols, minlength=len(ids)) > 1  # what only one set has is in no intersection
    kept = often[cols]
    rows, cols = rows[kept], (np.cumsum(often) - 1)[cols[kept]]
    others = [(a, np.flatnonzero(row)) for a, row in enumerate(needed) if row.any()]
    for at in range(0, int(often.sum()), BITS):
        here = (cols >= at) & (cols < at + BITS)
        width = -(-min(BITS, int(often.sum()) - at) // 64) * 64
        bits = np.zeros((len(sets), width), dtype=bool)
        bits[rows[here], cols[here] - at] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        for a, bs in others:
            counts[a, bs] += np.bitwise_count(bits[a] & bits[bs]).sum(axis=1, dtype=np.int64)
    return counts


def _links_of_unit(texts: list[str], keys: np.ndarray, seen: np.ndarray, blocks: np.ndarray, tree: int, n: int, threshold: float) -> np.ndarray:
    """Similarities of the linked texts of a unit as a symmetric matrix, 0 for the others; without the pairs that an earlier
    tree or round has in one node and, where the unit has two blocks, those of one block, which are other units' work."""
    needed = np.triu(np.ones((len(texts), len(texts)), dtype=bool), 1)
    if blocks.min() != blocks.max():
        needed &= blocks[:, None] != blocks[None, :]
    for same in [*keys[:, :tree].T, *seen.T]:
        needed &= same[:, None] != same[None, :]
    alike = np.zeros(needed.shape)
    if not needed.any():
        return alike
    sets = [shingles(t, n) for t in texts]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    # sets of too different sizes can't reach the threshold
    needed &= np.minimum(sizes[:, None], sizes[None, :]) / np.maximum(sizes[:, None], sizes[None, :]) >= threshold
    both = _shared(sets, needed)
    alike = np.where(needed, both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1), 0.0)
    alike[alike < threshold] = 0
    return np.maximum(alike, alike.T)


def _steps(alike: np.ndarray, threshold: float) -> np.ndarray:
    """The step of each similarity."""
    return np.clip(((alike - threshold) / (1 - threshold) * STEPS).astype(np.int64), 0, STEPS - 1) if threshold < 1 else np.zeros(alike.shape, dtype=np.int64)


def _roots(near: np.ndarray) -> np.ndarray:
    """For each text the first one that links lead to."""
    roots = np.full(len(near), -1)
    for k in range(len(near)):
        if roots[k] < 0:
            roots[k], todo = k, [k]
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (roots < 0))
                roots[new] = k
                todo.extend(new)
    return roots


def _linking(n: int, threshold: float):
    def links(unit: tuple, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        seen = table["seen"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        alike = _links_of_unit(table["text"].to_pylist(), keys, seen, table["block"].to_numpy(), table["tree"][0].as_py(), n, threshold)
        near = alike > 0
        degree = near.sum(axis=1)
        some = np.flatnonzero(degree)
        t = table["t"].combine_chunks()
        counts = np.bincount(_steps(alike[np.triu(near)], threshold), minlength=STEPS)
        counts = pa.array([counts.tolist() if k == 0 else None for k in range(len(some))], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([t.take(pa.array(some)), t.take(pa.array(_roots(near)[some])), pa.array(degree[some].astype(np.int64)), counts], names=["a", "b", "n", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            units = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            start = 0
            for k in range(len(units) + 1):
                if k == len(units) or units[k] != last:
                    if k > start:
                        rows.append(batch.slice(start, k - start))
                    if k < len(units):
                        if rows:
                            yield links(last, rows)
                        last, rows, start = units[k], [], k
        if rows:
            yield links(last, rows)

    return run


def _verified(rows: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold; rows: (t, text)."""
    needed = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    hashed = F.xxhash64("t")
    found = may_be_in(rows, bitmap_of(needed, hashed), hashed).groupBy("t").agg(F.first("text").alias("text"))
    found = stable(found.join(needed, "t", "left_semi"))
    one = pairs.join(found.select(F.col("t").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(found.select(F.col("t").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return stable(map_in_arrow(two, _verifying(n, threshold), "a binary, b binary, similarity double"))


def _round(texts: DataFrame, texts_of: DataFrame, depth: int, before: int | None, n: int, threshold: float, small: int) -> tuple[DataFrame, list[int]]:
    """Links (a, b, n) that prefixes of ``depth`` add to those of ``before``, and their number by step of similarity."""
    members = _members(texts, depth, before)
    few = _verified(texts_of, stable(_pairs(members, small)), n, threshold)
    many = members.where(F.col("size") > small)
    if many.isEmpty():
        many = members.sparkSession.createDataFrame([], LINKS)
    else:
        many = stable(map_in_arrow(_units(many, texts_of), _linking(n, threshold), LINKS))
    step = F.least(F.greatest(F.floor((F.col("similarity") - threshold) / max(1 - threshold, 1e-9) * STEPS), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    by_row = few.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    # a unit has all its counts in one of its rows
    by_unit = many.agg(*[F.coalesce(F.sum(F.get("steps", F.lit(k))), F.lit(0)) for k in range(STEPS)]).first()
    by_step = {r["step"]: r["n"] for r in by_row}
    one = F.lit(1).cast("long").alias("n")
    links = few.select("a", "b", one).unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"), one)).unionByName(many.select("a", "b", "n"))
    return links, [by_step.get(k, 0) + by_unit[k] for k in range(STEPS)]


def jaccard_links(docs: DataFrame, n: int = 5, threshold: float = 0.8, target: float = 0.99999, small: int = SMALL, seed: int = 0) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """(signed, links, rounds): signed has (doc_id, t, ...) for each row, t being the key of its text; links (a, b, n): a chain
    of links leads from text a to text b, and n of the links of a are counted here, each in one row of a; rounds:
    each round's depth and the recall that was estimated after it. ``target=1`` shortens prefixes to one value, at
    which a pair of similarity 0.8 is missed with probability 0.2^20."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", text_key(F.col("text")).alias("t"), "text")
    signed = stable(map_in_arrow(rows, _signing(n, seed), "doc_id bigint, t binary, labels binary, chars bigint"))
    texts = signed.groupBy("t").agg(F.first("labels").alias("labels"), F.first("chars").alias("chars"))
    links, counts, rounds, depth, before = None, [0] * STEPS, [], DEPTH, None
    while True:
        new, more = _round(texts, rows.select("t", "text"), depth, before, n, threshold, small)
        links, counts = new if links is None else links.unionByName(new), [a + b for a, b in zip(counts, more, strict=True)]
        rounds.append((depth, estimated_recall(counts, threshold, depth, depth)))
        shorter = next_depth(counts, threshold, target, depth)
        if shorter == depth:
            return signed, links, rounds
        depth, before = shorter, depth


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, target: float = 0.99999, small: int = SMALL, seed: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, copies, t.

    Documents are in one class if verified links of at least ``threshold`` (Jaccard similarity of their sets of
    ``n``-word shingles) lead from one to the other; ``class_id`` is the smallest doc_id in it. ``n_links`` counts
    the different texts with a verified link to this one, all that share a node of the forest with it, ``copies`` the
    rows with exactly this text. A text of fewer than n words is one shingle; a null text is an empty one, which has no
    shingle and only joins its copies. Texts of any length are signed and verified whole. A null doc_id counts only
    where a class has no other. Repeated rows are copies and get a row each; pairs at the threshold itself are links;
    other columns of docs, whatever they are called, are not looked at; an empty table gives an empty one. The seed
    fixes the signatures, so reruns agree.
    """
    signed, links, _ = jaccard_links(docs, n, threshold, target, small, seed)
    degree = links.groupBy(F.col("a").alias("t")).agg(F.sum("n").alias("n_links"))
    roots = components(links)
    texts = signed.groupBy("t").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    texts = texts.join(degree, "t", "left").join(roots.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    texts = stable(texts)
    least = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    texts = stable(texts.join(least, "root").select("t", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies"))
    return spread_join(signed.select("doc_id", "t"), texts, "t", "copies").select("doc_id", "class_id", "n_links", "copies", "t")


#: DuckDB's version of op3: all pairs that share a shingle, and reachability over the links.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
t AS (SELECT txt, row_number() OVER (ORDER BY txt) AS id, list_filter(string_split_regex(txt, '\s+'), lambda x: x <> '') AS ws FROM (SELECT DISTINCT txt FROM d)),
sh AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM t),
n AS (SELECT id, count(*) AS k FROM sh GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
near AS (SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.k + y.k - c) >= 0.8),
ends AS (SELECT a AS x, b AS y FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT id, id AS other FROM t UNION SELECT r.id, e.y FROM reach r JOIN ends e ON r.other = e.x),
owns AS (SELECT t.id, min(doc_id) AS doc, count(*) AS copies FROM t JOIN d ON t.txt = d.txt GROUP BY t.id),
class AS (SELECT r.id, min(l.doc) AS class_id FROM reach r JOIN owns l ON r.other = l.id GROUP BY r.id),
degree AS (SELECT x AS id, count(*) AS n_links FROM ends GROUP BY x)
SELECT d.doc_id, c.class_id, coalesce(g.n_links, 0) AS n_links, l.copies
FROM d JOIN t ON t.txt = d.txt JOIN class c ON c.id = t.id JOIN owns l ON l.id = t.id LEFT JOIN degree g ON g.id = t.id
"""
