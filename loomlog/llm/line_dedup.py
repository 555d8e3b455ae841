"""Line dedup [native]: exact and near copies of lines, by a deletion-neighbourhood join.

Two lines are near when one edit (a character replaced, added or taken away) turns one into the other. Each line
emits the variants that an edit can lead to, as hashes; equal variants are joined, the edit distance is verified on
the lines themselves, and the earliest line stays.

Variants of all lines would be as many as the corpus has characters. But lines of m and m or m + 1 characters that
are one edit apart share either the first m // 2 characters or the last m - m // 2. So each line is first hashed by
these halves, four keys in all, and only lines that share a half emit variants: of the other half alone, joined
within the shared one. That loses no pair.

A half is cut into pieces of about the square root of its length. The hash of a variant is made of a running hash of
the pieces before, one of the pieces after, and the one piece that lacks a character, so all variants of a line of m
characters take time m ** 1.5, not its square: a line of a million characters is no more than a thousand short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import bitmap_of, may_be_in, stable

#: By default shorter lines count as copies only when they are equal: one edit is too large a part of them ("1." and "2.").
MIN_CHARS = 20


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: doc_id, _key (of the row's text), pos, line, h1, h2."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_ll_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.trim("line") != "").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def _half_keys(line: Column, n: Column) -> Column:
    """For lengths m = n and n - 1: hashes of the first m // 2 and of the last m - m // 2 characters, with m."""
    keys = []
    for m in (n, n - 1):
        first = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("P"), m, F.substring(line, F.lit(1), first)))
        keys.append(F.xxhash64(F.lit("S"), m, F.substring(line, n - (m - first) + 1, m - first)))
    return F.array(*keys)


def _classes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each different line: h1, h2, n, keys, first (doc_id, pos), copies."""
    n = F.char_length("line")
    rows = _lines(docs).select("doc_id", "pos", "h1", "h2", n.alias("n"), F.when(n >= min_chars, _half_keys(F.col("line"), n)).alias("keys"))
    return rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def _sharing_a_half(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Different lines that share a half with another: a row for each shared key, with the line."""
    keyed = classes.where(F.col("keys").isNotNull()).select("h1", "h2", "n", "first", F.posexplode("keys").alias("place", "key"))
    shared = stable(keyed.groupBy("key").agg(F.count("*").alias("lines")).where(F.col("lines") > 1).select("key"))
    flagged = stable(may_be_in(keyed, bitmap_of(shared, F.col("key")), F.col("key")).join(shared, "key", "left_semi"))
    occurrence = F.xxhash64("h1", "doc_id", "pos")
    bits = bitmap_of(flagged.select("h1", "first.*"), occurrence)
    texts = may_be_in(_lines(docs), bits, occurrence).select("h1", "h2", "doc_id", "pos", "line")
    same = (flagged["h1"] == texts["h1"]) & (flagged["h2"] == texts["h2"]) & flagged["first.doc_id"].eqNullSafe(texts["doc_id"]) & (flagged["first.pos"] == texts["pos"])
    found = flagged.join(texts, same).select(flagged["h1"], flagged["h2"], "n", "first", "place", "key", "line")
    return stable(found.dropDuplicates(["h1", "h2", "place"]))


def _pieces(text: Column, size: Column) -> Column:
    return F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size, F.lit("}")), F.lit(0))


def _running(pieces: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... pieces."""
    return F.aggregate(pieces, F.array(F.lit(0).cast("long")), lambda done, piece: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), piece))))


def _framed(pieces: Column, heads: Column, tails: Column) -> Column:
    """Each piece with the running hash of those before it and, from the other end, of those after it."""
    n = F.size(pieces)
    return F.arrays_zip(pieces.alias("piece"), F.slice(heads, F.lit(1), n).alias("head"), F.reverse(F.slice(tails, F.lit(1), n)).alias("tail"))


def _near_pairs(sharing: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of (h1, h2, first) with an equal variant, and how: without the character ``at`` both are equal, or, if b is ``longer``, b is a."""
    m = F.col("n") - F.floor(F.col("place") / 2).cast("int")
    first = F.floor(m / 2).cast("int")
    is_head = F.col("place") % 2 == 0
    # the half that may differ: what follows the shared head, or what comes before the shared tail
    rest = F.when(is_head, F.substring("line", first + 1, F.col("n"))).otherwise(F.substring("line", F.lit(1), F.col("n") - (m - first)))
    size = F.pow(F.lit(2), F.greatest(F.lit(6), F.ceil(F.log2(F.greatest(m, F.lit(1))) / 2))).cast("int")
    rows = sharing.select(F.struct("first", "h1", "h2").alias("id"), "key", (F.col("place") >= 2).alias("longer"), rest.alias("rest"), F.when(is_head, first).otherwise(0).alias("before"), size.alias("width"))
    cut = rows.withColumn("pieces", _pieces(F.col("rest"), F.col("width"))).withColumns({"heads": _running(F.col("pieces")), "tails": _running(F.reverse("pieces"))})
    each = cut.select("id", "key", "longer", "before", "width", F.posexplode(_framed(F.col("pieces"), F.col("heads"), F.col("tails"))).alias("q", "f")).select("id", "key", "longer", (F.col("before") + F.col("q") * F.col("width")).alias("before"), "f.*")
    without = lambda i: F.concat(F.substring("piece", F.lit(1), i - 1), F.substring("piece", i + 1, F.char_length("piece")))
    # a replaced character: both lines without the one at the same place are equal; an added one: the longer without it is the other
    place = lambda i: F.when(F.col("longer"), 0).otherwise(F.col("before") + i)
    variants = F.transform(F.sequence(F.lit(1), F.char_length("piece")), lambda i: F.xxhash64("key", "head", without(i), "tail", place(i)))
    emitted = each.select("id", "longer", "before", F.posexplode(variants).alias("k", "variant")).select("id", "longer", "variant", (F.col("before") + F.col("k") + 1).alias("at"))
    replaced = emitted.where(~F.col("longer")).select("id", "variant", "at")
    leads = replaced.groupBy("variant").agg(F.min("id").alias("lead"), F.count("*").alias("lines")).where(F.col("lines") > 1)
    added = emitted.where(F.col("longer")).select(F.col("id").alias("b"), "variant", "at")
    # the shorter line as the longer one's variant in each piece: after that piece its characters are one place further on
    moved = cut.where(~F.col("longer")).withColumn("moved", _pieces(F.concat(F.lit("-"), F.col("rest")), F.col("width"))).withColumn("after", _running(F.reverse("moved")))
    whole = moved.select(F.col("id").alias("a"), "key", F.explode(_framed(F.col("moved"), F.col("heads"), F.col("after"))).alias("f")).select("a", "key", "f.*")
    whole = whole.select("a", F.xxhash64("key", "head", F.substring("piece", F.lit(2), F.char_length("piece")), "tail", F.lit(0)).alias("variant"))
    pairs = replaced.join(leads, "variant").where(F.col("id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("id").alias("b"), "at", F.lit(False).alias("longer"))
    return pairs.unionByName(whole.join(added, "variant").select("a", "b", "at", F.lit(True).alias("longer"))).distinct()


def _near_copies(sharing: DataFrame) -> DataFrame:
    """Lines (h1, h2, first) that an earlier line is within one edit of."""
    pairs = _near_pairs(sharing)
    texts = sharing.dropDuplicates(["h1", "h2"]).select("h1", "h2", "line")
    for side in ("a", "b"):
        one = texts.select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("line").alias(f"{side}_line"))
        pairs = pairs.join(one, (F.col(f"{side}.h1") == F.col(f"{side}1")) & (F.col(f"{side}.h2") == F.col(f"{side}2"))).drop(f"{side}1", f"{side}2")
    # one edit apart, shown on the lines themselves in time linear in their length
    without = lambda line: F.concat(F.substring(line, F.lit(1), F.col("at") - 1), F.substring(line, F.col("at") + 1, F.char_length(line)))
    near = pairs.where(F.when(F.col("longer"), F.col("a_line") == without("b_line")).otherwise(without("a_line") == without("b_line")))
    later = near.select(F.when(F.col("a.first") < F.col("b.first"), F.col("b")).when(F.col("b.first") < F.col("a.first"), F.col("a")).alias("id"))
    return later.where(F.col("id").isNotNull()).select("id.*").select("h1", "h2", "first").dropDuplicates(["h1", "h2"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with copies of lines taken out of ``text``, and n_lines (not blank) and n_dropped.

    Lines come in the order of (doc_id, place in the text). A line goes if an earlier one is equal to it, or is
    within one edit and both have ``min_chars`` characters at least (0: all lines are compared); whether the earlier
    one itself stays does not matter. Blank lines stay. A null text stays null and an empty one empty, with 0 lines. Rows that repeat a
    doc_id and text are treated alike, and different texts with the same doc_id share their places: the same line
    at the same place of them is no copy. A null doc_id comes first. Other columns stay, clashing ones are replaced;
    an empty table gives an empty one. Texts and lines may be of any length: those that share a half with another
    cost the power 1.5 of their length, the others are linear.
    """
    docs = docs.drop("n_lines", "n_dropped")
    classes = stable(_classes(docs, min_chars))
    near = stable(_near_copies(_sharing_a_half(docs, classes)))
    again = classes.where(F.col("copies") > 1).select("h1", "h2", "first", F.lit(False).alias("near")).join(near, ["h1", "h2"], "left_anti")
    marked = stable(again.unionByName(near.select("h1", "h2", "first", F.lit(True).alias("near"))))
    copies = may_be_in(_lines(docs), bitmap_of(marked, F.col("h1")), F.col("h1")).select("doc_id", "_ll_key", "pos", "h1", "h2")
    copies = copies.join(marked, ["h1", "h2"]).where(F.col("near") | ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    gone = copies.groupBy("doc_id", "_ll_key").agg(F.collect_set("pos").alias("_ll_gone")).select(F.col("doc_id").alias("_ll_doc"), F.col("_ll_key").alias("_ll_k"), "_ll_gone")
    keyed = docs.withColumn("_ll_key", F.xxhash64("doc_id", "text"))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_ll_doc"]) & (keyed["_ll_key"] == gone["_ll_k"]), "left")
    # its own column: inside the functions below it would be split again for each line
    joined = joined.withColumn("_ll_parts", F.split("text", "\n", -1))
    parts = F.col("_ll_parts")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_ll_gone"))
    shorter = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    joined = joined.withColumns({
        "n_lines": F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("_ll_gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("_ll_gone").isNull(), F.col("text")).otherwise(shorter),
    })
    return joined.drop("_ll_key", "_ll_doc", "_ll_k", "_ll_gone", "_ll_parts")


#: DuckDB's version of what op6 returns: candidates by shared halves, verified by edit distance.
SQL = f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, i - 1 AS pos, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs) WHERE trim(parts[i]) <> ''),
firsts AS (SELECT line, min(row(doc_id, pos)) AS f, length(line) AS n FROM lines GROUP BY line),
keys AS (
  SELECT line, f, n, m, 'P' AS kind, left(line, m // 2) AS half FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts WHERE n >= {MIN_CHARS})
  UNION ALL
  SELECT line, f, n, m, 'S', right(line, m - m // 2) FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts WHERE n >= {MIN_CHARS})),
near AS (SELECT DISTINCT b.line FROM keys a JOIN keys b ON a.kind = b.kind AND a.m = b.m AND a.half = b.half AND a.f < b.f WHERE levenshtein(a.line, b.line) <= 1),
marked AS (
  SELECT l.doc_id, l.pos, (n.line IS NOT NULL OR row(l.doc_id, l.pos) <> f.f) AS gone
  FROM lines l JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line),
gone AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, list(pos) FILTER (gone) AS places FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  CASE WHEN coalesce(n_dropped, 0) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(len(parts)), lambda i: NOT list_contains(places, i)), lambda i: parts[i + 1]), chr(10)) END AS text
FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
