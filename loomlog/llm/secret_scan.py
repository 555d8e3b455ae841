"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in every text. A candidate's value is hashed, and over the whole corpus each hash gets the
number of different repositories and owners that hold it. Values that many owners or many repositories hold are copied
examples, whoever copies them: one owner may paste an example into thousands of repositories. A value below both
bounds that also looks random is a credential that may be live. Those spans are reported once more, as kind ``live``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import map_in_arrow, spread_join, stable, text_or_empty

_word = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
#: Kinds in the order in which spans of the same start are listed, and the least length of group "value".
KINDS = ("assign", "access", "hex", "live")
#: By default a value in more repositories than this is a copied example, even of one owner.
MOST_REPOSITORIES = 10
LEAST = {"assign": 8, "access": 16, "hex": 32}
PATTERNS = {
    "assign": re.compile("(?:" + "|".join(map(_word, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"(?P<value>AKIA[A-Z0-9]+)"),
    "hex": re.compile(r"(?P<value>[0-9a-f]+)"),
}
#: Same matches as the pattern above leaves after the length test: a run is matched whole, and no part of a short run is long.
_FAST = {"access": re.compile(r"(?P<value>AKIA[A-Z0-9]{12,})"), "hex": re.compile(r"(?P<value>[0-9a-f]{32,})")}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the leftmost non-overlapping matches of each kind, by start, then kind."""
    found = []
    for order, kind in enumerate(KINDS[:3]):
        for m in _FAST.get(kind, PATTERNS[kind]).finditer(text):
            value = m["value"]
            if len(value) >= LEAST[kind]:
                found.append((m.start(), order, m.end(), kind, value))
    return [(s, e, kind, value) for s, _, e, kind, value in sorted(found)]


def entropy(value: str) -> float:
    """Bits for each character, by the value's own character frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value_hash", pa.string()), ("random", pa.bool_())])
_SCHEMA = "array<struct<kind:string,start:int,stop:int,value_hash:string,random:boolean>>"


def _scanner(least_entropy: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                spans = base_spans(text)
                digests.append(hashlib.sha256(joined_spans([(k, s, e) for s, e, k, _ in spans]).encode()).hexdigest())
                found.append([{"kind": k, "start": s, "stop": e, "value_hash": hashlib.sha256(v.encode()).hexdigest()[:32], "random": entropy(v) >= least_entropy} for s, e, k, v in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_CANDIDATE)), pa.array(digests, pa.string())], names=[*batch.schema.names[:-1], "candidates", "base_sha256"])

    return scan


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", most_owners: int = 1, most_repositories: int = MOST_REPOSITORIES, least_entropy: float = 3.0) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_live, n_copied, repositories, owners, base_sha256, spans, candidates.

    ``candidates`` has kind, start, stop (code points), the value's hash, whether it looks random, and how many
    repositories and owners hold it. A value of more than ``most_owners`` owners or ``most_repositories`` repositories
    is copied (``n_copied`` counts those); one that is not and looks random (``least_entropy`` bits a character) is
    ``live``. ``repositories`` and ``owners``: those of the row's most widely held value, 0 without values. A null text
    is empty and has no spans, texts of any length are scanned whole; null owners are one owner of their own, null
    repositories one repository; repeated rows get a row each, but are one repository; other columns, whatever they are
    called, are not looked at; an empty table gives an empty one. Only candidates, never texts, are written to the
    checkpoint folder and shuffled; counts are combined before the shuffle, and widely held values dealt out in the join.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(repository).cast("string"), F.lit("\0")).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"), text_or_empty().alias("text"))
    scanned = map_in_arrow(rows, _scanner(least_entropy), f"doc_id bigint, repository string, owner string, candidates {_SCHEMA}, base_sha256 string")
    scanned = stable(scanned).withColumn("_rid", F.monotonically_increasing_id())
    each = stable(scanned.select("_rid", "repository", "owner", F.explode("candidates").alias("c")).select("_rid", "repository", "owner", "c.*"))
    # distinct pairs first: a value that a third of all documents hold is combined in the map tasks
    owners = each.select("value_hash", "owner").distinct().groupBy("value_hash").agg(F.count("*").alias("owners"))
    repositories = each.select("value_hash", "repository").distinct().groupBy("value_hash").agg(F.count("*").alias("repositories"))
    rows_of = each.groupBy("value_hash").agg(F.count("*").alias("_held"))
    held = stable(owners.join(repositories, "value_hash").join(rows_of, "value_hash"))
    copied = (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)
    known = spread_join(each, held, "value_hash", "_held").withColumn("copied", copied).withColumn("live", F.col("random") & ~F.col("copied"))
    known = known.groupBy("_rid").agg(F.collect_list(F.struct("start", "kind", "stop", "value_hash", "random", "repositories", "owners", "copied", "live")).alias("candidates"))
    out = scanned.select("_rid", "doc_id", "base_sha256").join(known, "_rid", "left")
    got = F.coalesce(F.col("candidates"), F.array().cast(known.schema["candidates"].dataType))
    out = out.withColumn("candidates", F.array_sort(got))
    listed = lambda flag, kind: F.transform(F.filter("candidates", flag), lambda c: F.struct(c["start"].alias("start"), _rank(kind(c)).alias("rank"), F.concat_ws(":", kind(c), c["start"], c["stop"]).alias("says")))
    spans = F.array_sort(F.concat(listed(lambda c: F.lit(True), lambda c: c["kind"]), listed(lambda c: c["live"], lambda c: F.lit("live"))))
    count = lambda kind: F.size(F.filter("candidates", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    widest = lambda name: F.coalesce(F.array_max(F.transform("candidates", lambda c: c[name])), F.lit(0)).cast("long").alias(name)
    return out.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.size(F.filter("candidates", lambda c: c["live"])).cast("long").alias("n_live"),
        F.size(F.filter("candidates", lambda c: c["copied"])).cast("long").alias("n_copied"),
        widest("repositories"), widest("owners"),
        "base_sha256", F.array_join(F.transform(spans, lambda x: x["says"]), ",").alias("spans"), "candidates",
    )


def _rank(kind):
    out = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        out = F.when(kind == name, k).otherwise(out)
    return out

_ASSIGN = "(?:" + "|".join(map(_word, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: DuckDB's version of op8: a match begins after all gaps and matches before it.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT rid, 'assign' AS kind, 0 AS rank, 8 AS shortest, regexp_extract_all(t, '{_ASSIGN}') AS ms, regexp_extract_all(t, '{_ASSIGN}', 1) AS vs, string_split_regex(t, '{_ASSIGN}') AS gaps FROM d
  UNION ALL SELECT rid, 'access', 1, 16, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 'hex', 2, 32, regexp_extract_all(t, '[0-9a-f]{{32,}}'), regexp_extract_all(t, '[0-9a-f]{{32,}}'), string_split_regex(t, '[0-9a-f]{{32,}}') FROM d),
c AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0),
p AS (
  SELECT rid, kind, rank, shortest, ms[i] AS m, vs[i] AS v,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM c),
ok AS (SELECT rid, kind, rank, v, start, start + length(m) AS stop FROM p WHERE length(v) >= shortest),
held AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT coalesce(doc_id::VARCHAR, chr(0))) AS repositories FROM ok JOIN d ON ok.rid = d.rid GROUP BY v),
judged AS (SELECT ok.*, owners, repositories, owners > 1 OR repositories > {MOST_REPOSITORIES} AS copied FROM ok JOIN held ON ok.v = held.v),
e AS (SELECT *, NOT copied AND list_aggregate(string_split(v, ''), 'entropy') >= 3 AS live FROM judged),
every AS (SELECT rid, start, rank, kind || ':' || start || ':' || stop AS says FROM e UNION ALL SELECT rid, start, 3, 'live:' || start || ':' || stop FROM e WHERE live),
told AS (SELECT rid, string_agg(says, ',' ORDER BY start, rank, says) AS spans, string_agg(says, ',' ORDER BY start, rank) FILTER (rank < 3) AS base FROM every GROUP BY rid),
counts AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h, count(*) FILTER (live) AS l, count(*) FILTER (copied) AS c, max(repositories) AS r, max(owners) AS o
  FROM e GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, coalesce(l, 0) AS n_live, coalesce(c, 0) AS n_copied,
  coalesce(r, 0) AS repositories, coalesce(o, 0) AS owners, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told ON told.rid = d.rid LEFT JOIN counts ON counts.rid = d.rid
"""
