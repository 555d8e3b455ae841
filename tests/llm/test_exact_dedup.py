import hashlib
import random
import string

import pytest
from oddities import BASE, documents, empty, odd

from loomlog.llm import exact_dedup
from loomlog.llm.exact_dedup import CuckooIndex


def digest(x):
    return hashlib.sha256(str(x).encode()).digest()


@pytest.mark.parametrize("capacity", [1, 16, 5000])
def test_index_against_a_dict(capacity):
    rng = random.Random(capacity)
    index, want = CuckooIndex(capacity), {}
    for step in range(12_000):
        x = rng.randrange(3000)
        if rng.random() < 0.6:
            assert index.insert(digest(x), step) == (x not in want)
            most, n = want.get(x, (-1, 0))
            want[x] = (max(most, step), n + 1)
        else:
            assert index.remove(digest(x)) == (x in want)
            if x in want:
                want[x] = (want[x][0], want[x][1] - 1)
                if not want[x][1]:
                    del want[x]
    assert {e[0]: (e[1], e[2]) for e in index.entries()} == {digest(x): v for x, v in want.items()}
    assert index.size == len(want) and all((index.find(digest(x)) is not None) == (x in want) for x in range(3000))
    assert capacity > 16 or index.resizes


def test_hits_are_verified():
    index = CuckooIndex()
    a = digest(1)
    index.insert(a, 1)
    assert index.find(a[:16] + bytes(16)) is None and index.false_hits == 1
    assert not index.remove(a[:16] + bytes(16)) and index.find(a) == [a, 1, 1]


def test_filter_alone_seldom_errs():
    index = CuckooIndex(4096)
    for x in range(3000):
        index.insert(digest(x), x)
    for x in range(3000, 23_000):
        index.find(digest(x))
    assert index.false_hits < 50


def normal(t):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[normal(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in exact_dedup.exact_dedup(df).collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A b", "a B", "É", "é", "x", None, "", "ß", "ẞ", "İ", "i̇", f"t{rng.randrange(200)}"])) for i in range(2000)]
    monkeypatch.setattr(exact_dedup, "PARTITION_KEYS", 20)
    assert run(documents(spark, rows)) == brute(rows)


def test_odd_and_empty_tables(spark):
    assert run(odd(spark)) == brute([(i, t) for i, t, *_ in BASE])
    assert run(empty(spark)) == []


@pytest.mark.parametrize("seed", range(3))
def test_deletion_from_a_table_index(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, None]), f"t{rng.randrange(12)}") for i in range(60)]
    gone = rng.sample(rows, 25) + [(99, "never there"), (999, rows[0][1]), rows[1], rows[1]]
    of = lambda x: exact_dedup.digests(documents(spark, x))
    left = exact_dedup.without(exact_dedup.live_digests(of(rows)), of(rows), of(gone))
    stay = list(rows)
    for r in gone:
        if r in stay:
            stay.remove(r)
    want = {}
    for i, t in stay:
        want.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
    want = {d: (max((x for x in own if x is not None), default=None), len(own)) for d, own in want.items()}
    assert {bytes(r["digest"]): (r["largest"], r["n"]) for r in left.collect()} == want


def test_the_keeper_can_be_deleted(spark):
    rows = exact_dedup.digests(documents(spark, [(1, "x"), (9, "X"), (5, "y")]))
    left = exact_dedup.without(exact_dedup.live_digests(rows), rows, exact_dedup.digests(documents(spark, [(9, "X")])))
    assert sorted((r["largest"], r["n"]) for r in left.collect()) == [(1, 1), (5, 1)]


def test_a_hot_group_is_dealt_out(spark):
    from loomlog.llm.common import spread_join

    rows = exact_dedup.digests(documents(spark, [(i, "hot" if i % 3 else f"t{i}") for i in range(300)]))
    joined = spread_join(rows, exact_dedup.live_digests(rows), "digest", "n", hot_rows=50)
    assert sorted(r["doc_id"] for r in joined.collect()) == list(range(300))
    assert {r["n"] for r in joined.where("doc_id % 3 != 0").collect()} == {200}
