import random
from collections import Counter

import pytest
from oddities import BASE, documents, empty, odd

from loomlog.llm import packing, queries


def fewest(sizes, capacity):
    """Fewest sequences, by trying everything."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[k]:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - sizes[k]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(rng.choice([1, 4, 9]), rng.choice([12, 20])) for _ in range(rng.randint(1, 9))]
    fixed, rest = packing.dominance_reduction(Counter(sizes), 20)
    used = Counter(rest)
    for p in fixed:
        assert sum(s * c for s, c in p.items) <= 20
        for s, c in p.items:
            used[s] += c * p.times
    assert used == Counter(sizes)
    left = [s for s, c in rest.items() for _ in range(c)]
    assert sum(p.times for p in fixed) + fewest(left, 20) == fewest(sizes, 20)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_whole_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    sizes = Counter(min(4096, int(rng.expovariate(1 / 700)) + 1) for _ in range(5000))
    plan = packing.plan(sizes, 4096)
    used = Counter()
    for p in plan:
        assert 0 < sum(s * c for s, c in p.items) <= 4096
        for s, c in p.items:
            used[s] += c * p.times
    assert used == sizes
    assert sum(p.times for p in plan) <= -(-sum(s * c for s, c in sizes.items()) // 4096) * 1.01 + 1
    with pytest.raises(ValueError):
        packing.plan({4097: 1}, 4096)
    assert packing.plan({}, 4096) == []


def whole(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_the_tokenizers(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    whole_tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    mine = packing.WordTokenizer(queries.tokenizer_path())
    rng = random.Random(1)
    texts = [t or "" for _, t, *_ in BASE] + ["It's 'LL <|endoftext|> x", "\x1c a\x85b İΣ", "Straße ÀÉ ² ½ µ", *("".join(chr(rng.choice([rng.randrange(256), rng.randrange(0x2100)])) for _ in range(20)) for _ in range(300))]
    for t in texts:
        assert mine.encode(t) == np.array(whole_tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    rows = packing.pack_documents(documents(spark, list(enumerate(texts))), queries.tokenizer_path()).collect()
    whole(rows)
    for i, t in enumerate(texts):
        ids = np.array([*whole_tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert own == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]


def test_odd_and_empty_tables(spark):
    rows = packing.pack_documents(odd(spark), queries.tokenizer_path()).collect()
    whole(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, *_ in BASE)
    assert [r["length"] for r in rows if r["doc_id"] == 4] == [1]
    assert packing.pack_documents(empty(spark), queries.tokenizer_path()).collect() == []


def test_other_columns_stay_with_their_rows(spark):
    rows = spark.range(500).selectExpr("id", "1 + id % 7 AS length", "'x' AS offset")
    packed = packing.pack(rows, 10).collect()
    assert sorted(r["id"] for r in packed) == list(range(500)) and all(r["length"] == 1 + r["id"] % 7 for r in packed)
    assert whole(packed, 10) == -(-sum(1 + i % 7 for i in range(500)) // 10)
