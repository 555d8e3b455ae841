import random

import numpy as np
import pytest
from oddities import BASE, documents, empty, odd

from loomlog.llm import ngram_join
from loomlog.llm.components import components


def brute(rows, n=5, threshold=0.8):
    """class_id, n_links and copies by comparing all texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = {t: ngram_join.shingles(t, n) for t in texts}
    links = {t: set() for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for i, t in rows:
        reached, todo = {t or ""}, [t or ""]
        while todo:
            for x in links[todo.pop()] - reached:
                reached.add(x)
                todo.append(x)
        ids = [j for j, u in rows if (u or "") in reached and j is not None]
        out.append((i, min(ids, default=None), len(links[t or ""]), sum((u or "") == (t or "") for _, u in rows)))
    return sorted(out, key=repr)


def near_copies(seed, groups, copies, words=120, edits=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def run(spark, rows, **more):
    got = ngram_join.jaccard_classes(documents(spark, rows), **more)
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["copies"]) for r in got.collect()), key=repr)


def test_small_groups_equal_brute_force(spark):
    rows = near_copies(1, 12, 6) + near_copies(2, 30, 1)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(900 + k, rows[k][1]) for k in range(0, 40, 3)] + [(990, "three words only"), (991, "three words  only"), (992, None), (993, ""), (994, " \n")]
    assert run(spark, rows) == brute(rows)


def test_all_links_of_a_group_in_units_and_rows(spark):
    rows = near_copies(3, 1, 150, edits=3) + [(1000 + i, t) for i, t in near_copies(4, 20, 1)]
    assert run(spark, rows, small=6) == brute(rows)


def test_a_dense_group_of_200(spark):
    rng = random.Random(20)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(f"e{i}" if k == at else w for k, w in enumerate(base))) for i, at in enumerate(rng.choices(range(100), k=200))]
    want = brute(rows)
    assert sum(x[2] for x in want) == 2 * 19_900
    assert run(spark, rows) == want


def test_a_chain_of_600(spark):
    words = [f"w{k}" for k in range(600 * 4 + 120)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(600)]
    want = brute(rows)
    assert {x[1] for x in want} == {0} and max(x[2] for x in want) < 20
    assert run(spark, rows) == want


def test_prefixes_are_shortened_as_the_links_demand(spark):
    few = documents(spark, near_copies(21, 3, 3))
    assert [d for d, _ in ngram_join.jaccard_links(few)[2]] == [5, 3]
    alike = documents(spark, [(i, t) for i, (_, t) in enumerate(near_copies(22, 1, 200, words=300, edits=3))])
    rounds = ngram_join.jaccard_links(alike, target=0.9999)[2]
    assert [d for d, _ in rounds] == [5] and rounds[-1][1] >= 0.9999
    assert ngram_join.jaccard_links(few, target=1.0)[2][-1][0] == 1


def test_odd_and_empty_tables(spark):
    got = ngram_join.jaccard_classes(odd(spark))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["copies"]) for r in got.collect()), key=repr) == brute([(i, t) for i, t, *_ in BASE])
    assert ngram_join.jaccard_classes(empty(spark)).collect() == []


def test_depth_and_recall():
    nothing = [0] * ngram_join.STEPS
    assert ngram_join.next_depth(nothing, 0.8, 0.99999, 5) == 3  # what is not known is taken to lie at the threshold
    assert ngram_join.next_depth([0] * 15 + [10**6], 0.8, 0.99999, 5) == 5
    assert ngram_join.next_depth([10**6] + [0] * 15, 0.8, 0.9999, 5) == 4
    assert ngram_join.recall(0.8, 3) > 0.999999 > ngram_join.recall(0.8, 4) > 0.9999


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    a = [f"w{rng.randrange(9999)}" for _ in range(400)]
    b = a[:350] + [f"x{k}" for k in range(50)]
    x, y = ngram_join.Signer().sign([" ".join(a), " ".join(b)])
    sa, sb = ngram_join.shingles(" ".join(a), 5), ngram_join.shingles(" ".join(b), 5)
    assert abs(np.mean(x == y) - len(sa & sb) / len(sa | sb)) < 0.12


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200 + k) for k in range(1, 20)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def chained(seed, copies, words=120, most=6):
    """Near copies, each an edit of any earlier one: some far apart, most linked to many."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(words)]]
    while len(texts) < copies:
        w = list(rng.choice(texts))
        for _ in range(rng.randrange(1, most)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        texts.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def paired(seed, pairs, words=120):
    """Texts of one template, about 0.6 alike; few have more than one link, to the next or the one before."""
    rng = random.Random(seed)
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(words)], []
    for _ in range(pairs):
        w = list(base)
        for k in rng.sample(range(words), 3):
            w[k] = f"e{rng.randrange(10**6)}"
        texts.append(w)
        w = list(w)
        for k in rng.sample(range(words), 2):
            w[k] = f"e{rng.randrange(10**6)}"
        texts.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_links_of_a_large_group_are_all_found(spark):
    rows = chained(7, 400, words=60, most=4) + [(1000 + i, t) for i, t in near_copies(8, 1, 300, words=60)]
    want = brute(rows)
    assert sum(w[2] for w in want) > 5_000 and len({w[1] for w in want}) > 2
    assert run(spark, rows) == want


def test_blocks_of_a_large_node(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 20)
    rows = near_copies(9, 1, 120, words=60)
    assert run(spark, rows) == brute(rows)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(ngram_join, "BITS", 64)
    rng = random.Random(10)
    sets = [set(rng.sample(range(400), rng.randrange(1, 200))) for _ in range(30)]
    got = ngram_join._shared(sets, np.triu(np.ones((30, 30), dtype=bool), 1))
    assert got.tolist() == [[len(a & b) if i < j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def test_single_links_within_a_template_are_found(spark):
    rows = paired(12, 250)
    want = brute(rows)
    assert min(w[2] for w in want) == 1 and max(w[2] for w in want) < 4
    assert run(spark, rows) == want
