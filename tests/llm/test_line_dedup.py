import random

import pytest
from oddities import BASE, documents, empty, odd

from loomlog.llm import line_dedup


def within_one(a, b):
    """One character replaced, added or taken away, or none."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def brute(rows, min_chars=line_dedup.MIN_CHARS):
    """Texts after comparing every line with all earlier ones."""
    lines = sorted(((i if i is not None else -1, p, line) for i, t in rows if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" ")), key=lambda x: x[:2])
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept, n, gone = [], 0, 0
        for p, line in enumerate(t.split("\n")):
            if line.strip(" "):
                n += 1
                here = (i if i is not None else -1, p)
                if any(line == x or (min(len(line), len(x)) >= min_chars and within_one(line, x)) for j, q, x in lines if (j, q) < here):
                    gone += 1
                    continue
            kept.append(line)
        out.append((i, "\n".join(kept), n, gone))
    return sorted(out, key=repr)


def run(df, **more):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df, **more).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_comparing_all_lines(spark, seed):
    rng = random.Random(seed)
    letters = "abcé文\U0001f600 "
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 19, 20, 21, 40, 41]))) for _ in range(25)] + ["a" * 30, "ab" * 15, "", " "]

    def edited(line):
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(line) + 1)
            line = rng.choice([line[:k] + rng.choice(letters) + line[k:], line[:k] + line[k + 1 :], line[:k] + rng.choice(letters) + line[k + 1 :]])
        return line

    rows = [(i, "\n".join(edited(rng.choice(pool)) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rng.shuffle(rows)
    assert run(documents(spark, rows)) == brute(rows)


def test_edits_at_every_place(spark):
    line = "the quick brown fox jumps over it"
    rows = [(0, line)]
    for k in range(len(line)):
        rows += [(len(rows), line[:k] + "#" + line[k + 1 :]), (len(rows) + 1, line[:k] + line[k + 1 :]), (len(rows) + 2, line[:k] + "#" + line[k:])]
    rows.append((len(rows), line + "#"))
    rows.append((len(rows), line[::-1]))
    assert run(documents(spark, rows)) == brute(rows)
    assert all(r[1] == "" for r in run(documents(spark, rows)) if 0 < r[0] < len(rows) - 1)


def test_long_lines(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(8000)) + "."
    rows = [(0, base)]
    for k in (0, 3999, 4000, 4001, 7999):
        rows += [(len(rows), base[:k] + "#" + base[k + 1 :]), (len(rows) + 1, base[:k] + base[k + 1 :]), (len(rows) + 2, base[:k] + "#" + base[k:])]
    rows.append((len(rows), base[:2000] + "#" + base[2001:6000] + "#" + base[6001:]))
    assert run(documents(spark, rows)) == brute(rows)


@pytest.mark.parametrize("least", [0, 1, 3])
def test_short_lines_are_compared_if_asked(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join("".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(2))) for i in range(12)] + [(20, "1."), (21, "2."), (22, "x"), (23, "y")]
    assert run(documents(spark, rows), min_chars=least) == brute(rows, least)


def test_edits_beside_the_borders_of_pieces(spark):
    rng = random.Random(11)
    base = "".join(rng.choice("abc文😀 ") for _ in range(399)) + "."
    rows = [(0, base)]
    for k in (0, 1, 62, 63, 64, 65, 127, 128, 129, 199, 200, 201, 262, 263, 264, 265, 327, 328, 391, 392, 398, 399):
        rows += [(len(rows), base[:k] + "#" + base[k + 1 :]), (len(rows) + 1, base[:k] + base[k + 1 :]), (len(rows) + 2, base[:k] + "#" + base[k:])]
    assert run(documents(spark, rows)) == brute(rows)
    assert all(r[3] == 1 for r in run(documents(spark, rows)) if r[0])


def test_lines_of_200_000_characters_take_seconds(spark):
    import time

    base = "".join(random.Random(12).choices("abcdefgh ", k=199_999)) + "."
    rows = [(0, base), (1, base[:150_000] + "#" + base[150_001:]), (2, base[:10] + base[11:]), (3, base[:-7] + "##" + base[-7:])]
    start = time.monotonic()
    assert [(r[0], r[3]) for r in run(documents(spark, rows))] == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert time.monotonic() - start < 30


def test_odd_and_empty_tables(spark):
    df = odd(spark)
    got = line_dedup.dedup_lines(df)
    assert set(got.columns) == set(df.columns)
    assert run(df) == brute([(i, t) for i, t, *_ in BASE])
    assert run(empty(spark)) == []
