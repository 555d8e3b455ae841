import random
import zlib

import numpy as np
import pytest
from oddities import BASE, documents, empty, odd

from loomlog.llm import langid

WORDS = {"aa": ["the", "and", "tion", "with", "that"], "bb": ["ñada", "ción", "que", "los", "esto"], "cc": ["über", "sch", "ung", "der", "nicht"]}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def sample(seed, n=60):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(WORDS)), rng.randint(1, 80)), lang, "s", 1) for i in range(n)]


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], rng, hidden=3)
    for w in net.weights():
        w *= 0.5
    for name in ("inputs", "recurrent", "out"):
        setattr(net, name, [w.astype(np.float64) for w in getattr(net, name)])
    net.bias = net.bias.astype(np.float64)
    windows, targets = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(windows, targets)
    for w, g in zip(net.weights(), grads, strict=True):
        flat = [np.unravel_index(k, w.shape) for k in rng.choice(w.size, min(w.size, 12), replace=False)] + ([(0, 97, 0), (1, 98, 1), (2, 99, 2)] if w.ndim == 3 and w.shape[1] == 256 else [])
        for at in flat:
            old = w[at]
            w[at] = old + 1e-2
            up = net.gradients(windows, targets)[0]
            w[at] = old - 1e-2
            down = net.gradients(windows, targets)[0]
            w[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_reading_equals_reading_alone():
    net = langid.train([langid.windows_of(t) for _, t, *_ in sample(1)], [x for *_, x, _, _ in sample(1)], epochs=1)
    texts = [t.encode() for _, t, *_ in sample(2, 20)] + [b"", b"x" * 300, b"y" * 64]
    pooled, votes = langid.read_texts(net, texts)
    for k, t in enumerate(texts):
        p, v = langid.read_texts(net, [t])
        assert np.allclose(pooled[k], p[0], atol=1e-5) and (votes[k].sum(), v[0].sum()) >= (len(t), len(t))
        if t:
            assert abs(pooled[k].sum() - 1) < 1e-4
            labels = langid.label_positions(net, t.decode())
            assert len(labels) == len(t)
    assert pooled[-3].sum() == 0


def test_held_out_accuracy(spark):
    rows = sample(3, 400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("held_out", langid.held_out())
    net = langid.fit(df, per_label=60)
    got = langid.predict(df, net).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r["held_out"]]
    assert len(tested) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.97
    assert all(0 <= r["score"] <= 1 and 0 <= r["position_share"] <= 1 for r in got)


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    rows = sample(4, 200)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    hidden = [(i, t + " zzz" if zlib.crc32(str(i).encode()) % 4 == 2 else t, "bb" if zlib.crc32(str(i).encode()) % 4 == 2 else x, "other", 7) for i, t, x, _, _ in rows]
    one, two = (langid.fit(spark.createDataFrame(r, schema), per_label=30) for r in (rows, hidden))
    assert all((a == b).all() for a, b in zip(one.weights(), two.weights(), strict=True))


def test_the_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, t, x, None, None) for _, t, x, _, _ in sample(5, 300)] + [(1, "the and " * 20_000, "aa", None, None)] * 50
    found = langid.sample(documents(spark, []).union(spark.createDataFrame(rows, documents(spark, []).schema)), per_label=20).collect()
    counts = {x: sum(r["lang"] == x for r in found) for x in WORDS}
    assert all(15 <= n <= 20 for n in counts.values()) and max(len(r["windows"]) for r in found) <= langid.WINDOWS_EACH * langid.WINDOW
    few = langid.sample(spark.createDataFrame(rows, documents(spark, []).schema), per_label=5, most_labels=2).collect()
    assert len({r["lang"] for r in few}) == 2
    net = langid.fit(spark.createDataFrame(rows, documents(spark, []).schema), per_label=20)
    assert net.labels == sorted(WORDS)


@pytest.mark.parametrize(("t", "yes"), [("", False), ("12 ²½ _-", False), ("文", True), ("1a", True), ("ⅷ", False), ("\n", False)])
def test_letters(t, yes):
    assert langid.has_letter(t) == yes


def test_odd_and_empty_tables(spark):
    net = langid.fit(odd(spark), per_label=5)
    got = langid.predict(odd(spark), net).collect()
    assert len(got) == len(BASE)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {4, 5, 6, 9}
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    nothing = langid.fit(empty(spark))
    assert langid.predict(empty(spark), nothing).collect() == []
    assert [r["lang_pred"] for r in langid.predict(documents(spark, [(1, "words")]), nothing).collect()] == ["und"]
