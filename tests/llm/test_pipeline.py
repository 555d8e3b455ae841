from collections import Counter

import duckdb
import pytest
from oddities import BASE, documents, empty, odd
from test_ngram_join import brute, chained, paired

import corpus_pipeline
from loomlog.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", range(4))
def test_stages_bear_odd_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    df = odd(spark)
    out = stage(spark, df, DATA)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    rows = out.collect()
    assert rows and all(r["size"] == "clash" and r["score"] == "clash" and r["n_lines"] == "clash" for r in rows)
    if name == "language_id":
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in BASE if i not in (4, 5, 6, 9))
    if name == "near_dedup":
        assert Counter(r["doc_id"] for r in rows) == Counter({1: 1, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1, 10: 3})
    if name == "line_dedup":
        assert 2 not in {r["doc_id"] for r in rows} and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert stage(spark, empty(spark), DATA).collect() == []


def test_last_stage(spark):
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, odd(spark), DATA).collect()} == {i for i, *_ in BASE}
    assert corpus_pipeline.STAGES[4][1](spark, empty(spark), DATA).collect() == []


def test_run_and_every_query(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 4096
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    n = duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    for name, query in queries.queries().items():
        got = query(spark, DATA)
        rows = got.collect()
        assert len(rows) >= n, name
        if name in queries.oracle_sql():
            want = duck.sql(queries.oracle_sql()[name])
            assert sorted(repr(tuple(r[c] for c in want.columns)) for r in rows) == sorted(map(repr, want.fetchall())), name


def test_one_document_of_each_large_group_stays(spark):
    rows = chained(11, 400, words=60, most=4) + [(1000 + i, t) for i, t in paired(12, 250)]
    want = sorted(i for i, class_id, *_ in brute(rows) if i == class_id)
    assert sorted(r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, documents(spark, rows), DATA).collect()) == want
