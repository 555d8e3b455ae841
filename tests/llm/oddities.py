"""Small tables with everything that operators must bear."""

LONG = "word " * 30_000 + "x" * 60_000
BASE = [
    (1, "The same text, twice.\nsecond line of it is here\n", "en", "a", 10),
    (2, "The same text, twice.\nsecond line of it is here\n", "en", "b", 10),
    (3, "the SAME text, twice.\nsecond line of it is here\n", "en", None, None),
    (4, None, "en", "a", None),
    (5, "", None, "a", 0),
    (6, " \n\t\n ", "de", "b", 5),
    (7, LONG, "en", "a", len(LONG)),
    (8, "Ünïcödé ✓ 文字 \U0001f600 \x00 end", "fr", "", 3),
    (9, "12345 --- !!!", "es", "c", 3),
    (None, "A row without an id, in words.", "en", "a", 1),
    (10, "repeated row", "en", "c", 1),
    (10, "repeated row", "en", "c", 1),
    (10, "same id, another text", "en", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators make themselves.
CLASHES = ("size", "target", "taken", "times", "weight", "shard", "slot", "t", "keys", "line", "pos", "n_lines", "n_dropped", "lang_pred", "score", "piece", "length", "sequence_id", "offset", "class_id", "a", "key", "row", "kept", "digest", "media", "pii")


def odd(spark):
    df = spark.createDataFrame(BASE, SCHEMA)
    for name in CLASHES:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def empty(spark):
    return odd(spark).limit(0)


def documents(spark, rows):
    """(doc_id, text) with the other columns null."""
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
