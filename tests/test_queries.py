"""Queries over small tables of their own, for rows that the test data have none of."""

import hashlib

from docloom.plans import queries as core


def test_clean_text_composes(spark, tmp_path):
    spark.createDataFrame([(1, "cafe\u0301"), (2, "plain"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.digest, r.n_chars) for r in core.queries()["clean_text"](spark, str(tmp_path)).collect()}
    want = {1: "caf\u00e9 coop", 2: "plain coop", 3: ""}
    assert got == {k: (hashlib.sha1(v.encode()).hexdigest(), len(v)) for k, v in want.items()}


def test_page_fallback_asks_every_page(spark, tmp_path):
    long = "a page with a text layer that is long enough and good enough to stay as it is"
    rows = [(1, "short code"), (2, long), (3, "short"), (5, long), (6, ". , ; " * 20 + "x"), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.method, r.digest) for r in core.queries()["page_fallback"](spark, str(tmp_path)).collect()}
    noisy = lambda x: x.translate(str.maketrans("aeo", "#%~"))
    want = {1: ("ocr", noisy("short code")), 2: ("text layer", long), 3: ("ocr", noisy("short")), 5: ("ocr", noisy(long)), 6: ("ocr", rows[4][1]), 7: ("text layer", "")}
    assert got == {k: (m, hashlib.sha1(v.encode()).hexdigest()) for k, (m, v) in want.items()}


def test_cleaning_at_every_composing_character(spark):
    """Each character that NFC changes, reorders or composes goes to it, and blanks of every kind are stripped."""
    import unicodedata as u

    from docloom.functions import text as T
    from pyspark.sql import functions as F

    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x20000))]
    texts = ["q" + "".join(chars[i:i + 1]) + "\u0323\u0307x" * (i % 2) for i in range(0, len(chars), 7)] + ["\u2000", "e\u200b\u0301", "\u200b e", "\u1100\u1161", "\u09c7\u09be"]
    strips = [f"{c}x {c}y{c}\n{c}" for c in T.SPACES] + [T.SPACES, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts + strips)], "i int, x string")
    for i, x, n, s in df.select("i", "x", T.nfc(F.col("x")), T.strip(F.col("x"))).collect():
        assert n == u.normalize("NFC", x), hex(ord(x[1]))
        assert s == x.strip()


def test_cleaning_calls_python_for_composing_characters_alone(spark):
    from docloom.functions import text as T
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("plain\u200btext \u2013 \u201cquoted\u201d",), ("e\u0301",)], "x string")
    assert [r[0] for r in df.select(F.col("x").rlike(T.COMPOSING)).collect()] == [False, True]


def test_numbers_a_sign_apart_are_redacted_whole(spark):
    from docloom.functions import text as T
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("call 12-34-56-78 90-12-34-56-78-90 12-34-56-78.",)], "x string")
    assert "12" not in df.select(T.redact(F.col("x"))).first()[0]
