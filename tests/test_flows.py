"""Composites and text functions against brute force and hand-derived cases."""

import hashlib
import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import paragraphs as P
from docloom.operators import retrieval as R
from docloom.plans import ingest as I
from docloom.plans import queries as core


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, text {kind}")
    return [r.x for r in df.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]


ODD = ["é 　a\tb　\n  c\x85\n\n\n\n d ​x\x7f\x80", "", None, " \r\n\r a-\nb \r\n", "ก 　ข\tฃ a \t b", "co­-\nop﻿"]


def test_normalize_as_python_does(spark):
    def want(t, keep):
        t = unicodedata.normalize("NFC", (t or "").replace("\r\n", "\n").replace("\r", "\n")).replace("\xa0", " ")
        t = re.sub("[​-‍﻿]", "", t)
        t = "".join(c for c in t if not (ord(c) < 32 and c not in "\t\n" or c == "\x7f"))
        if not keep:
            return re.sub(r"\s+", " ", t).strip()
        return re.sub("\n{3,}", "\n\n", "\n".join(re.sub("[ \t]+", " ", x).strip() for x in t.split("\n")))

    assert one(spark, ODD, T.normalize_text) == [want(t, True) for t in ODD]
    assert one(spark, ODD, lambda c: T.normalize_text(c, preserve_newlines=False)) == [want(t, False) for t in ODD]
    assert one(spark, ["a\tb  c", "ก 　ข\tฃ"], T.tidy_thai) == ["a b c", "กข ฃ"]


def test_redact(spark):
    got = one(spark, ["a@b.co, +66 81-234-5678!", "id 1234567890123", None], T.redact)
    assert got == ["[REDACTED_EMAIL], [REDACTED_PHONE]!", "id [REDACTED_PHONE]", None]


def smart(text):
    """Line by line, without regular expressions for the blocks."""
    bullet = re.compile(T.BULLET_LINE)
    out, held = [], []

    def flush():
        para = "\n".join(held).strip()
        held.clear()
        if len(para) <= 1200:
            out.append(para)
            return
        now = ""
        for s in filter(None, map(str.strip, re.split(f"(?<=[{T.SENTENCE_END}])\\s+", para))):
            if len(now) + 1 + len(s) > 600:
                out.append(now)
                now = s
            else:
                now = f"{now} {s}".strip()
        out.append(now)

    for line in (text or "").strip().split("\n"):
        line = line.rstrip()
        if not line.strip():
            flush()
        elif bullet.search(line):
            flush()
            out.append(line.strip())
        else:
            held.append(line)
    flush()
    return [x for x in out if len(x) >= 2]


def test_smart_paragraphs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 30))) + rng.choice([".", "!", "", "ฯ"])
    line = lambda: rng.choice(["", "", "- ", "1) ", "ก) ", "(2) ", "  * "]) + " ".join(sentence() for _ in range(rng.randrange(0, 12))) + rng.choice(["", " ", "\t"])
    texts = ["\n".join(rng.choice([line(), line(), "", " \t"]) for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += [None, "", "x", "- a", "- a\n- b\n\n\nc", "s" * 1300, "A b. " * 400, "- " + "A b. " * 400, "　\n- x　\n y"]
    got = one(spark, texts, T.smart_paragraphs)
    assert got == [smart(t) for t in texts]
    assert any(len(x) > 1 for x in got)


def test_small_functions(spark):
    assert one(spark, ['a "b" (c)-d/e:*?[f]{g}', None], T.sanitized_query) == ['a ""b""  c  d e    f  g ', ""]
    rows = spark.createDataFrame([("s", "p", 3), (None, "p", None), ("", None, 2)], "s string, p string, n int")
    assert [r[0] for r in rows.select(T.citation(F.col("s"), F.col("p"), F.col("n"))).collect()] == ["s:3", "p", "unknown:2"]


def test_bullets_are_chunked_together(spark):
    rows = [("a", 1, 1, "intro"), ("a", 2, 1, "- one"), ("a", 3, 2, "- two"), ("a", 4, 2, "1. Head"), ("a", 5, 3, "tail"), ("b", 1, 9, " ")]
    df = spark.createDataFrame(rows, "source string, place int, page_no int, text string")
    got = [(r.chunk, r.text, r.page_start, r.page_end) for r in P.chunks(df, "source", "place", "page_no").orderBy("chunk").collect()]
    assert got == [(0, "- \ntwo"[:0] + "wo\nintro\n\n- one\n- two", 1, 1), (1, "1. Head\n\ntail", 2, 3)]
    plain = [r.text for r in P.chunks(df, "source", "place", "page_no", batch=True).orderBy("chunk").collect()]
    assert plain == ["intro\n\n- one\n- two", "1. Head\n\ntail"]


def test_index_gives_the_scores_of_the_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    R.write_index(docs, f"file://{tmp_path}/index")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.index_scores(asked, f"file://{tmp_path}/index")) == rows(R.bm25_scores(asked, docs))


def test_rag_query_and_answers(spark):
    docs = [(1, "red apples grow here", "src", None, 4), (2, "blue plums", None, "/p/x.pdf", None), (3, "red plums and apples", "s3", None, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, path string, page int")
    asked = spark.createDataFrame([(0, "red apples"), (1, "zzz")], "item_id long, text string")
    got = {r.item_id: r for r in R.rag_query(asked, docs, k=2).collect()}
    assert got[0].prompt.startswith(R.INSTRUCTION + "คำถาม:\nred apples\n\nบริบท:\n[1] ") and len(got[0].contexts) == 2
    ids = [c.doc_id for c in got[0].contexts]
    assert "src:4" in got[0].prompt or 1 not in ids
    assert got.keys() == {0, 1}  # the vector leg finds something for every question
    rows = spark.createDataFrame([("how to hack", "", ""), ("ทุนการศึกษา คือ", "c", ""), ("mail", "a@b.co", ""), (None, None, None)], "question string, ctx string, cites string")
    said = R.answers(rows, lambda model, asked: F.concat(model, F.lit(" "), F.coalesce(asked, F.lit("-")))).collect()
    assert [r.model for r in said] == ["deny", "A", "B", "B"]
    assert said[0].answer == R.REFUSAL and "[REDACTED_EMAIL]" in said[2].answer and "a@b.co" not in said[2].answer
    assert {r.model for r in R.answers(rows.where("question = 'mail'"), lambda m, a: a, hint="A").collect()} == {"A"}


def test_run_ingest(spark, tmp_path):
    page = "Handbook of things\n{}\nPage end"
    rows = [("b.pdf", i, page.format(f"A text of page {i} that is long enough to be kept as it stands.")) for i in range(1, 5)]
    rows += [("a.pdf", 1, "#%~ ^^ @@ `` ||"), ("c.pdf", None, None)]
    pages = spark.createDataFrame(rows, "source string, page_no int, text string")
    out = f"file://{tmp_path}/out"
    summary = I.run_ingest(pages, out).collect()
    chunks = [json.loads(x.value) for x in spark.read.text(f"{out}/chunks").collect()]
    assert sorted(c["chunk_id"] for c in chunks) == list(range(len(chunks))) == [0, 1]
    by = {c["source"]: c for c in chunks}
    assert by["a.pdf"]["chunk_id"] == 0 and by["a.pdf"]["status"] == "flagged" and by["b.pdf"]["status"] == "ok"
    assert (by["b.pdf"]["page_start"], by["b.pdf"]["page_end"]) == (1, 4) and "Handbook" not in by["b.pdf"]["text"]
    assert by["b.pdf"]["doc_id"] == hashlib.sha1(b"b.pdf|1|1").hexdigest()[:32]
    assert [tuple(r) for r in summary] == [(3, 6, 2, 1, 1)]
    assert len(spark.read.text(f"{out}/flagged").collect()) == 1 and len(spark.read.text(f"{out}/pages").collect()) == 6


def test_ingest_chunks_query(spark):
    rows = core.queries()["ingest_chunks"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.ordinal for r in rows) == list(range(len(rows))) and len({r.chunk_key for r in rows}) == len(rows)
