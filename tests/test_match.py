"""Match expressions against SQLite's full-text search and plain Python."""

import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import match as M
from docloom.plans import queries as Q

VOCABULARY = ["one", "two", "three", "four", "Café", "naïve", "ÉTÉ", "été", "Straße", "x1", "2024", "วิศวกรรม", "คอมพิวเตอร์", "ทุน", "Ångström", "the"]


def documents():
    rng = random.Random(11)
    rows = [(i, rng.choice([" ", "\n", ", ", " - ", "\r\n\t"]).join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 25)))) for i in range(150)]
    return rows + [(500, "one\ntwo three"), (501, "the the one"), (502, "วิศวกรรมคอมพิวเตอร์"), (503, ""), (504, "one, two; three. four!")]


def expression(rng, depth=0):
    word = lambda: rng.choice(VOCABULARY)
    kind = rng.randrange(8 if depth < 3 else 3)
    if kind == 0:
        return word()
    if kind == 1:
        return '"' + " ".join(word() for _ in range(rng.randrange(0, 4))) + '"'
    if kind == 2:
        return " ".join(rng.choice([word(), f'"{word()} {word()}"', '""', f"{word()} + {word()}"]) for _ in range(rng.randrange(1, 4)))
    if kind == 3:
        return f"({expression(rng, depth + 1)})"
    if kind == 7:
        return rng.choice(["one AND", "NOT one", "(one", "one)", 'a"b', "one, two", "a.b", "one'", "^one", "(one) two", "", " ", "AND", "one OR OR two", "+ one", "one +", "()"])
    return f"{expression(rng, depth + 1)} {('AND', 'OR', 'NOT')[kind - 4]} {expression(rng, depth + 1)}"


FIXED = ["one two", "(one OR two) three", '"" one', '"" AND one', "one NOT two three", "one two NOT three", "one OR two three", '"one two"', "วิศวกรรม", "วิศวกรรมคอมพิวเตอร์", "cafe", "ETE naive",
         "one NOT two OR three", "one OR two NOT three", 'one""two', "one and two", '"the the"', "one😀two", "_ one", '"," AND one', 'one OR ","', "nowhere", "nowhere OR one", "one NOT nowhere", "angstrom", '^"one two"', "^one NOT ^two", "one ^two", "one + ^two"]


def sqlite_answers(docs, questions):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(id unindexed, text)")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without full-text search")
    con.executemany("insert into f values (?, ?)", docs)
    out = set()
    for q, text in questions:
        try:
            out |= {(q, int(r[0])) for r in con.execute("select id from f where f match ?", (text,))}
        except sqlite3.OperationalError:
            pass
    return out


def test_expressions_against_sqlite(spark, tmp_path):
    rng = random.Random(6)
    docs, questions = documents(), list(enumerate(FIXED + [expression(rng) for _ in range(250)]))
    want = sqlite_answers(docs, questions)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(questions + [(9999, None)], "item_id long, text string")
    got = [tuple(r) for r in M.match(asked, table, f"{tmp_path}/scratch").select("item_id", "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2000
    M.write_positions(table, f"{tmp_path}/index", parts=4)
    assert {tuple(r) for r in M.match_index(asked, f"{tmp_path}/index").select("item_id", "doc_id").collect()} == want


def test_only_asked_folders_are_read(spark, tmp_path):
    M.write_positions(spark.createDataFrame(documents(), "doc_id long, text string"), f"{tmp_path}/index", parts=16)
    found = M.match_index(spark.createDataFrame([(1, "four")], "item_id long, text string"), f"{tmp_path}/index")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and found.count() == sum("four" in t for _, t in documents())
    assert M.match_index(spark.createDataFrame([(1, "nowhere")], "item_id long, text string"), f"{tmp_path}/index").count() == 0


def test_no_documents_and_no_questions(spark, tmp_path):
    docs, asked = spark.createDataFrame(documents()[:5] + [(7, None)], "doc_id long, text string"), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert M.match(asked.limit(0), docs, f"{tmp_path}/a").count() == 0
    assert M.match(asked, docs.limit(0), f"{tmp_path}/b").count() == 0


def test_guards():
    assert M.guard(M.parse("the AND (rare OR scarce) NOT odd")[2], [1000, 3, 4, 1]) == [1, 2]
    assert M.guard(M.parse("a b c")[2], [5, None, 2]) == [2]
    assert M.guard(M.parse('"" AND b')[2], [None, 2]) == []


def test_folding_of_every_old_code_point(spark):
    """Each code point by itself between two letters, against a plain version by Python's own tables."""
    old = unicodedata.ucd_3_2_0
    points = [c for c in map(chr, (*range(1, 0xD800), *range(0xE000, 0x30000))) if old.category(c) != "Cn"]

    def plain(text):
        out = [""]
        for c in text.lower():
            d = unicodedata.normalize("NFD", c)
            if len(d) > 1 and all("̀" <= x <= "ͯ" for x in d[1:]):
                c = d[0]
            if "̀" <= c <= "ͯ":
                continue
            c = "σ" if c == "ς" else c
            if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
                out[-1] += c
            elif out[-1]:
                out.append("")
        return [x for x in out if x]

    rows = spark.createDataFrame([(i, f"a{c}b {c}") for i, c in enumerate(points)], "i long, text string")
    got = dict(rows.select("i", T.folded_terms(F.col("text"))).collect())
    wrong = [hex(ord(c)) for i, c in enumerate(points) if got[i] != plain(f"a{c}b {c}")]
    assert len(wrong) == 0, (len(wrong), wrong[:40])


def test_goldens(spark):
    texts = {"วิศวกรรมคอมพิวเตอร์": ["ว", "ศวกรรมคอมพ", "วเตอร"], "Crème BRÛLÉE": ["creme", "brulee"], "İ i̇ é": ["i", "i", "e"], "ΣΑΣ": ["σασ"], "a_b-c'd": ["a", "b", "c", "d"]}
    rows = spark.createDataFrame(list(texts.items()), "text string, terms array<string>")
    assert rows.where(T.folded_terms(F.col("text")) != F.col("terms")).collect() == []


def test_wanted_positions_are_not_shuffled(spark):
    """Only the wanted words become rows, where their document lies, and at the places that all words have."""
    docs = spark.createDataFrame([(1, "B\u00e9 a, c be"), (2, None), (3, ""), (4, "c c x c")], "doc_id long, text string")
    wanted = spark.createDataFrame([("be",), ("c",), ("nowhere",)], "term string")
    found = M.positions(docs, wanted=wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    every = {(r.term, r.doc_id): r["at"] for r in M.positions(docs).collect()}
    got = {(r.term, r.doc_id): r["at"] for r in found.collect()}
    assert got == {k: v for k, v in every.items() if k[0] in ("be", "c")} == {("be", 1): [0, 3], ("c", 1): [2], ("c", 4): [0, 1, 3]}
    assert M.positions(docs, wanted=wanted.limit(0)).collect() == []
