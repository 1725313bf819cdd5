"""Model seams with counting fakes; filters of the hybrid search; from question to answer."""

import os

from pyspark.sql import functions as F

from docloom.functions.quality import hash_vector
from docloom.operators import models as L
from docloom.operators import retrieval as R
from docloom.plans import answering as N


def lengths(log):
    """A model that writes its loads and the sizes of its batches to ``log``; it fails on texts with "bad"."""

    def load():
        def note(x):
            with open(log, "a") as f:
                f.write(f"{os.getpid()} {x}\n")

        note("load")

        def model(texts):
            note(len(texts))
            if any("bad" in x for x in texts):
                raise ValueError("bad")
            return [[float(len(x)), 0.0, 1.0] for x in texts]

        return model

    return load


def test_batches_run_over_arrow_batches(spark, tmp_path):
    """Batches are full whatever Arrow's own size; nulls are not asked; every row keeps its columns and its answer."""
    log = f"{tmp_path}/log"
    rows = spark.range(0, 103, 1, 1).select("id", F.when(F.col("id") % 10 != 3, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text"), F.lit("own").alias("note"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = L.with_model(rows, ["text"], "v", "array<double>", "lengths", lengths(log), 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: (r.note, r.v) for r in got} == {i: ("own", None if i % 10 == 3 else [float(i), 0.0, 1.0]) for i in range(103)}
    said = [x.split()[1] for x in open(log)]
    # 20 rows hold 18 texts; the last three rows are asked at the end
    assert said == ["load", "18", "18", "18", "18", "18", "3"]


def test_one_load_a_worker(spark, tmp_path):
    log = f"{tmp_path}/log"
    rows = spark.range(0, 64, 1, 8).select("id", F.lit("abc").alias("text"))
    assert L.with_model(rows, ["text"], "v", "array<double>", str(tmp_path), lengths(log), 4).where("v[0] = 3").count() == 64
    told = [x.split() for x in open(log)]
    assert len([1 for _, x in told if x == "load"]) == len({pid for pid, _ in told})
    assert [x for _, x in told if x != "load"] == ["4"] * 16


def test_a_failing_batch_is_asked_one_by_one(spark, tmp_path):
    texts = ["a", "bad", "ccc", None, "", "xbad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = L.embedded(rows, "text", "v", f"{tmp_path}/one", lengths(f"{tmp_path}/log"), 3, 4)
    back = rows.select("id", R.unit(hash_vector(F.col("text"), 3)).alias("f"))
    for r in got.join(back, "id").collect():
        text = texts[r.id]
        if text is None:
            assert r.v is None
        elif "bad" in text:
            assert r.v == r.f
        else:
            size = (len(text) ** 2 + 1) ** 0.5
            assert [round(x, 9) for x in r.v] == [round(len(text) / size, 9), 0.0, round(1 / size, 9)]
    # another length than the one asked for is no answer
    other = L.embedded(rows, "text", "v", f"{tmp_path}/two", lengths(f"{tmp_path}/log2"), 5)
    assert {len(r.v) for r in other.where("text is not null").collect()} == {5}
    assert L.embedded(rows.where("false"), "text", "v", f"{tmp_path}/none", lengths(f"{tmp_path}/log3"), 3).count() == 0
    assert not os.path.exists(f"{tmp_path}/log3")


def test_reranker_and_tokenizer(spark, tmp_path):
    questions = spark.createDataFrame([(1, "red fox"), (2, None)], "item_id int, text string")
    docs = spark.createDataFrame([(10, "red fox runs"), (11, "a fox"), (12, "bad red"), (13, None)], "doc_id int, text string")
    hits = questions.select("item_id").crossJoin(docs.select("doc_id"))

    def load():
        def model(pairs):
            if any("bad" in d for _, d in pairs):
                raise ValueError("bad")
            return [float(len(d)) for _, d in pairs]
        return model

    got = L.reranked(hits, questions, docs, "item_id", "doc_id", 3, f"{tmp_path}/r", load, 2)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.rerank) for r in got.collect()) == [
        (1, 1, 10, 12.0), (1, 2, 11, 5.0), (1, 3, 12, 0.5), (2, 1, 10, 0.0), (2, 2, 11, 0.0), (2, 3, 12, 0.0)]

    def words():
        return lambda texts: [None if "bad" in x else list(x) for x in texts]

    cut = L.tokenized(docs, "text", "words", f"{tmp_path}/w", words)
    assert {r.doc_id: r.words for r in cut.collect()} == {10: list("red fox runs"), 11: list("a fox"), 12: ["bad", "red"], 13: None}


def test_byte_number(spark):
    texts = ["", "a", "héllo", "ก" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {r.i: r.v for r in rows.select("i", L.byte_number(F.col("text")).alias("v")).collect()} == {i: [sum(x.encode()) % 100 / 100] for i, x in enumerate(texts)}


def test_filters_and_answers(spark, tmp_path):
    """Owners' filters; a question that is denied, one with no hit, a null one, and a text over the budget."""
    docs = spark.createDataFrame([(i, f"term{i % 5} word{i} e@x.org", "s", None, i, "me" if i % 2 else "you") for i in range(40)] + [(50, "term9 " + "long " * 3000, "s", None, 1, "me"), (51, "other text", "s", None, 1, None)],
                                 "doc_id long, text string, source string, path string, page int, owner string")
    questions = spark.createDataFrame([(1, "term1 word1"), (2, "hack term2"), (3, None), (4, "term9 long")], "item_id long, text string")
    mine = F.col("owner") == "me"
    found = R.hybrid(questions, docs, 12, where=mine).collect()
    assert found and all(r.doc_id % 2 or r.doc_id == 50 for r in found)
    assert {r.item_id for r in found} >= {1, 2, 4}
    say = lambda model, asked: F.concat(model, F.lit("|"), asked)
    got = {r.item_id: r for r in N.answered_questions(questions, docs, say, where=mine, budget=40).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[2].model == "deny" and got[2].answer == R.REFUSAL
    assert got[1].hits[0].doc_id == 1 and "[REDACTED_EMAIL]" in got[1].answer and "e@x.org" not in got[1].answer
    assert got[1].answer.startswith("B|") and "term1 word1" in got[1].answer and got[1].used_tokens <= 40 and got[1].n_blocks == len(got[1].cites.split("\n"))
    assert got[4].hits[0].doc_id == 50 and (got[4].n_blocks, got[4].used_tokens, got[4].cites) == (0, 0, "")
    none = {r.item_id: r for r in N.answered_questions(questions, docs.where("false"), say).collect()}
    assert {i: (r.n_blocks, r.hits) for i, r in none.items()} == {i: (0, None) for i in (1, 2, 3, 4)}
    assert N.answered_questions(questions.where("false"), docs, say).count() == 0
    assert {r.model for r in N.answered_questions(questions.where("item_id = 1"), docs, say, hint="A").collect()} == {"A"}
