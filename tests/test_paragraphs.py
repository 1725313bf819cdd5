"""The chunk fold against hand-derived cases."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import paragraphs as P
from docloom.plans import queries as core


def test_fold():
    assert P.fold_paragraphs([]) == []
    one = P.fold_paragraphs([(1, "a" * 40, False), (2, "b" * 40, False)])
    assert one == [{"text": "a" * 40 + "\n\n" + "b" * 40, "page_start": 1, "page_end": 2, "tokens_est": 21}]
    two = P.fold_paragraphs([(1, "a" * 40, False), (2, "b" * 40, True)])
    assert [c["text"] for c in two] == ["aaaa\n" + "a" * 40, "b" * 40]  # a heading closes, with its own tail before it
    two = P.fold_paragraphs([(1, "a" * 40, False), (2, "b" * 40, True)], compat=False)
    assert [c["text"] for c in two] == ["a" * 40, "aaaa\n" + "b" * 40]


@pytest.mark.parametrize("compat", [True, False])
def test_budget(compat):
    chunks = P.fold_paragraphs([(i, f"{i}" * 1000, False) for i in range(9)], compat=compat)
    assert len(chunks) == 3 and [(c["page_start"], c["page_end"]) for c in chunks] == [(0, 2), (3, 5), (6, 8)]


def test_long_paragraph_keeps_every_sentence_without_compat():
    text = " ".join(f"Sentence number {i} ends here." for i in range(400))
    whole = "".join(c["text"] for c in P.fold_paragraphs([(1, text, False)], overlap=0, compat=False))
    assert all(f"Sentence number {i} ends here." in whole for i in range(400))


def test_chunk_pages(spark):
    rows = core.queries()["chunk_pages"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) >= 10 and all(r.page_start <= r.page_end and r.tokens_est > 0 for r in rows)
    assert len({(r.conv_id, r.chunk) for r in rows}) == len(rows)


def plain_chunks(rows, **how):
    """The fold over whole groups in Python: rows of (group, place, page, text)."""
    import re

    from docloom.functions.text import BULLET, HEADING

    out = {}
    for g in {r[0] for r in rows}:
        paras, bullets = [], False
        for _, _, page, text in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            text = (text or "").strip()
            if not text:
                continue
            bullet = bool(re.search(BULLET, text))
            if bullet and bullets:
                paras[-1] = (paras[-1][0], paras[-1][1] + "\n" + text, paras[-1][2])
            else:
                paras.append((page, text, bool(re.search(HEADING, text))))
            bullets = bullet
        for i, c in enumerate(P.fold_paragraphs(paras, **how)):
            out[g, i] = (c["text"], c["page_start"], c["page_end"], c["tokens_est"])
    return out


def paragraphs_of(rng, groups, n):
    line = lambda k: " ".join(rng.choice(["word", "ending.", "more!", "ทุน", "x" * 30]) for _ in range(k))
    kinds = [lambda: "1.2. " + line(4), lambda: "- " + line(6), lambda: "- " + line(90), lambda: line(rng.randrange(1, 80)), lambda: line(700), lambda: "y" * 9000, lambda: "  ", lambda: None]
    return [(rng.choice(groups), i, i // 7, rng.choices(kinds, [3, 4, 1, 9, 1, 0.3, 1, 1])[0]()) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"compat": False}, {"batch": True}, {"most": 90}])
def test_stream_equals_the_fold(spark, tmp_path, how):
    rng = random.Random(len(how) + 7)
    rows = paragraphs_of(rng, ["a", "b", "b", "b", None, "c"], 1500) + [("one", 0, 3, "2. "), ("head", 0, 1, "1. Only a heading"), ("blank", 0, 1, " ")]
    made = spark.createDataFrame(rows, "g string, place long, page int, text string").repartition(7)
    got = {(r["g"], r["chunk"]): tuple(r)[2:] for r in P.chunks(made, "g", "place", "page", path=f"file://{tmp_path}", **how).collect()}
    assert got == plain_chunks(rows, **how)
    assert P.chunks(made.limit(0), "g", "place", "page", path=f"file://{tmp_path}/none", **how).count() == 0


def test_one_source_of_many_paragraphs_is_many_stretches(spark, tmp_path):
    n = 100_000
    rows = spark.range(n).select(F.lit("s").alias("g"), F.col("id").alias("place"), (F.col("id") / 50).cast("int").alias("page"), F.when(F.col("id") % 40 == 0, F.concat(F.lit("1.2. h "), "id")).otherwise(F.concat(F.lit("paragraph "), "id")).alias("text"))
    got = P.chunks(rows, "g", "place", "page", path=f"file://{tmp_path}")
    assert got.count() == n // 40 and got.agg(F.max("chunk")).first()[0] == n // 40 - 1
    assert spark.read.parquet(f"file://{tmp_path}/chunks/folded").select("segment").distinct().count() == n // 40  # what the tasks share
    first = got.where("chunk = 1").first()
    assert first["page_start"] == 0 and "1.2. h 40" in first["text"] and "paragraph 79" in first["text"]
