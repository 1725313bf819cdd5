"""The short ways of cleaning, paragraphs and flags for plain texts give what the patterns give."""

import random

from pyspark.sql import functions as F

from docloom.functions import quality as Q
from docloom.functions import text as T
from docloom.operators import paragraphs as P


def test_plain_and_odd_texts(spark):
    rng = random.Random(3)
    plain = [*"abZ09..!?  \n\n-:()é", "-\n", " \n", "\n ", "- ", "1. "]
    odd = [*plain, "ก", "่", "\t", "\r", "\xa0", "​", " ", "\x85", " ", "\x01", "\x1c", "\x7f", "̀", "😀"]
    texts = ["".join(rng.choice(kind) for _ in range(rng.choice((1, 4, 12, 40)))) for kind in (plain, odd) for _ in range(1500)] + ["", "x \x85", "x  ", None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    x, bare = F.col("text"), F.coalesce("text", F.lit(""))
    crlf = F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = T._lines(T.nfc(crlf))  # the patterns, for every text
    cleaned = T.strip(T.tidy_thai(F.regexp_replace(F.regexp_replace(lines, "([A-Za-z0-9])-\\n([A-Za-z0-9])", "$1$2"), "\\n{3,}", "\n\n")))
    thai, latin = (F.regexp_count(x, F.lit(f"[{c}]")) for c in (T.THAI, "A-Za-z"))
    thai, latin = thai / F.greatest(thai + latin, F.lit(1)), latin / F.greatest(thai + latin, F.lit(1))
    label = F.when(thai >= 0.8, "th").when(latin >= 0.8, "en").when((thai >= 0.4) & (latin >= 0.2), "mixed").otherwise("unknown")
    pairs = {
        "clean": (T.clean_for_index(x), cleaned), "label": (Q.language_label(x), label), "sentences": (T.sentences(x), F.split(x, f"(?<=[{T.SENTENCE_END}])\\s+")),
        "strip": (T.strip_ascii(x), F.regexp_replace(x, "^\\s+|\\s+$", "")),
        "heading": (T.is_heading(x), F.regexp_replace(x, "^\\s+", "").rlike(T.HEADING)), "bullet": (T.is_bullet(x), F.regexp_replace(x, "^\\s+", "").rlike(T.BULLET)),
    }
    for name, (found, expected) in pairs.items():
        assert rows.select(x, found.alias("a"), expected.alias("b")).where("not (a <=> b)").head() is None, name


def test_flags_make_no_arrays_of_letters(spark):
    """each count of letters by pattern made an array of all letters, and the label asked for some six of them."""
    rows = spark.createDataFrame([("some text",)], "text string")
    plan = rows.select(Q.valid_ocr(F.col("text"), Q.language_label(F.col("text"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_pages_without_known_lines_are_not_split(spark):
    pages = spark.createDataFrame([("a", 1, " x \n\ny\n"), ("a", 2, None), ("b", 1, "")], "source string, page_no int, text string")
    assert sorted((r["source"], r["page_no"], r["body"], r["header"], r["footer"]) for r in P.strip_headers_footers(pages).collect()) == [("a", 1, " x \n\ny\n", None, None), ("a", 2, None, None, None), ("b", 1, "", None, None)]
