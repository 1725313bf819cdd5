"""File sources and sinks, the choice of page texts, boolean queries and the incremental ingest."""

import csv
import io
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docloom.functions.text import name_uuid, normalize_text
from docloom.operators import pages as G
from docloom.operators import retrieval as R
from docloom.sources import files as S
from docloom.operators.pages import alike, page_languages, similar
from docloom.streaming.ingest import ingest


def test_sheets(spark, tmp_path):
    (tmp_path / "a b+c.csv").write_text("h1,h2,h3\n x ,,y\n,,\nz,\"1,5\",\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.csv").write_text("h1\n")
    (tmp_path / "e.tsv").write_text("h\tk\n1\t2\n")
    rows = {r.source: r for r in S.sheet_pages(spark, str(tmp_path)).collect()}
    assert rows["a b+c.csv"].text == "x | y\nz | 1,5" and rows["a b+c.csv"].paragraphs == ["x | y\nz | 1,5"]
    assert set(rows) == {"a b+c.csv"}
    assert [r.text for r in S.sheet_pages(spark, str(tmp_path), "tsv").collect()] == ["1 | 2"]
    assert sorted(r.kind for r in S.binary_files(spark, str(tmp_path)).select("kind").collect()) == ["csv", "csv", "tsv"]


def test_long_sheet_keeps_its_order(spark, tmp_path):
    (tmp_path / "n.csv").write_text("h,k\n" + "".join(f"{i},v\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        text = S.sheet_pages(spark, str(tmp_path)).first().text
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert text.split("\n") == [f"{i} | v" for i in range(5000)]


def test_sheets_as_they_are(spark, tmp_path):
    """Breaks within cells, doubled and stray quotes, a byte-order mark and a legacy charset, in splits of any size, as the csv module has them."""
    rng = random.Random(4)
    cell = lambda: rng.choice(["", " ", "a", 'say "x"', '"', 'ends "', "two\nlines", "\n", "p,q", "ไทย", "x" * 50, 'a\n"b",\nc'])
    files = {f"f{n}.csv": [[cell() for _ in range(4)] for _ in range(rng.randint(0, 60))] for n in range(6)}
    for n, (name, rows) in enumerate(files.items()):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["h", "head\nline", "k", "m"]] + rows)
        (tmp_path / name).write_bytes(out.getvalue().encode(("utf-8", "utf-8-sig", "cp874")[n % 3]))
    (tmp_path / "stray.csv").write_text('h,k\n5" pipe,a\nb,6"\n"c\nd",e"f\n')
    files["stray.csv"] = [['5" pipe', "a"], ["b", '6"'], ["c\nd", 'e"f']]
    lines = {name: [" | ".join(c.strip() for c in r if c.strip()) for r in rows] for name, rows in files.items()}
    want = {name: text for name, x in lines.items() if (text := "\n".join(y for y in x if y))}
    for size in ("128m", "150", "40"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r.source: r.text for r in S.sheet_pages(spark, str(tmp_path)).where("text <> ''").collect()}
            strict = {r.source for r in S.sheet_pages(spark, str(tmp_path), legacy=None).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want
        assert not strict & {"f2.csv", "f5.csv"}


def test_extractor_and_jsonl(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "in" / "b.pdf").write_bytes(b"\xff")
    found = S.extracted_pages(S.binary_files(spark, str(tmp_path / "in")), lambda path, raw: raw.decode().split("\x0c"), "plain")
    assert sorted((r.source, r.page_no, r.text) for r in found.collect()) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    S.write_jsonl(found.drop("path"), str(tmp_path / "out"))
    (tmp_path / "out" / "bad.json").write_text("{no json\n")
    back = S.read_pages(spark, str(tmp_path / "out"))
    assert sorted((r.source, r.page_no, r.text, r.method) for r in back.collect()) == [("a.pdf", 1, "one", "plain"), ("a.pdf", 2, "two", "plain")]


def score(x):
    solid = [c for c in x if not c.isspace()]
    return sum(c.isalpha() or c.isdigit() for c in solid) / max(1, len(solid))


def test_best_of_two(spark):
    pairs = [("", ""), ("abc", ""), ("", "abc"), (None, "x"), ("a", None), ("ab##cd", "abcd"), ("#### ##", "quite another text"), ("abc", "xyz##"), ("#a#b#c#d#e", "abcde fgh ijk")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, first string, second string")
    got = {r.i: r.text for r in G.choose_ocr(rows, "first", "second").collect()}
    for i, (a, b) in enumerate((a or "", b or "") for a, b in pairs):
        want = (a if SequenceMatcher(None, a, b).ratio() >= 0.6 or score(a) >= score(b) else b) if a and b else a or b
        assert got[i] == want


def test_fallback(spark):
    good = "A page with a good and long enough layer of text in it."
    pages = spark.createDataFrame([(1, good, "layer"), (2, "", "layer"), (3, None, "layer"), (4, "short", "layer")], "page_no int, text string, method string")
    ocr = spark.createDataFrame([(1, "unused", None), (2, "read", None), (4, "  ", "")], "page_no int, first string, second string")
    got = {r.page_no: (r.method, r.text) for r in G.with_fallback(pages, ocr, ["page_no"]).collect()}
    assert got == {1: ("layer", good), 2: ("ocr", "read"), 3: ("layer", ""), 4: ("layer", "short")}


def test_boolean(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "Red hen"), (3, "blue fox"), (4, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, ["RED"], [], ["hen"]), (2, [], ["hen", "blue"], []), (3, [], [], ["red"]), (4, ["fox", "fox"], ["red", "blue"], None)], "item_id int, every array<string>, any array<string>, none array<string>")
    assert sorted(map(tuple, R.match_boolean(q, docs).collect())) == [(1, 1), (2, 2), (2, 3), (4, 1), (4, 3)]


def test_ingest_in_steps(spark, tmp_path):
    source, table, at = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "at")
    for ids in ([1, 2, 2], [2, 3], []):
        rows = spark.createDataFrame([(str(i), n, f"text {i}") for n, i in enumerate(ids)], "doc_id string, chunk_id long, text string")
        rows.coalesce(1).write.mode("append").json(source)
        ingest(spark, source, table, at).awaitTermination()
    got = spark.read.parquet(table)
    assert sorted((r.doc_id, r.text, r.batch) for r in got.select("doc_id", "text", F.col("batch")).collect()) == [("1", "text 1", 0), ("2", "text 2", 0), ("3", "text 3", 1)]


def test_composed_text(spark):
    rows = spark.createDataFrame([("cafe\u0301  x",), (None,)], "text string")
    assert [r[0] for r in rows.select(normalize_text(F.col("text"), compose=True)).collect()] == ["caf\u00e9 x", ""]


def test_name_based_ids(spark):
    import random
    import uuid

    rng = random.Random(1)
    names = ["".join(rng.choice("abcé |ทุน😀/:") for _ in range(rng.randrange(0, 40))) for _ in range(10_000)]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").orderBy("i").select(name_uuid(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_document_language_from_its_first_pages(spark):
    thai, latin = "ระเบียบการศึกษา " * 5, "Regulations of study " * 5
    pages = [("a", 1, thai), ("a", 2, thai + latin), ("a", 3, ""), ("a", 4, thai), ("b", 3, thai), ("b", 2, thai), ("b", 1, None), ("b", 4, latin), ("b", 5, "12"), (None, 9, latin)]
    rows = spark.createDataFrame(pages[::-1], "source string, page_no int, text string").repartition(3)
    got = {(r["source"], r["page_no"]): r["ocr_lang"] for r in page_languages(rows).collect()}
    both = {("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 4), (None, 9)}  # b's first three pages are Thai, its fifth goes with them
    assert {k for k, v in got.items() if v == "tha+eng"} == both and len(got) == len(pages)


def test_alike_equals_the_whole_ratio(spark):
    from difflib import SequenceMatcher
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 40)))
    pairs = [(w, w[: rng.randrange(len(w) + 1)] + word()) for w in (word() for _ in range(300))]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string").orderBy("i").select(alike(F.col("a"), F.col("b"), 0.6)).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() >= 0.6 for a, b in pairs]


def test_similar_is_the_ratio_and_takes_long_texts():
    import random
    import time
    from difflib import SequenceMatcher

    rng = random.Random(3)
    for alphabet in ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n", "".join(map(chr, range(3585, 3631))) + "".join(map(chr, range(300, 420)))):
        weights = [rng.random() ** 3 + 0.001 for _ in alphabet]
        for size in (30, 250, 900, 1500):
            a = "".join(rng.choices(alphabet, weights, k=size))
            b = list(a)
            for _ in range(size // 20):
                at = rng.randrange(len(b))
                b[at:at + rng.randrange(8)] = rng.choices(alphabet, weights, k=rng.randrange(8))
            b = "".join(b) + "#"
            ratio = SequenceMatcher(None, a, b).ratio()
            assert similar(a, b, ratio) and not similar(a, b, ratio + 1e-9)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz .,\n", [1, *range(1, 30)], k=60_000))
    started = time.monotonic()
    similar(text.replace("z", "#"), text, 0.9)
    assert time.monotonic() - started < 5
