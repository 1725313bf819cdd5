"""Operators whose results are fixed: brute force, round trips and DuckDB."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, decontam, line_dedup, near_dup, packing, queries, quality_rules, suffix, warc

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile("[^\\x20\\x09-\\x0D]+").findall
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two"), (9005, "one two"), (9006, "Ünï ŒÀ \x1c x y <|endoftext|> Σας"), (None, "no id " * 30), (9008, "long word " * 30_000), (9009, "same\n" * 3)]


def with_odd(spark):
    """The documents, rows of every unusual kind, a repeated row, and columns with clashing names."""
    odd = spark.createDataFrame(ODD + [ODD[3]], "doc_id long, text string")
    return documents(spark).select("doc_id", "text").unionByName(odd).withColumn("h1", F.lit(1)).withColumn("key", F.lit("k")).withColumn("score", F.lit(0.5)).withColumn("n_words", F.lit(3))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.select(",".join(cols)).fetchall()))


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = with_odd(spark).select("doc_id", "text").collect()
    pieces = packing.pack_documents(with_odd(spark).repartition(3), path).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        raw = b"".join(i.to_bytes(4, "little") for i in ids[p.doc_id][p.start:p.start + p.length])
        assert len(raw) == 4 * p.length and zlib.crc32(raw) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    for d, ps in by_doc.items():
        copies = 2 if d == 9004 else 1
        assert sum(p.length for p in ps) == copies * len(ids[d])
        if copies == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    short = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        short += at < 2048
    assert short <= 3 and set(by_doc) == set(ids)
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    import public_tokenizers

    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    every = [f"a{chr(c)}b '{chr(c)}1 {chr(c)}{chr(c)}'s" for c in [*range(0, 0x3000), *range(0xA000, 0xD800, 3), *range(0xE000, 0x10000, 3), *range(0x10000, 0x20000, 7), *range(0x20000, 0x110000, 997)]]
    blocks = [(32, 127), (0xA0, 0x250), (0x300, 0x530), (0x590, 0x700), (0x900, 0x1000), (0xE00, 0xE80), (0x1E00, 0x2C00), (0x3000, 0x3100), (0xA640, 0xAB70), (0xFF00, 0xFFF0), (0x1F300, 0x1F700), (0x10000, 0x10D60)]
    mixed = ["".join(chr(rng.randrange(*rng.choice(blocks))) if rng.random() < 0.8 else rng.choice([" ", "'s", "\n", "\u0130", "'LL", "\u03a3 ", "<|endoftext|>", "\x1e"]) for _ in range(rng.randrange(60))) for _ in range(5000)]
    for texts in (every, mixed, ["", " ", "'" + "\u209f", "x" * 100_000]):
        want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [x for x, w, g in zip(texts, want, encode(texts)) if w.ids != g.tolist()] == []


def shingles(text, n):
    w = WORD((text or "").translate(ASCII))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(60)) for _ in range(120)]
    drift = []
    for i in range(60):  # a family whose neighbours are near and whose ends are not
        base[rng.randrange(120)] = f"x{i}"
        drift.append((8000 + i, " ".join(base)))
    df = with_odd(spark).unionByName(spark.createDataFrame(drift, "doc_id long, text string"), allowMissingColumns=True)
    rows = [r for r in df.select("doc_id", "text").collect()]
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            sets[r.doc_id] = shingles(r.text, width)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = near_dup.near_duplicates(df, width, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
        else:
            assert r.component_id is None and r.kept
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_line_dedup(spark):
    df = with_odd(spark)
    line = "A line that three documents hold"
    more = [(7000 + i, f"own {i}\n {line}\t\n{line.upper()}\nend") for i in range(3)] + [(7100 + i, "only two documents hold it") for i in range(2)]
    df = df.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = df.select("doc_id", "text").distinct().collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    docs = {}
    for r in rows:
        if r.doc_id is not None:
            for x in (r.text or "").split("\n"):
                docs.setdefault(key(x), set()).add(r.doc_id)
    gone = {k: max(v) for k, v in docs.items() if len(k) >= 20 and len(v) >= 3}
    assert gone[line.translate(ASCII)] == 7002
    got = {}
    out = line_dedup.drop_repeated_lines(df)
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.text))
    assert sum(map(len, got.values())) == df.count() and out.columns[:len(df.columns)] == df.columns
    for r in rows:
        lines = (r.text or "").split("\n")
        stay = [x for x in lines if r.doc_id is None or gone.get(key(x), r.doc_id) == r.doc_id]
        for n, dropped, text in got[r.doc_id]:
            assert (n, dropped, text or "") == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_line_runs(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}", fan=2)
    batch = lambda *rows: line_dedup.exploded(spark.createDataFrame(rows, "doc_id long, text string"), "text", 3, F.col("doc_id"))
    assert runs.unseen(batch((1, "aaa\nbbb"))).count() == 2
    for i, rows in enumerate([[(1, "aaa\nbbb")], [(2, "bbb\nccc")], [(3, "bbb")]]):
        runs.add(batch(*rows).select("doc_id", "h1", "h2"))
        assert [len(x) for x in runs.levels] == [[1], [0, 1], [1, 1]][i]
    assert sorted((r.n_docs, r.last_doc) for r in runs.merged().collect()) == [(1, 1), (1, 2), (3, 3)]
    assert runs.unseen(batch((9, "ccc\nddd"))).count() == 1


def test_warc(spark, tmp_path):
    body = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 4
    rows = [(1, "http://a b", "x" * 100), (2, None, "x" * 100), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", body), (8, "u", "é\r\n\r\n" * 50), (9, "u", body), (10, "u", "WARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("value", F.lit(2))
    got = {r.record_id: r for r in warc.round_trip(pages.repartition(2), f"file://{tmp_path}").collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r = got[f"<urn:page:{i}>"]
        first = {2: 1, 9: 7}.get(i)
        assert r.record_type == ("revisit" if first else "response") and r.refers_to == (f"<urn:page:{first}>" if first else None)
        assert r.payload_digest == "sha256:" + hashlib.sha256((html or "").encode()).hexdigest()
        assert r.block == ("" if first else warc.HTTP + (html or ""))
    # the same files in many small splits; null and repeated ids, a long page, and copies of both
    long = body * 3 + "z" * 300_000
    odd = rows + [(None, "u", "y" * 200), (None, "u", "y" * 200), (11, "u", "y" * 200), (11, "u", "y" * 200), (12, "u", long), (13, "u", long), (14, "u", "WARC/1.1\r\n" * 40), (15, "u", "\r\n\r\n")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [(r.record_id, r.record_type, r.refers_to, r.block) for r in warc.round_trip(pages.coalesce(1), f"file://{tmp_path}/splits").collect()]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    first = {2: 1, 9: 7, 13: 12}
    want = [(f"<urn:page:{i}>" if i is not None else None, "revisit" if i in first else "response", f"<urn:page:{first[i]}>" if i in first else None, "" if i in first else warc.HTTP + (html or "")) for i, _, html in odd]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, f"file://{tmp_path}/none").count() == 0


def test_suffix(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, tail = words(80), words(49)
    own = {i: words(rng.randrange(60, 200)) for i in range(1, 30)}
    at = {}
    for i in range(1, 12):  # in some documents the passage stands at the start or the end
        cut = {1: 0, 2: len(own[2])}.get(i, 25)
        at[i] = cut
        own[i] = own[i][:cut] + passage + own[i][cut:]
    own[20], own[21] = own[20] + tail, own[21] + tail  # one word too short
    own[30] = list(own[15])
    rows = [(i, " ".join(w)) for i, w in own.items()] + [(40, None), (41, ""), (42, "few words"), (42, "few words"), (None, " ".join(own[3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("anchor", F.lit(1))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix.repeated_passages(df.repartition(4)).collect()}
    want = {i: [(at[i], at[i] + 80)] for i in at} | {15: [(0, len(own[15]))], 30: [(0, len(own[15]))]}
    assert got.keys() == want.keys()
    for i in want:  # chance may lengthen a span by a word
        assert len(got[i]) == 1 and got[i][0][0] <= want[i][0][0] and got[i][0][1] >= want[i][0][1] and got[i][0][1] - got[i][0][0] <= want[i][0][1] - want[i][0][0] + 4
    assert suffix.repeated_passages(empty(spark)).count() == 0


def repeated_words(rows, min_words):
    """Words by document that lie in ``min_words`` words which another document has too."""
    words, holders = {}, {}
    for d, text in rows:
        if d is not None:
            words.setdefault(d, []).append(WORD((text or "").translate(ASCII)))
    for d, texts in words.items():
        for x in texts:
            for i in range(len(x) - min_words + 1):
                holders.setdefault(tuple(x[i:i + min_words]), set()).add(d)
    return {d: got for d, texts in words.items() if (got := {i + j for x in texts for i in range(len(x) - min_words + 1) if len(holders[tuple(x[i:i + min_words])]) > 1 for j in range(min_words)})}


def test_suffix_finds_every_repeat(spark):
    """All common passages of random texts with repeats inside documents, against brute force."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    passage = words(200)  # five times in one document, once in another
    rows.append((1, sum((words(60) + passage for _ in range(5)), [])))
    rows.append((2, words(30) + passage + words(10)))
    # the longest match to the left and that to the right are of different documents
    middle = words(120)
    rows += [(3, words(20) + middle + words(20)), (4, words(40) + middle[:90]), (5, middle[30:] + words(9)), (6, words(7) + middle[20:80] + words(3)), (7, middle[25:76]), (8, middle[40:95]), (9, words(5) + middle[33:83] + words(5))]
    pool = [words(rng.randrange(20, 150)) for _ in range(12)]
    for d in range(20, 90):
        text = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.choice(pool)
            a = rng.randrange(len(x))
            text += x[a:a + rng.randrange(10, 150)] + words(rng.randrange(0, 12))
        rows.append((d, text * rng.choice((1, 1, 1, 2))))
    rows += [(90, middle + words(20_000) + passage), (91, ["same"] * 400), (92, words(3) + ["same"] * 300)]  # long ones, and one word over and over
    rows += [(93, passage[:70]), (93, words(30) + middle[:55])]  # two texts with one id
    rows = [(d, " ".join(x)) for d, x in rows] + [(94, None), (95, ""), (None, " ".join(middle))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("kind", F.lit(1)).repartition(5)
    for min_words, k in ((50, 12), (30, 8)):
        got = {r.doc_id: {w for s in r.spans for w in range(s.start, s.end)} for r in suffix.repeated_passages(df, min_words, k).collect()}
        want = repeated_words(rows, min_words)
        assert got.keys() == want.keys()
        assert {d: sorted(got[d] ^ want[d]) for d in want if got[d] != want[d]} == {}


def test_suffix_exact_step(spark):
    """A partner behind more suffixes than are compared in both orders, none of which has a whole passage in common."""
    rng = random.Random(5)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    least = lambda m: int(suffix.minimisers(suffix._hashes(" ".join(m)), 12, 1)[1][0])
    rows = []
    for c in range(3):
        middle, left, right = min((words(12) for _ in range(3000)), key=least), words(38), words(38)
        some = 2 * suffix.FARTHER
        rows += [left + middle + right, words(9) + left[-20:] + middle + right[:24] + words(9)]
        rows += [words(40) + middle + right[:30] + words(20) for _ in range(some)] + [words(20) + left[-30:] + middle + words(40) for _ in range(some)]
    rows = [(d, " ".join(x)) for d, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: {w for s in r.spans for w in range(s.start, s.end)} for r in suffix.repeated_passages(df).collect()}
    assert len(got) == 6 and got == repeated_words(rows, 50)


def test_quality_statistics(spark):
    rows = [r for r in with_odd(spark).select("doc_id", "text").collect()]
    numbers = lambda **more: sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(with_odd(spark), **more).collect())
    got = numbers()
    want = []
    for r in rows:
        text = r.text or ""
        w = WORD(text)
        seen, dup = set(), 0
        for x in text.split("\n"):
            if WORD(x):
                dup += x in seen
                seen.add(x)
        places = {}
        for i in range(len(w) - 2):
            places.setdefault(tuple(w[i:i + 3]), []).append(i)
        again = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
        want.append((r.doc_id or -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)))
    assert got == sorted(want)
    assert numbers(hash_bits=3) == got  # equal hashes of different windows
    assert quality_rules.statistics(empty(spark)).count() == 0


def test_quality_fit_without_classes(spark):
    docs = documents(spark).select("doc_id", "text")
    marks = lambda *rows: spark.createDataFrame(rows, "doc_id long, quality int")
    assert quality_rules.fit(docs, marks((None, 1)).where("false")) == []
    assert quality_rules.fit(docs, marks((1, 0), (2, None), (None, 0))) == []
    assert quality_rules.fit(empty(spark), marks((1, 0), (2, 1))) == []


def test_decision_list():
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        f = {k: rng.random() for k in quality_rules.FEATURES}
        rows.append((f, f["symbol_rate"] > 0.7 and f["upper_rate"] > 0.5))
    rules = quality_rules.learn(rows)
    wrong = sum(bad != any(all(c.holds(f) for c in rule) for rule in rules) for f, bad in rows)
    assert rules and wrong < 20
    two = [(f, f["symbol_rate"] > 0.8 or f["digit_rate"] < 0.15) for f, _ in rows]
    found = quality_rules.learn(two)
    assert len(found) > 1 and sum(bad != any(all(c.holds(f) for c in rule) for rule in found) for f, bad in two) < 20
    # a rule that fails at first does not keep the next ones from being found
    noise = [(f, rng.random() < 0.5 if f["mark_rate"] > 0.6 else f["digit_rate"] < 0.12) for f, _ in rows]
    found = quality_rules.learn(noise)
    caught = [any(all(c.holds(f) for c in rule) for rule in found) for f, bad in noise if f["digit_rate"] < 0.1 and f["mark_rate"] <= 0.6]
    assert sum(caught) > 0.8 * len(caught)
    assert quality_rules.learn([]) == [] and quality_rules.learn([(rows[0][0], False)] * 9) == []


QUESTION = "A farmer named Alice sold 48 apples in April and then sold half as many apples in May to Robert so how many apples did Alice sell altogether"
LEAK = QUESTION.replace("Alice", "Brenda").replace("48", "72").replace("Robert", "Simon")


def test_decontamination(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(f"q{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    bad = QUESTION.replace("did Alice", "did Brenda")  # one slot stands against two
    docs = [(1, fill(30) + " " + QUESTION + " " + fill(9)), (2, fill(31) + ". " + LEAK + " " + fill(9)), (3, fill(100)), (4, None), (5, ""), (6, LEAK), (7, LEAK), (7, LEAK), (None, LEAK), (8, fill(4) + " What is the largest ocean? " + fill(5)), (9, fill(3) + " " + " ".join(QUESTION.split()[:8]))]
    items = [(0, QUESTION), (1, "What is the largest ocean"), (2, None), (3, ""), (0, QUESTION), (None, QUESTION)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).withColumn("h", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("t", F.lit(5))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 0), (2, 0), (6, 0), (7, 0), (8, 1)}
    whole = spark.createDataFrame([(1, bad)], "doc_id long, text string")
    runs = decontam.contaminated(whole, bench).collect()
    assert [(r.item_id, r.at_word, r.run_words) for r in runs] == [(0, 0, 25)]  # up to the contradiction
    long = spark.createDataFrame([(1, fill(30_000) + " " + LEAK + " " + fill(30_000))], "doc_id long, text string")
    assert [(r.item_id, r.at_word) for r in decontam.contaminated(long, bench).collect()] == [(0, 30_000)]
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(df, bench.where("false")).count() == 0


def test_decontamination_stretches(spark):
    name = QUESTION.replace("did Alice", "did Brenda")  # the words before it are verbatim
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    item[10], item[50] = "5", "5"
    edit = ["7" if i == 10 else w for i, w in enumerate(item)]
    problem = "Carla has 3 red pens. Diego buys 9 pens more. Carla gives 2 to Diego. Elena takes 4 of them. Diego loses one."
    other = problem.replace("Carla", "Paula").replace("Diego", "Simon").replace("Elena", "Wanda").replace("9", "8")
    swapped = problem.replace("Carla gives", "Diego gives")
    docs = [(1, name), (2, " ".join(edit)), (3, other), (4, swapped), (5, " ".join(edit[11:50])), (6, "Tina has 8 plums in June"), (7, "Tina has 8 plums on June")]
    items = [(0, QUESTION), (1, " ".join(item)), (2, problem), (3, "Ralph has 2 plums in May")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.at_word, r.run_words) for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 0): (0, 25), (2, 1): (0, 50), (3, 2): (0, 23), (4, 2): got.get((4, 2)), (5, 1): (0, 39), (6, 3): (0, 6)}
    assert got[4, 2][1] < 23


def agrees(doc, item, least, close):
    """Whether two runs of words (lower-case words and numbers) share a stretch by the contract, by every alignment;
    ``close``: the literals stand within ``least`` words."""
    for shift in range(-len(item) + 1, len(doc)):
        for start in range(max(0, -shift), min(len(item), len(doc) - shift)):
            there, back, literals, same = {}, {}, 0, True
            for n, k in enumerate(range(start, min(len(item), len(doc) - shift)), 1):
                d, i = doc[k + shift], item[k]
                if d.isdigit() != i.isdigit() or (not d.isdigit() and d != i):
                    break
                if d.isdigit():
                    if there.setdefault(i, d) != d or back.setdefault(d, i) != i:
                        break
                    same = same and d == i
                else:
                    literals += 1
                if n >= least and (literals >= 3 or same):
                    return True
                if close and n == least:
                    break
    return False


def test_decontamination_by_every_alignment(spark):
    """Items rich and poor in literals, long and short, copied whole, in part, with other numbers or with errors."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("bdfgkmnpqrtvxz") for _ in range(5))
    item = lambda n, numbers: [str(rng.randrange(100)) if rng.random() < numbers else word() for _ in range(n)]
    items = [item(rng.randrange(5, 31), rng.choice([0.1, 0.4, 0.8, 1])) for _ in range(40)] + [["7"] * 14, [str(i) for i in range(14)], ["5"], ["4", "4"]]
    docs = []
    for _ in range(300):
        own = list(rng.choice(items))
        kind = rng.randrange(5)
        if kind == 1:  # other numbers, consistently
            other = {x: str(int(x) + 100) for x in own if x.isdigit()}
            own = [other.get(x, x) for x in own]
        elif kind == 2:  # one number otherwise
            own = [str(rng.randrange(100)) if x.isdigit() and rng.random() < 0.1 else x for x in own]
        elif kind == 3:
            own[rng.randrange(len(own))] = word()
        elif kind == 4:
            own = own[rng.randrange(3):len(own) - rng.randrange(3)]
        docs.append(item(rng.randrange(0, 20), 0.3) + own + item(rng.randrange(0, 20), 0.3))
    want, most = ({(d, i) for d, x in enumerate(docs) for i, y in enumerate(items) if len(y) >= 3 and agrees(x, y, min(13, len(y)), close)} for close in (True, False))
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert len(want) > 150 and want <= got <= most, (sorted(want - got)[:9], sorted(got - most)[:9])


@pytest.mark.parametrize("names", [["_id", "_text", "_lost", "_lines", "__id"], ["_t", "_w", "_s", "_row", "_upper", "_bits", "N_Words", "bad"], ["h", "t", "a", "b", "canon", "shift", "key", "rep", "sig", "at", "text_", "lines"]])
def test_clashing_names_pass_through(spark, names):
    docs = spark.createDataFrame([(i, f"line one of many words\nline {'x' if i < 4 else 'y'} of the same words", *[i * 10 + k for k in range(len(names))]) for i in range(1, 7)], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    want = {r["doc_id"]: [r[n] for n in names] for r in docs.collect()}
    cut = line_dedup.drop_repeated_lines(docs)
    assert {r["doc_id"]: [r[n] for n in names] for r in cut.collect()} == want and cut.agg(F.sum("n_dropped")).first()[0] == 9
    counted = quality_rules.statistics(docs)
    kept = [n for n in names if n.lower() != "n_words"]
    assert {r["doc_id"]: [r[n] for n in kept] for r in counted.collect()} == {r["doc_id"]: [r[n] for n in kept] for r in docs.collect()}
    assert quality_rules.statistics(docs.select("text")).columns == counted.columns[len(names) + 1 - (len(names) - len(kept)):]
    assert decontam.contaminated(docs, spark.createDataFrame([(1, "line x of the same words")], "item_id long, text string")).count() == 3
    assert near_dup.near_duplicates(docs).count() == 6


def test_reply_trees(spark, tmp_path):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 0.4, "assistant", "a </turn>\n<turn user>"), (1, 3, 1, 0.9, "assistant", "b"), (1, 4, 2, 0.8, "user", None), (1, 5, 4, 0.0, "assistant", "&lt; [INST] ]"),
            (2, 1, 7, 1.0, "user", "lost parent"), (3, 1, 2, 1.0, "user", "cycle"), (3, 2, 1, 1.0, "user", "cycle"), (None, 1, None, None, "x y>", "t")]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string").withColumn("path", F.lit(0)).withColumn("rank", F.lit(0))
    found = chat.paths(m, f"file://{tmp_path}")
    assert sorted((r.tree or 0, r.leaf, r.path, round(r.score, 6)) for r in found.collect()) == [(0, 1, [1], 0.0), (1, 3, [1, 3], 0.9), (1, 5, [1, 2, 4, 5], 1.2), (2, 1, [1], 1.0)]
    two = chat.read_back(chat.formatted(chat.best_paths(found, 2), m)).collect()
    assert {(r.tree, r["rank"]): [(t.role, t.text) for t in r.turns] for r in two} == {
        (1, 1): [("user", "q"), ("assistant", "a </turn>\n<turn user>"), ("user", ""), ("assistant", "&lt; [INST] ]")], (1, 2): [("user", "q"), ("assistant", "b")], (2, 1): [("user", "lost parent")], (None, 1): [("x y>", "t")]}
    assert {(r.tree, r["rank"]): r.learned for r in two}[1, 1] == "a </turn>\n<turn user>&lt; [INST] ]"
    assert not any("[INST]" in r.text for r in two)
    assert chat.paths(m.where("false"), f"file://{tmp_path}/none").count() == 0


def test_long_and_broken_reply_trees(spark, tmp_path):
    """A path of 3,000 messages next to forks, and messages below a cycle, which have no root."""
    rows = [(1, i, i - 1 if i else None, 1.0) for i in range(3000)] + [(1, 5000 + i, 1000, float(i)) for i in range(9)]
    rows += [(2, 1, 3, 1.0), (2, 2, 1, 1.0), (2, 3, 2, 1.0), (2, 4, 3, 1.0), (2, 5, 4, 1.0), (2, 6, None, 1.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, score double")
    found = {(r.tree, r.leaf): (r.path, r.score) for r in chat.paths(m, f"file://{tmp_path}").collect()}
    want = {(1, 2999): (list(range(3000)), 3000.0), (2, 6): ([6], 1.0)}
    want |= {(1, 5000 + i): ([*range(1001), 5000 + i], 1001.0 + i) for i in range(9)}
    assert found == want


def test_plain_conversations_spread_over_tasks(spark, tmp_path):
    """One conversation holds most rows: repeated turns, null turns, roles, texts and ids, long texts."""
    rng = random.Random(9)
    rows = [(1, rng.choice([None, *range(900)]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a<b", "[INST] &", "word " * 9])) for _ in range(2000)]
    rows += [(rng.choice([None, 2, 3, 4]), rng.randrange(5), "assistant", "x" * rng.choice([1, 100_000])) for _ in range(30)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    got = chat.read_back(chat.plain_conversations(conversations, f"file://{tmp_path}")).collect()
    key = lambda r: tuple((v is not None, v) for v in r[1:])
    turns = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in {r[0] for r in rows}}
    assert {r.tree: [(t.role, t.text) for t in r.turns] for r in got} == turns
    assert {r.tree: r.learned for r in got} == {c: "".join(t for role, t in x if role == "assistant") for c, x in turns.items()}
