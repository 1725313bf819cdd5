"""Conversation repair, filter audit and the attention classifier: brute force, SQL, unusual rows."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontam, filter_audit, packing, quality_mil, repair
from docloom.llm.common import work_dir

WORD = re.compile("[^\\x20\\x09-\\x0D]+").findall


def cheapest(rows):
    """(cost, audit) by trying every edit; rows of (initial, fault)."""

    @functools.cache
    def rest(i, done, inserts):
        ways = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", done):
                ways.append((0, ""))
        else:
            role, fault = rows[i]
            edits = [("D", 4, done)]
            if fault in (repair.OK, repair.CUT):
                more = 3 * (fault == repair.CUT)
                edits += [("K", more, done + role), ("R", 3 + more, done + "u"), ("R", 3 + more, done + "a")]
            for letter, cost, now in edits:
                if re.fullmatch("s?(ua)*u?", now) and (c := rest(i + 1, now, 2)):
                    ways.append((cost + c[0], letter + c[1]))
        if inserts:
            for x in "ua":
                if re.fullmatch("s?(ua)*u?", done + x) and (c := rest(i, done + x, inserts - 1)):
                    ways.append((3 + c[0], "I" + c[1]))
        return min(ways, default=None)

    return rest(0, "", 2)


def test_solver_against_every_edit():
    rng = random.Random(5)
    for n in range(7):
        for _ in range(60):
            sign = "".join(rng.choice("0123456789abcdef" if n < 5 else "4567889a") for _ in range(n))
            assert repair.solve(sign) == cheapest(tuple(repair.signs(sign))), sign


def test_solver_of_a_long_conversation():
    cost, audit = repair.solve("48" * 50_000 + "4")
    assert cost == 3 and audit == "K" * 100_001 + "I"


def odd_conversations(spark):
    rng = random.Random(3)
    rows = [(None, 0, "user", "no id."), (None, 1, "assistant", "none"), (7, None, None, None), (7, None, "user", "Null turn first?"), (7, 3, "assistant", "yes."), (7, 3, "assistant", "yes."), (8, 0, "", ""), (9, 5, "system", " \t"), (9, 5, "über", "ünïcode.")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", "unknown"]), rng.choice(["Yes.", "No!", "half of", "  ", "why? ", "long " * 3000 + "."])) for c in range(20, 90) for t in rng.sample(range(12), rng.randrange(1, 9))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(9000)]  # over several stretches
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("x")).withColumn("id", F.lit(1)).withColumn("audit", F.lit("K")).withColumn("h1", F.lit(2))


def repaired_plainly(rows):
    """The whole result in Python, from the contract alone."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "))
        left = []
        for _, turn, role, text in own:
            role, text = (" " if x is None else x for x in (role, text))
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            left += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in left:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        sign = "".join("%x" % (4 * ("sua".index(r[1][0]) if r[1] and r[1][0] in "sua" else 3) + ["", "blank", "duplicate", "truncated"].index(f)) for r, f in zip(left, faults))
        cost, audit = repair.solve(sign)
        said, i, state = [], 0, ""
        for e in audit:
            given = "assistant" if state.endswith("u") else "user"
            if e == "I":
                said.append(f"{given}:")
            elif e != "D":
                said.append(f"{given if e == 'R' else left[i][1]}:{left[i][2]}")
            state += said[-1][0] if e != "D" else ""
            i += e != "I"
        assert re.fullmatch("(s?(ua)+)?", state) and i == len(left)
        turns = [t for t, _, _ in left if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_of_unusual_rows(spark, tmp_path):
    rows = odd_conversations(spark)
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == repaired_plainly([tuple(r)[:4] for r in rows.collect()])
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet' where conv_id is distinct from 1000")
    want = {r[0]: tuple(r)[1:] for r in con.sql(repair.SQL).fetchall()}
    assert {k: v for k, v in got.items() if k != 1000} == want
    rows.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert repair.op11_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_repaired_turns(spark):
    work = work_dir(spark)
    rows = repair.ordered(repair.keyed(spark.createDataFrame([(1, 0, "user", "Q?"), (1, 1, "user", "and"), (1, 2, "assistant", "A."), (1, 3, "assistant", "A.")], "conv_id long, turn long, role string, text string")), work)
    plans = repair.audits(rows, work)
    assert plans.select("audit", "cost").collect() == [("KDKD", 8)]
    assert [tuple(r) for r in repair.replayed(rows, plans).collect()] == [("1", 0, "K", "user", "Q?"), ("1", 1, "K", "assistant", "A.")]


def audited_plainly(docs, labels):
    least, out = {}, {}
    for i, _, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for i, source, text in docs:
        text = text or ""
        words = WORD(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        for order in map("".join, itertools.permutations("ABCDE")):
            first = next((k for k, c in enumerate(order) if fails[c]), 5)
            for k, c in enumerate(order):
                row = out.setdefault((source or "", order, k + 1), [0] * 7)
                for j, x in enumerate((first > k, first == k, first < k and fails[c], fails[c] and sum(fails.values()) == 1, first == k and i in good, first == k and i in toxic)):
                    row[j] += x
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row[:6], total[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_filter_audit(spark, tmp_path):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [None, "", " \n", "#", long, long, "UP " * 60, *[" ".join(rng.choice(["a", "B", "c|", "d%", f"x{rng.random()}", f"y{rng.random()}"]) for _ in range(rng.randrange(30, 90))) for _ in range(30)]]
    docs = [(i, rng.choice([None, "", "s1", "s1", "s2"]), rng.choice(texts)) for i in range(120)] + [(None, "s1", "#"), (None, None, None), (5, "s1", texts[8]), (5, "s1", texts[8])]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    made = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3).withColumn("h1", F.lit(1)).withColumn("fails", F.lit(3)).withColumn("part", F.lit("p")).withColumn("good", F.lit(True)).withColumn("least", F.lit(0))
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.op12_filter_audit(spark, str(tmp_path)).collect()}
    want = audited_plainly(docs, labels)
    assert got == want and len(got) == 3 * 600
    made.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert filter_audit.op12_filter_audit(spark, f"{tmp_path}/none").count() == 0


def test_attention_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_mil.op13_quality_attention(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    held = [(r["quality"], r["predicted"], r["score"]) for r in rows.where("held_out").collect()]
    right = sum(q == p for q, p, _ in held) / len(held)
    bad, good = [s for q, _, s in held if q == 0], [s for q, _, s in held if q == 1]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    print("held out", len(held), "right", right, "auc", auc)
    assert right >= 0.9 and auc >= 0.9


def bag(text):
    (_, stretches), = quality_mil.bags([text])
    return np.concatenate(list(stretches))


def test_passages_do_not_depend_on_how_texts_are_cut(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n ", "one", *[" ".join(rng.choice(["Über", "the", "THE!!", "a$$$", "12", "|", "…", "x" * 300]) for _ in range(n)) for n in (1, 47, 48, 49, 96, 500, 3000)], "y" * 20_000, "  lead and trail \n"]
    whole = [bag(t) for t in texts]
    together = dict((i, np.concatenate(list(s))) for i, s in quality_mil.bags(texts))
    monkeypatch.setattr(quality_mil, "STRETCH", 900)
    cut = [bag(t) for t in texts]
    for i, t in enumerate(texts):
        n = len(WORD(t or ""))
        assert len(whole[i]) == max(1, -(-n // quality_mil.PASSAGE))
        assert np.allclose(whole[i], together[i]) and np.allclose(whole[i], cut[i])


def test_attention_learns_which_passage_decides(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    plain = lambda: " ".join(word() for _ in range(48))
    junk = lambda: " ".join(word() + "$$$" for _ in range(48))
    made = []
    for i in range(400):
        parts = [plain() for _ in range(rng.randrange(2, 12))]
        if i % 3 == 0:
            parts[rng.randrange(len(parts))] = junk()
        made.append((" ".join(parts), float(i % 3 != 0)))
    model = quality_mil.learn([(bag(t), y) for t, y in made[:300]])
    scores = [model.score_bag(iter([bag(t)])) for t, _ in made[300:]]
    assert sum((s >= 0.5) == (y == 1) for s, (_, y) in zip(scores, made[300:])) >= 97
    _, weight = model.encode(np.concatenate([bag(plain()) for _ in range(9)] + [bag(junk())]))
    assert weight.argmax() == 9  # the odd passage gets the attention
    rows = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, made[0][0]), (3, made[1][0] * 400)], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("__text", F.lit("t"))
    got = model.score(rows, ["doc_id"]).collect()
    assert len(got) == 5 and got[0] == got[1] and got[0]["score"] == got[2]["score"]
    assert model.score(rows.limit(0), ["doc_id"]).count() == 0
    assert quality_mil.learn([]).score(rows, ["doc_id"]).select("score").distinct().collect() == [(1.0,)]


@pytest.mark.parametrize("n", [0, 3])
def test_training_without_two_kinds_of_labels(spark, n):
    docs = spark.createDataFrame([(i, "text") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    assert quality_mil.train(docs, labels).weights is None


def test_packing_open_windows_hold_no_long_document():
    packer = packing.Packer(8, 0, 4)
    packer.add(1, np.arange(100, dtype="<u4"))
    (piece,) = packer.open[4][0]
    assert piece[2].base is None and piece[2].tolist() == [96, 97, 98, 99]


def test_dense_templates_are_those_with_a_window_poor_in_literals():
    rng, pattern = random.Random(5), re.compile(decontam.slot_runs(6, 2))
    for _ in range(3000):
        words = [rng.choice(["a", "bc", "\x03", "\x03" + "7", "\x02x", "\x05y", "d"]) for _ in range(rng.randrange(0, 14))]
        poor = any(sum(w[0] not in "\x01\x02\x03\x05" for w in words[i:i + 6]) <= 2 for i in range(len(words) - 5))
        found = pattern.search(" " + (" " * rng.randrange(1, 3)).join(words)) is not None
        assert found or not poor
