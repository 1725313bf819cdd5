"""The keyed table and what is stored in it: changes, repeats, crashes, reprocessing."""

import pytest
from pyspark.sql import functions as F

from docloom.operators.keyed import Conflict, KeyedTable
from docloom.plans.reprocess import judged_pages, reprocess
from docloom.streaming.ingest import ingest_keyed

SHAPE = "k string, n long, x string"


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def made(spark, path, data=(), buckets=8):
    df = spark.createDataFrame(list(data), SHAPE)
    table = KeyedTable(spark, f"file://{path}/t", df.schema, "k", buckets)
    if data:
        table.insert(df, "n")
    return table, lambda d: spark.createDataFrame(d, SHAPE)


def test_insert_upsert_delete(spark, tmp_path):
    table, df = made(spark, tmp_path)
    assert rows(table) == [] and table.version() == 0
    assert table.insert(df([("a", 1, "x"), ("a", 0, "first"), ("b", 1, None), (None, 1, "no key")]), "n") == 2
    assert rows(table) == [("a", 0, "first"), ("b", 1, None)]
    assert table.insert(df([("a", 5, "late"), ("c", 1, "c")]), "n") == 1
    before = table.version()
    assert table.insert(df([("a", 5, "late"), ("c", 1, "c")]), "n") == 0 and table.version() == before  # again: nothing
    table.upsert(df([("a", 7, "old"), ("a", 9, "new"), ("d", 1, "d")]), "n")
    assert rows(table) == [("a", 9, "new"), ("b", 1, None), ("c", 1, "c"), ("d", 1, "d")]
    before = table.version()
    table.upsert(df([("a", 9, "new")]), "n")
    table.delete(df([("nowhere", 0, "")]))
    assert table.version() == before
    table.delete(df([("b", 0, ""), ("d", 0, "")]))
    assert rows(table) == [("a", 9, "new"), ("c", 1, "c")]
    again = KeyedTable(spark, f"file://{tmp_path}/t")  # absent arguments: as it was made
    assert rows(again) == rows(table) and again.buckets == 8
    assert again.vacuum() > 0 and rows(again) == [("a", 9, "new"), ("c", 1, "c")]
    with pytest.raises(ValueError):
        KeyedTable(spark, f"file://{tmp_path}/absent")


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table, df = made(spark, tmp_path, [(f"k{i}", i, "v") for i in range(400)], buckets=16)
    before = table._state()[1]["folders"]
    table.upsert(df([("k7", 1000, "w")]), "n")
    after = table._state()[1]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and table.read().count() == 400
    for i in range(4):
        table.insert(df([(f"more{i}-{j}", 1, "m") for j in range(200)]), "n")
    assert max(map(len, table._state()[1]["folders"].values())) == 5
    table.compact(2)
    assert {len(x) for x in table._state()[1]["folders"].values()} == {1} and table.read().count() == 1200


def test_a_crash_before_publishing_loses_nothing(spark, tmp_path, monkeypatch):
    table, df = made(spark, tmp_path, [("a", 1, "x")])
    was = rows(table)

    def dies(*args):
        raise RuntimeError("executor and driver lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", dies)
        for change in (lambda: table.insert(df([("b", 1, "y")]), "n"), lambda: table.upsert(df([("a", 2, "z")]), "n")):
            with pytest.raises(RuntimeError):
                change()
            assert rows(table) == was
    assert table.insert(df([("b", 1, "y")]), "n") == 1 and rows(table) == [("a", 1, "x"), ("b", 1, "y")]


def test_two_writers(spark, tmp_path):
    table, df = made(spark, tmp_path, [("a", 1, "x")])
    number, state = table._state()
    table.insert(df([("b", 1, "y")]), "n")
    with pytest.raises(Conflict):
        table._publish(number + 1, state)
    assert len(rows(table)) == 2


def test_stream_into_a_keyed_table(spark, tmp_path):
    source, table, at = (f"file://{tmp_path}/{x}" for x in ("in", "table", "at"))
    for n, ids in enumerate(([1, 2, 2], [2, 3], [], [3])):
        new = spark.createDataFrame([(str(i), k, f"text {i} of {n}") for k, i in enumerate(ids)], "doc_id string, chunk_id long, text string")
        new.coalesce(1).write.mode("append").json(source)
        ingest_keyed(spark, source, table, at).awaitTermination()
    held = KeyedTable(spark, table)
    assert sorted((r.doc_id, r.text) for r in held.read().collect()) == [("1", "text 1 of 0"), ("2", "text 2 of 0"), ("3", "text 3 of 1")]
    version = held.version()
    ingest_keyed(spark, source, table, f"{at}-lost").awaitTermination()  # all files again, as after a lost checkpoint
    assert held.version() == version


GOOD = "A clean page of plain words, long enough to be taken for good text by any measure."
CHUNK = "doc_id string, source string, page_start long, page_end long, tokens_est long, text string, chunk_id long, status string"


def store_of(spark, path):
    data = [("c1", "f1", 1, 1, 5, "#$%", 0, "flagged"), ("c2", "f1", 1, 2, 5, "@@", 1, "flagged"), ("c3", "f1", 3, 3, 5, "~~", 2, "flagged"), ("c4", "f2", 1, 1, 5, "^^", 3, "flagged"), ("c5", "f3", 1, 1, 5, "!!", 4, "flagged"), ("c6", "f4", 1, 1, 5, "<<", 5, "flagged"), ("c7", "f1", 9, 9, 5, "==", 6, "flagged"), ("c8", "f1", 2, 2, 5, GOOD, 7, "ok")]
    df = spark.createDataFrame(data, CHUNK)
    store = KeyedTable(spark, path, df.schema)
    store.insert(df, "chunk_id")
    return store


def test_reprocess_by_two_engines(spark, tmp_path):
    store, at = store_of(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/work"
    # f1: pages 1 to 3, the third poor; f2: the engine fails; f3: not there; f4: short
    again = spark.createDataFrame([("f1", 1, GOOD), ("f1", 2, GOOD), ("f1", 3, "#$%^&*@#$%^&*@#$%^&*@#$%^&*@#$%^&*@#$%^&*"), ("f2", None, None), ("f4", 1, "short")], "path string, page_no int, text string")
    counts = reprocess(store, again, "one", at, replace=True, log=f"file://{tmp_path}/log")
    assert counts == {"improved": 1, "still_flagged": 3, "stored": 1}
    held = {r["doc_id"]: r for r in store.read().collect()}
    assert set(held) == {"c3", "c4", "c5", "c6", "c7", "c8", "reprocess_one_0"}  # both chunks of page 1 went
    assert held["reprocess_one_0"]["text"] == GOOD and held["reprocess_one_0"]["status"] == "ok"
    assert sorted((r["path"], r["status"]) for r in spark.read.json(f"file://{tmp_path}/log").collect()) == [("f1", "flagged"), ("f1", "ok"), ("f2", "flagged"), ("f4", "flagged")]
    other = spark.createDataFrame([("f2", 1, GOOD), ("f4", 1, GOOD)], "path string, page_no int, text string")
    assert reprocess(store, other, "two", at) == {"improved": 2, "still_flagged": 0, "stored": 2}
    version = store.version()
    assert reprocess(store, other, "two", at) == {"improved": 2, "still_flagged": 0, "stored": 0} and store.version() == version
    assert {r[0] for r in store.read().where("status = 'ok'").select("doc_id").collect()} == {"c8", "reprocess_one_0", "reprocess_two_0", "reprocess_two_1"}


def test_judged_pages_of_nothing(spark):
    flagged = spark.createDataFrame([(None, None, 1), ("", "s", None)], "path string, source string, page_start long")
    again = spark.createDataFrame([("s", 1, GOOD)], "path string, page_no int, text string")
    assert [(r["path"], r["page_no"], r["accepted"]) for r in judged_pages(flagged, again).collect()] == [("s", 1, True)]
    assert judged_pages(flagged.limit(0), again).count() == 0 and judged_pages(flagged, again.limit(0)).count() == 0
