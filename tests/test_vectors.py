"""Vector search in blocks and cells, and the keyword search by peaks, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.operators import vectors as V


def made(spark, n=3000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dim))
    x[:n // 3] = x[0]  # a third of all rows are copies
    rows = [(i, v.astype(np.float32).tolist(), i % 4) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


def brute(rows, queries, k):
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    out = {}
    for r in queries:
        score = np.round(x @ np.array(r["embedding"], dtype=np.float64), 6)
        best = np.lexsort((ids, -score))[:k]
        out[r["vec_id"]] = [(int(ids[i]), float(score[i])) for i in best]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def asked(rows):
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def test_blocks_and_cells_equal_brute_force(spark, tmp_path, monkeypatch):
    rows = made(spark)
    held = rows.collect()
    want = brute(held, [r for r in held if r["vec_id"] % 100 == 0], 7)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(V, "QUERY_BLOCK", 12)
    found = V.top_vectors(asked(rows), rows, 7)
    assert answers(found) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    path = f"file://{tmp_path}/collection"
    V.write_collection(rows, path, cells=12, sample=500)
    assert answers(V.search_collection(asked(rows), path, 7, probes=1)) == want
    near = answers(V.search_collection(asked(rows), path, 7, probes=2, exact=False))
    recall = sum(len(set(near[q]) & set(w)) for q, w in want.items()) / (7 * len(want))
    assert recall >= 0.9
    own = brute([r for r in held if r["label"] == 1], [r for r in held if r["vec_id"] % 100 == 0], 7)
    assert answers(V.search_collection(asked(rows), path, 7, where="label = 1")) == own


def test_upsert_of_a_collection(spark, tmp_path):
    rows, path = made(spark, 600), f"file://{tmp_path}/collection"
    V.write_collection(rows, path, cells=6)
    more = spark.createDataFrame([(5, [9.0] * 16, 1), (599, [-9.0] * 16, 2), (10_000, [3.0] * 16, 3), (10_001, None, 3)], "vec_id long, embedding array<float>, label int")
    touched = V.upsert_collection(more, path)
    assert 0 < len(touched) <= 6
    now = rows.where("vec_id not in (5, 599)").unionByName(more.where("embedding is not null"))
    held = now.collect()
    assert spark.read.parquet(f"{path}/vectors").count() == 601 == len(held)
    want = brute(held, [r for r in held if r["vec_id"] % 100 == 0], 5)
    assert answers(V.search_collection(asked(now), path, 5)) == want
    V.upsert_collection(more, path)  # again: nothing changes
    assert answers(V.search_collection(asked(now), path, 5)) == want


def test_vectors_of_other_lengths_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0, 5.0]), (3, None), (4, [3.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0]), (8, None)], "query_id long, q array<double>")
    assert answers(V.top_vectors(q, rows, 2)) == {9: [(4, 3.0), (2, 2.0)]}
    assert answers(V.top_vectors(q, rows, 1, cosine=True)) == {9: [(1, 0.707107)]}
    assert V.top_vectors(q.limit(0), rows, 2).count() == 0 and V.top_vectors(q, rows.limit(0), 2).count() == 0


def test_keyword_search_by_peaks(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(["the"] * rng.randrange(4) + ["of"] * rng.randrange(2) + rng.choices(words, [1 / (i + 1) for i in range(400)], k=n))
    docs = spark.createDataFrame([(i, text(rng.randrange(1, 60))) for i in range(1500)] + [(5000, ""), (5001, "the the")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(rng.randrange(1, 9))) for i in range(60)] + [(100, "the"), (101, "nowhere"), (102, "w399 nowhere"), (103, "w5 w5 w5 the of")], "item_id long, text string")
    path = f"file://{tmp_path}/index"
    R.write_index(docs, path, parts=4)
    rows = lambda df: sorted(map(tuple, df.select("item_id", "doc_id", "score", "rank").collect()))
    every = R.bm25_scores(asked, docs)
    want = rows(R.top(every, "item_id", 10, F.desc("score"), F.col("doc_id")))
    assert rows(R.index_top(asked, path, 10)) == want
    filled = rows(R.filled_up(every, asked, docs, 10))
    assert len(filled) == 640 and set(want) <= set(filled)
    assert [r for r in filled if r[0] == 101] == [(101, i, 0.0, i + 1) for i in range(10)]


def test_few_scores_are_held_at_once(monkeypatch):
    """A worker's memory is bounded by its block of scores, also while the best aren't known yet."""
    import tracemalloc

    rng = np.random.default_rng(3)
    scores, best = np.round(rng.normal(size=(2048, 256)), 2), V.Best(256, 5)
    tracemalloc.start()
    best.add(scores, np.arange(2048), np.arange(256))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.lexsort((np.broadcast_to(np.arange(2048), (256, 2048)), -scores.T), axis=1)[:, :5]
    assert (best.id.reshape(256, 5) == want).all()
    assert peak < 5 * scores.nbytes
