"""What the workers of the language stage hold."""

import tracemalloc

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from docloom.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, n=300):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.translate(F.md5(F.concat(F.lit(str(k)), F.col("id").cast("string"))), "0123456789", "ghijklmnop") for k in range(9)]).alias("text"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"), F.lit(1).alias("n"))


def test_language_texts_go_to_the_worker_once(spark):
    docs = documents(spark)
    model = langid.train(docs, F.lit(True), PATH)
    found = langid.identify(docs, model)
    assert found.columns == [*docs.columns, "lang_pred", "score", "typical"]
    assert "__text" not in found._jdf.queryExecution().analyzed().toString()
    rows = {r.doc_id: r for r in found.collect()}
    assert {i: (r.text, r.lang, r.n) for i, r in rows.items()} == {r.doc_id: (r.text, r.lang, r.n) for r in docs.collect()}
    apart = langid.identify(docs, model, keep=["doc_id"]).collect()
    assert {r.doc_id: (r.lang_pred, r.score, r.typical) for r in apart} == {i: (r.lang_pred, r.score, r.typical) for i, r in rows.items()}


def test_language_blocks_change_no_score_and_bound_the_memory(spark, monkeypatch):
    model = langid.train(documents(spark), F.lit(True), PATH)
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, x)) for x in rng.integers(97, 123, (20_000, 24))]
    model.word_scores(words[:10])
    tracemalloc.start()
    got = model.word_scores(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15e6, most
    monkeypatch.setattr(langid, "AT_ONCE", 20_000)
    assert (model.word_scores(words) == got).all()
