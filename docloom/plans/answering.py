"""From questions to redacted answers as one job: both legs, rerank, packed context, routing, generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import citation
from docloom.operators import retrieval as R

#: Reranks ``(hits, questions, docs, query_id, id_col, k)``; ``models.reranked`` with a model bound is one.
Reranker = Callable[[DataFrame, DataFrame, DataFrame, str, str, int], DataFrame]


def answered_questions(questions: DataFrame, chunks: DataFrame, generate: Callable[[Column, Column], Column], where: Column | None = None, hint: str | None = None, budget: int = 1200,
                       k_fused: int = 20, k: int = 8, query_id: str = "item_id", id_col: str = "doc_id", rerank: Reranker = R.overlap_rerank, **options) -> DataFrame:
    """``(query, model, answer, cites, used_tokens, n_blocks, hits)``, a row for each of ``questions(query, text)``.

    ``chunks`` has id, text, source, path and page columns (the last two may be null) and those that ``where`` reads. The
    best ``k_fused`` chunks of both legs are reranked to ``k``, packed with their citations into ``budget`` tokens, and put
    before the model that the question and its context choose; ``options`` go to ``hybrid``. A null question is
    an empty one; a question without a hit is asked without a context; ties go to the smaller id. Question ids are
    unique; repeated rows of a chunk count as often as they are there."""
    asked = questions.select(query_id, F.coalesce("text", F.lit("")).alias("text"))
    fused = R.hybrid(asked, chunks, k_fused, query_id=query_id, id_col=id_col, where=where, **options)
    best = rerank(fused, asked, chunks, query_id, id_col, k)
    rows = best.join(chunks.select(id_col, "text", citation(F.col("source"), F.col("path"), F.col("page")).alias("cite")), id_col)
    packed = R.pack_context(rows, query_id, budget, cited=True)
    hits = best.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", id_col, "rerank"))).alias("hits"))
    whole = asked.withColumnRenamed("text", "question").join(packed, query_id, "left").join(hits, query_id, "left")
    said = R.answers(whole, generate, hint)
    return said.select(query_id, "model", "answer", F.coalesce("cites", F.lit("")).alias("cites"), F.coalesce(F.col("used_tokens").cast("long"), F.lit(0)).alias("used_tokens"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "hits")
