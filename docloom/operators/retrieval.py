"""Retrieval over sets of queries: inverted index, BM25, match, vectors, fusion, packing, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.functions.quality import hash_vector, script_ratios
from docloom.functions.text import citation, counted_tokens, estimated_tokens, index_tokens, redact
from docloom.operators.store import denied, route
from docloom.sources.scratch import scratch

K1, B, EPSILON = 1.5, 0.75, 0.25
# The instruction before a prompt and the reply to a denied question.
INSTRUCTION = "คุณคือผู้ช่วยของภาควิชาวิศวกรรมคอมพิวเตอร์ ใช้เฉพาะข้อมูลอ้างอิงในการตอบ ถ้าไม่มีข้อมูลให้ตอบว่าไม่พบ.\n\n"
REFUSAL = "คำขอไม่อยู่ในขอบเขตการให้บริการ"
#: Query sets are broadcast up to so many rows; beyond, Spark joins by shuffling.
BROADCAST_QUERIES = 10_000


def few(df: DataFrame, most: int = BROADCAST_QUERIES) -> bool:
    return df.limit(most + 1).count() <= most


def bounded(df: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    return F.broadcast(df) if few(df, most) else df


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.select(F.size(index_tokens(F.col("text"))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"))


def frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)``: the number of documents with each term, counted batch by batch before the one shuffle."""
    from docloom.operators.keywords import tally

    return tally(docs)[0]


def term_weights(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """Okapi weights of ``terms(term, df)``; negative ones become a share of the mean weight over all terms."""
    df = terms.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean_idf"))
    return df.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", parts: int = 64) -> None:
    """A BM25 index below ``path``: postings in folders by the term's hash and sorted by term; from them the terms'
    weights, with the largest share that a posting of the term has in a score (``peak``), and the number of documents.

    The documents are cut into words once; all else comes from the postings, which each task writes as it counts them."""
    from docloom.operators.keywords import postings

    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    rows = postings(docs, id_col).withColumn("part", part)
    rows.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    posts = spark.read.parquet(f"{path}/postings")
    stats = docs.agg(F.count("*").alias("n_docs"), F.count("text").alias("filled")).crossJoin(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")))
    stats.select("n_docs", F.try_divide("words", "filled").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    peaks = posts.crossJoin(F.broadcast(stats.select("avgdl"))).groupBy("term").agg(F.count("*").alias("df"), F.max(_share(F.col("avgdl"))).alias("peak"))
    peaks.write.mode("overwrite").parquet(f"{path}/peaks")
    peaks = spark.read.parquet(f"{path}/peaks")
    term_weights(peaks.select("term", "df"), stats).join(peaks.drop("df"), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/weights")


def _share(avgdl: Column) -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))


def asked_terms(questions: DataFrame, query_id: str) -> DataFrame:
    return questions.select(query_id, F.explode(index_tokens(F.col("text"))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))


def _scored(posts: DataFrame, asked: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """Scores of every document that shares a term with a question; ``asked`` with weights."""
    part = F.col("times") * F.col("idf") * _share(F.col("avgdl"))
    return posts.join(bounded(asked, 200_000), "term").groupBy(query_id, id_col).agg(F.sum(part).alias("score"))


def index_scores(questions: DataFrame, path: str, query_id: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """BM25 scores from a written index of every document that shares a term with a question."""
    read = questions.sparkSession.read.parquet
    asked = asked_terms(questions, query_id).join(read(f"{path}/weights"), "term")
    return _scored(read(f"{path}/postings"), asked, query_id, id_col).withColumn("score", F.round("score", 6))


def index_top(questions: DataFrame, path: str, k: int, query_id: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """``(query, id, score, rank)``: the best ``k`` of each question by BM25, from a written index."""
    from docloom.operators.keywords import top_indexed

    return top_indexed(questions, path, k, query_id, id_col)


def bm25_scores(questions: DataFrame, docs: DataFrame, query_id: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """Scores without an index: only the asked terms' words are counted and shuffled."""
    asked = asked_terms(questions, query_id)
    small = few(asked, 200_000)  # of the terms as asked, before their weights take a pass over the documents
    wanted = asked.select("term").distinct()
    words = docs.select(F.col(id_col), index_tokens(F.col("text")).alias("w")).select(id_col, F.size("w").alias("dl"), F.explode("w").alias("term"))
    words = words.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    posts = words.groupBy("term", id_col, "dl").agg(F.count("*").alias("tf"))
    from docloom.operators.keywords import tally

    asked = asked.join(term_weights(*tally(docs)), "term")
    part = F.col("times") * F.col("idf") * _share(F.col("avgdl"))
    scores = posts.join(F.broadcast(asked) if small else asked, "term").groupBy(query_id, id_col).agg(F.sum(part).alias("score"))
    return scores.withColumn("score", F.round("score", 6))


def filled_up(found: DataFrame, questions: DataFrame, docs: DataFrame, k: int, query_id: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """The best ``k`` ``found(query, id, score)`` of each question, with documents of score 0, by id, where there are fewer.

    Of the documents' first ids only as many are looked at as a question can have hits among, and some ``k`` more."""
    hits = top(found, query_id, k, F.desc("score"), F.col(id_col)).drop("rank")
    # of the first 2k ids at least k are no hits of a question with fewer than k
    short = questions.select(query_id).distinct().join(hits.groupBy(query_id).agg(F.count("*").alias("n")), query_id, "left").where(F.coalesce("n", F.lit(0)) < k).select(query_id)
    firsts = docs.select(id_col).distinct().orderBy(id_col).limit(2 * k)
    fill = short.crossJoin(F.broadcast(firsts)).join(hits.select(query_id, id_col), [query_id, id_col], "left_anti").withColumn("score", F.lit(0.0))
    return top(hits.unionByName(fill), query_id, k, F.desc("score"), F.col(id_col))


def top(df: DataFrame, query_id: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(*order))).where(F.col("rank") <= k)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def match_all(questions: DataFrame, docs: DataFrame, query_id: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """Documents that hold every term of a query (letter and digit runs, lower-cased); ids are unique."""
    asked = questions.select(query_id, F.coalesce(_terms(F.col("text")), F.array()).alias("every"))
    from docloom.operators.keywords import present

    return present(asked, ["every"], docs.select(id_col, _terms(F.col("text")).alias("terms")), lambda found, n: (found[0] == n[0]) & (n[0] > 0), query_id, id_col)


def match_boolean(questions: DataFrame, docs: DataFrame, query_id: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """Documents by ``questions(query, every, any, none)``, arrays of terms: all of ``every``, one of
    ``any`` if it has terms, and none of ``none``. A query without terms in the first two finds nothing. Ids are unique."""
    parts = ["every", "any", "none"]
    known = [F.array_distinct(F.transform(F.coalesce(F.col(c), F.array()), F.lower)).alias(c) for c in parts]
    from docloom.operators.keywords import present

    def met(found, n):
        return (found[0] == n[0]) & ((found[1] > 0) | (n[1] == 0)) & (found[2] == 0) & (n[0] + n[1] > 0)

    return present(questions.select(query_id, *known), parts, docs.select(id_col, _terms(F.col("text")).alias("terms")), met, query_id, id_col)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector at length 1; the null vector stays."""
    sizes = F.array_repeat(F.sqrt(dot(v, v)), F.size(v))  # an argument, so computed once and not for every number
    return F.zip_with(v, sizes, lambda x, size: F.when(size > 0, x / size).otherwise(x.cast("double")))


def hybrid(questions: DataFrame, docs: DataFrame, k: int, k_vec: int = 30, k_kw: int = 30, query_id: str = "item_id", id_col: str = "doc_id", embed: Callable[[Column], Column] = hash_vector, index: str | None = None, where: Column | None = None) -> DataFrame:
    """Vector leg (cosine) and keyword leg (BM25), fused by reciprocal ranks; ``embed`` makes a text's vector.

    ``where``, a condition on the columns of ``docs`` such as their owner and sensitivity, holds before the vector leg. The
    keyword leg takes five times its length (100 at least) from all documents and keeps the first that meet it.
    Null texts count as empty.

    ``index`` is the folder of a written BM25 index; without one the documents are scored as they are. The vectors
    are multiplied in blocks, each task keeping its best of each question."""
    from docloom.operators.keywords import top_documents
    from docloom.operators.vectors import top_vectors

    asked = questions.select(F.col(query_id).alias("query_id"), embed(F.coalesce("text", F.lit(""))).alias("q"))
    own = docs if where is None else docs.where(where)
    vectors = own.select(F.col(id_col).alias("vec_id"), embed(F.coalesce("text", F.lit(""))).alias("embedding"))
    near = top_vectors(asked, vectors, k_vec, cosine=True).select(F.col("query_id").alias(query_id), F.col("vec_id").alias(id_col), "rank")
    wide = k_kw if where is None else max(5 * k_kw, 100)
    if index:
        kw = index_top(questions, index, wide, query_id, id_col)
    else:
        kw = top_documents(questions, docs, wide, query_id, id_col)
    if where is not None:
        kw = top(kw.drop("rank").join(own.select(id_col), id_col, "left_semi"), query_id, k_kw, F.desc("score"), F.col(id_col))
    fused, path = fuse([near, kw], query_id, id_col, k), f"{scratch(docs.sparkSession)}/fused"
    fused.write.mode("overwrite").parquet(path)  # k rows a question, which what follows reads several times
    return docs.sparkSession.read.schema(fused.schema).parquet(path)


def rag_query(questions: DataFrame, docs: DataFrame, budget: int = 1200, k: int = 8, query_id: str = "item_id", id_col: str = "doc_id", **options) -> DataFrame:
    """``(query, prompt, contexts, token_est)``: retrieved by both legs, packed, and put into a prompt with its instruction.

    ``docs`` has id, text, source, path and page columns (the last three may be null)."""
    hits = hybrid(questions, docs, k, 20, 30, query_id, id_col, **options)
    rows = hits.join(docs, id_col).withColumn("cite", citation(F.col("source"), F.col("path"), F.col("page")))
    packed = pack_context(rows, query_id, budget)
    contexts = rows.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", id_col, "source", "path", "page", "rrf"))).alias("contexts"))
    out = questions.select(query_id, "text").join(contexts, query_id).join(packed, query_id, "left")
    ctx, cites = F.coalesce("ctx", F.lit("")), F.coalesce("cites", F.lit(""))
    return out.select(query_id, prompt(F.col("text"), ctx, cites, INSTRUCTION).alias("prompt"), "contexts", estimated_tokens(ctx).alias("token_est"))


def answers(asked: DataFrame, generate: Callable[[Column, Column], Column], hint: str | None = None) -> DataFrame:
    """``asked(question, ctx, cites, ...)`` with model and answer: denied, or routed, generated and redacted.

    ``generate(model, prompt)`` is the seam for a model: any Column function, an Arrow UDF included."""
    thai = script_ratios(F.coalesce("question", F.lit("")))[0] + script_ratios(F.coalesce("ctx", F.lit("")))[0]
    model = route(F.coalesce("question", F.lit("")), thai, F.col("ctx"), F.lit(hint) if hint else None)
    no = denied(F.coalesce("question", F.lit("")))
    rows = asked.withColumn("model", F.when(no, "deny").otherwise(model)).withColumn("_prompt", prompt(F.col("question"), F.coalesce("ctx", F.lit("")), F.coalesce("cites", F.lit(""))))
    said = redact(generate(F.col("model"), F.col("_prompt")))
    return rows.withColumn("answer", F.when(F.col("model") == "deny", REFUSAL).otherwise(said)).drop("_prompt")


def fit_dimension(embedding: Column, dim: int) -> Column:
    """Cut to ``dim``, or filled up with the mean."""
    mean = F.aggregate(embedding, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(embedding)
    return F.when(F.size(embedding) >= dim, F.slice(embedding, 1, dim)).otherwise(F.concat(embedding, F.array_repeat(mean.cast("float"), F.lit(dim) - F.size(embedding))))


def fuse(legs: list[DataFrame], query_id: str, id_col: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of legs with ranks; ties by leg, then rank, then id."""
    rows = None
    for i, leg in enumerate(legs):
        leg = leg.select(query_id, id_col, F.lit(i).alias("leg"), "rank")
        rows = leg if rows is None else rows.unionByName(leg)
    both = rows.groupBy(query_id, id_col).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 8).alias("rrf"), F.min(F.struct("leg", "rank")).alias("first"))
    return top(both, query_id, k, F.desc("rrf"), F.col("first.leg"), F.col("first.rank"), F.col(id_col)).select(query_id, id_col, "rrf", "rank")


def overlap_rerank(hits: DataFrame, questions: DataFrame, docs: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    """Share of a query's distinct tokens that a document holds; the default in place of a cross-encoder."""
    q = questions.select(query_id, F.array_distinct(index_tokens(F.col("text"))).alias("qt"))
    d = docs.join(bounded(hits.select(id_col).distinct(), 200_000), id_col, "left_semi").select(id_col, F.array_distinct(index_tokens(F.col("text"))).alias("dt"))
    rows = hits.select(query_id, id_col).join(q, query_id).join(d, id_col)
    rows = rows.withColumn("rerank", F.round(F.size(F.array_intersect("qt", "dt")) / F.greatest(F.size("qt"), F.lit(1)), 6))
    return top(rows, query_id, k, F.desc("rerank"), F.col(id_col)).select(query_id, id_col, "rerank", "rank")


def pack_context(ranked: DataFrame, query_id: str, budget: int = 1200, cited: bool = False) -> DataFrame:
    """``ranked(query, rank, text, cite)`` cut at the first block over the budget, joined by blank lines; a query
    whose first block is over it has a row with no block.

    ``cited`` counts the block with its citation, by the half-even estimate."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.regexp_replace("text", "^\\s+|\\s+$", ""))
    counted = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("cite"), F.lit("\n"), F.regexp_replace("text", "^\\s+|\\s+$", ""), F.lit("\n"))
    rows = ranked.withColumn("block", block).withColumn("tokens", counted_tokens(counted) if cited else estimated_tokens(block))
    used = F.sum("tokens").over(W.partitionBy(query_id).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("used", used).withColumn("fits", F.col("used") <= budget)
    ordered = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("rank", "block", "cite"))))
    packed = rows.groupBy(query_id).agg(ordered.alias("x"), F.coalesce(F.max(F.when(F.col("fits"), F.col("used"))), F.lit(0)).alias("used_tokens"))
    return packed.select(query_id, "used_tokens", F.size("x").cast("long").alias("n_blocks"), F.array_join(F.transform("x", lambda x: x["block"]), "\n\n").alias("ctx"),
                         F.array_join(F.transform("x", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["cite"])), "\n").alias("cites"))


def prompt(question: Column, ctx: Column, cites: Column, instruction: str = "") -> Column:
    return F.concat(F.lit(instruction + "คำถาม:\n"), question, F.lit("\n\nบริบท:\n"), ctx, F.lit("\n\nอ้างอิง:\n"), cites, F.lit("\n"))
