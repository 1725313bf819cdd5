"""Flagged chunks done again: their pages re-extracted by another engine, judged, re-chunked and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import quality as Q
from docloom.functions import text as T
from docloom.operators import paragraphs as P
from docloom.operators.keyed import KeyedTable


def judged_pages(flagged: DataFrame, again: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(path, page_no, text, quality_score, accepted)`` of each page that a flagged chunk begins on, once.

    ``flagged(path, source, page_start)``; where the path is missing the source stands in. ``again(path, page_no,
    text)`` are the pages by the other engine, a null text for a file at which it failed: those pages are not
    accepted. Pages of files that are not in ``again``, or beyond a file's last page, are left out."""
    path = F.coalesce(F.nullif("path", F.lit("")), F.nullif("source", F.lit("")))
    asked = flagged.select(path.alias("path"), F.coalesce("page_start", F.lit(1)).cast("int").alias("page_no")).where("path is not null").distinct()
    failed = again.groupBy("path").agg(F.max(F.col("text").isNotNull()).alias("any")).where("not any").select("path")
    pages = asked.join(again.where("text is not null").select("path", "page_no", "text"), ["path", "page_no"])
    lost = asked.join(failed, "path", "left_semi").withColumn("text", F.lit(None).cast("string"))
    rows = pages.unionByName(lost).withColumn("quality_score", F.coalesce(Q.ocr_quality(F.col("text")), F.lit(0.0)))
    ok = (F.col("quality_score") >= threshold) & Q.valid_ocr(F.col("text"), Q.language_label(F.col("text")))
    return rows.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def rechunked(pages: DataFrame, engine: str, path: str, most: int = 800) -> DataFrame:
    """Chunks of accepted pages, numbered over the whole batch: ids ``reprocess_<engine>_<n>``."""
    rows = pages.where("accepted").select("path", "page_no", F.posexplode(T.smart_paragraphs(F.col("text"))).alias("pos", "text"))
    rows = rows.withColumn("place", F.col("page_no") * (1 << 32) + F.col("pos"))
    rows = P.numbered(P.chunks(rows, "path", "place", "page_no", most, path=path), "chunk_id", f"{path}/numbered", "path", "chunk")
    return rows.select(F.concat(F.lit(f"reprocess_{engine}_"), "chunk_id").alias("doc_id"), F.col("path").alias("source"), "page_start", "page_end", "tokens_est", "text", "chunk_id", F.lit("ok").alias("status"))


def reprocess(store: KeyedTable, again: DataFrame, engine: str, path: str, threshold: float = 0.3, replace: bool = False, log: str | None = None) -> dict[str, int]:
    """Takes the flagged rows of the store's table (``source, page_start, page_end, tokens_est, text, status``, key
    ``doc_id``) through ``judged_pages``, stores the new chunks and returns the counts.

    With ``replace`` the flagged rows of accepted pages go, in place of which the new ones stand. New rows whose ids
    the store has already (a batch run again) are ignored. ``log`` is a folder that gets a line for each judged page."""
    spark = again.sparkSession
    held = store.read().where("status = 'flagged'")
    pages = judged_pages(held.select(F.col("source").alias("path"), "source", "page_start"), again, threshold)
    pages.write.mode("overwrite").parquet(f"{path}/judged")
    pages = spark.read.schema(pages.schema).parquet(f"{path}/judged")
    new = rechunked(pages, engine, path)
    counts = pages.agg(F.count_if("accepted").alias("improved"), F.count_if(~F.col("accepted")).alias("still_flagged")).first().asDict()
    good = pages.where("accepted").select(F.col("path").alias("source"), F.col("page_no").alias("page_start"))
    gone = held.join(good, ["source", "page_start"], "left_semi").select("doc_id")
    gone.write.mode("overwrite").parquet(f"{path}/gone")  # before the store changes
    counts["stored"] = store.insert(new, "chunk_id")
    if replace:
        store.delete(spark.read.parquet(f"{path}/gone"))
    if log:
        kept = F.when(F.col("accepted"), "ok").otherwise("flagged")
        pages.select("path", F.col("page_no").alias("page_num"), "quality_score", F.lit(f"reprocess-{engine}").alias("engine"), kept.alias("status")).write.mode("append").json(log)
    return counts
