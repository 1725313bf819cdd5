"""The ingestion of pages as one job: clean, strip, paragraphs, chunks, flags, JSON lines, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import quality as Q
from docloom.functions import text as T
from docloom.operators import paragraphs as P


def cleaned_paragraphs(pages: DataFrame, path: str) -> DataFrame:
    """``(source, place, page_no, text)`` of ``pages(source, page_no, text)``: cleaned, without the headers and
    footers that recur in the source, and cut into paragraphs. Null pages are page 0, null texts have none. The
    cleaned pages go below ``path``, for they are read for the headers and again for the texts."""
    rows = pages.select("source", F.coalesce("page_no", F.lit(0)).cast("long").alias("page_no"), T.clean_for_index(F.col("text")).alias("text"))
    rows.write.mode("overwrite").parquet(f"{path}/clean")
    rows = P.strip_headers_footers(pages.sparkSession.read.schema(rows.schema).parquet(f"{path}/clean")).select("source", "page_no", F.posexplode(T.smart_paragraphs(F.col("body"))).alias("pos", "text"))
    return rows.select("source", (F.col("page_no") * (1 << 32) + F.col("pos")).alias("place"), "page_no", "text")


def flagged_chunks(pages: DataFrame, path: str, most: int = 800) -> DataFrame:
    """Chunks with ordinal (``chunk_id``, over all sources), ``doc_id`` and status; a table goes below ``path``."""
    rows = P.chunks(cleaned_paragraphs(pages, path), "source", "place", "page_no", most, path=path)
    rows = P.numbered(rows, "chunk_id", f"{path}/rows", "source", "chunk")
    ok = Q.valid_ocr(F.col("text"), Q.language_label(F.col("text")))
    return rows.select("source", "chunk", "chunk_id", T.chunk_id(F.col("source"), F.col("page_start"), F.col("chunk_id")).alias("doc_id"), "page_start", "page_end", "tokens_est", F.when(ok, "ok").otherwise("flagged").alias("status"), "text")


def run_ingest(pages: DataFrame, path: str, most: int = 800, embed_flagged: bool = False) -> DataFrame:
    """Writes pages, chunks and, unless ``embed_flagged``, flagged chunks as JSON lines below ``path``; returns the summary row
    ``(n_files, n_records, n_chunks, n_flagged, n_embedded)``."""
    spark = pages.sparkSession
    pages.write.mode("overwrite").json(f"{path}/pages", ignoreNullFields=False)
    rows = flagged_chunks(pages, f"{path}/numbered", most)
    rows.write.mode("overwrite").json(f"{path}/chunks", ignoreNullFields=False)
    rows = spark.read.schema(rows.schema).json(f"{path}/chunks")
    if not embed_flagged:  # else they go with the others
        rows.where("status = 'flagged'").write.mode("overwrite").json(f"{path}/flagged", ignoreNullFields=False)
    files = pages.agg(F.count_distinct("source").alias("n_files"), F.count("*").alias("n_records"))
    embedded = F.count("*") if embed_flagged else F.count_if(F.col("status") == "ok")
    return files.crossJoin(rows.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("status") == "flagged").alias("n_flagged"), embedded.alias("n_embedded")))
