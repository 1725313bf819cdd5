"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

``run(spark, sf_dir)`` applies the stages to ``documents``; each stage's result is written as Parquet
below the folder in ``spark.checkpoint.dir`` and reread as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, langid, line_dedup, near_dup, packing
from docloom.llm.common import crc_mod, remove, table, work_dir, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a letter, whose language is at least as likely as all others together, and
    whose text is typical of it: random letters and languages of another build than the learned ones go.

    The model learns from the labelled documents outside the held-out third. Null and empty texts go; rows with
    a null id and repeated rows are judged like others; texts of any length are read whole; ties go to the
    first language; an empty table, or one without labels, gives an empty table. Columns pass through."""
    model = langid.train(docs, crc_mod("doc_id", 3) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5) & F.col("typical")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out of the texts; a document that loses all its text goes.

    Null and empty texts and rows with a null id stay as they are; of the ids that hold a line the largest
    keeps it; repeated rows count once and all stay; an empty table stays empty. Columns pass through."""
    out = line_dedup.drop_repeated_lines(docs).where((F.col("n_dropped") == 0) | (F.length(F.btrim("text")) > 0))
    if "n_chars" in docs.columns:  # it counts what is left
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group, at five words and a similarity of 0.8.

    Null and blank texts are in no group and stay; rows with a null id can't be told apart and stay, and so do
    all rows of an id that stays; an empty table stays empty. Columns pass through."""
    gone = near_dup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold passages of the benchmark.

    Null and empty texts hold none; rows with a null id stay; all rows of an id that holds one go; with an empty
    table or benchmark nothing goes. Columns pass through."""
    leaks = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 ids; null and empty texts are their end id alone, null ids
    are carried along, repeated rows are packed each, an empty table gives no piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("benchmarks", benchmarks), ("pack", pack)]

#: Language ID and packing have no SQL form; tests/llm holds the operators against brute force, and the stages against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), work_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{base}/{i}-{name}")
            if i:  # nothing reads the stage before any more
                remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
