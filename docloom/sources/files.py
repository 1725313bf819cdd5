"""File sources and sinks: listings, sheets, page records, pluggable extractors, JSON lines, text files.

All reads and writes go through Spark's readers and writers, so any store that Spark knows will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = "source string, page_no int, sheet string, method string, text string, paragraphs array<string>, header string, footer string"
CHUNK = "source string, path string, page int, page_start int, page_end int, owner string, sensitivity string, updated_at long, text string, tokens_est long, doc_id string, file_type string, chunk_id long, status string"
QUALITY = "doc_id string, page_num int, quality_score double, engine string, status string, notes string, created_at long"
#: Fixed value: the file types that are taken in.
SUFFIXES = "pdf xlsx xls csv tsv"


#: Tables below the size of one usual split may come from a single row group, that is in a single task.
ONE_SPLIT = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A table as it is, or, if all of it is smaller than a split and it has much work ahead, dealt over the cores."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if (1 << 20) < size < ONE_SPLIT else rows


def base_name(path: Column) -> Column:
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def binary_files(spark: SparkSession, folder: str, suffixes: str = SUFFIXES) -> DataFrame:
    """Files below ``folder``: path, modificationTime, length, content (read only where selected), kind."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    return rows.withColumn("kind", kind).where(F.col("kind").isin(suffixes.split()))


def row_line(cells: Column) -> Column:
    """A row's cells, stripped, blank ones left out, joined by a bar."""
    return F.array_join(F.filter(F.transform(F.filter(cells, lambda c: c.isNotNull()), lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")), lambda c: c != ""), " | ")


def decoded(raw: Column, charset: str) -> Column:
    """Text of bytes in a single-byte charset, by a table of its upper 128 characters; undefined bytes are left out."""
    upper = [bytes([i]).decode(charset, "ignore") for i in range(128, 256)]
    order = sorted(range(128), key=lambda i: upper[i] == "")
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(chr(128 + i) for i in order), "".join(upper))


def sheet_lines(spark: SparkSession, folder: str, suffix: str, legacy: str | None) -> DataFrame:
    """(path, block, at, value): the lines of table files with the split they are in and their order there, without a
    byte-order mark. Files that are no UTF-8 are read in the charset ``legacy``, or left out without one."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    broken = rows.where(~F.is_valid_utf8("value")).select("path").distinct()
    rows = rows.join(broken.withColumn("broken", F.lit(True)), "path", "left")
    rows = rows.withColumn("value", F.when(F.col("broken"), decoded(F.col("value").cast("binary"), legacy)).otherwise(F.col("value"))) if legacy else rows.where("broken is null")
    first = F.lag("at").over(Window.partitionBy("path", "block").orderBy("at")).isNull() & (F.col("block") == 0)
    return rows.drop("broken").withColumn("value", F.when(first, F.ltrim("value", F.lit("\ufeff"))).otherwise(F.col("value")))


def sheet_records(lines: DataFrame, separator: str) -> DataFrame:
    """(path, block, at, record): lines of which a quoted cell holds the break put together, of any split.

    A quote opens a cell only at the cell's start. So each line keeps, turns round or sets the state "within quotes",
    and the state before it is that of the last line that sets it, turned round by those after: window functions
    over a split, and over one row for each split of a file."""
    sep = f"[{separator}]" if separator != "\t" else "\\t"
    other = "[^" + sep.strip("[]") + "]"
    quoted = '(?:[^"]++|"")*+'
    opened = f'(?:(?:"{quoted}"{other}*+|(?!"){other}*+){sep})*+"{quoted}$'
    plain = F.col("value").rlike("^" + opened).cast("int")  # within quotes after the line, if not so before
    within = F.col("value").rlike(f'^{quoted}(?:"{other}*+{sep}{opened}|$)').cast("int")  # if so before
    rows = lines.withColumn("turns", ((plain == 1) & (within == 0)).cast("int")).withColumn("sets", F.when(plain == within, plain))
    here = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("turned", F.sum("turns").over(here))
    rows = rows.withColumn("last", F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "turned")), True).over(here))
    blocks = rows.groupBy("path", "block").agg(F.max_by(F.struct("turned", "last"), "at").alias("end"))
    blocks = blocks.select("path", "block", F.col("end.turned").alias("turned"), F.col("end.last.sets").alias("sets"), (F.col("end.turned") - F.col("end.last.turned")).alias("after"))
    to_here = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("all", F.sum("turned").over(to_here))
    blocks = blocks.withColumn("last", F.last(F.when(F.col("sets").isNotNull(), (F.col("sets") + F.col("after") + F.col("all")) % 2), True).over(to_here))
    state = (F.coalesce("last", F.lit(0)) + F.col("all")) % 2
    blocks = blocks.select("path", "block", F.lag(state, 1, 0).over(Window.partitionBy("path").orderBy("block")).alias("before"))
    rows = rows.join(blocks, ["path", "block"])
    after = F.when(F.col("last").isNull(), F.col("before") + F.col("turned")).otherwise(F.col("last.sets") + F.col("turned") - F.col("last.turned")) % 2
    rows = rows.withColumn("inside", F.lag(after).over(Window.partitionBy("path", "block").orderBy("at")))
    rows = rows.withColumn("begins", F.when(F.coalesce("inside", "before") == 0, F.col("at"))).withColumn("start", F.last("begins", True).over(here))
    starts = rows.groupBy("path", "block").agg(F.max("begins").alias("start"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_before = starts.select("path", "block", F.last(F.when(F.col("start").isNotNull(), F.struct("block", "start")), True).over(earlier).alias("open"))
    rows = rows.join(open_before, ["path", "block"])
    record = F.when(F.col("start").isNotNull(), F.struct("block", "start")).otherwise(F.col("open")).alias("r")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
    return rows.select("path", record, "block", "at", "value").groupBy("path", "r").agg(text.alias("record")).select("path", "r.block", F.col("r.start").alias("at"), "record")


def sheet_pages(spark: SparkSession, folder: str, suffix: str = "csv", separator: str | None = None, max_columns: int = 256, legacy: str | None = "cp874") -> DataFrame:
    """Each table file below ``folder`` as one page record; its first line that isn't blank is a header and left out.

    Cells may hold line breaks (read as \\n) and doubled quotes; a byte-order mark is dropped; files that are no UTF-8 are read
    in the single-byte charset ``legacy`` (None: left out). Cells beyond ``max_columns`` would be lost, so a file that has
    them fails the read. A file's lines are put in order by split and place in it; a sheet is one value and must fit a task."""
    sep = separator or ("\t" if suffix == "tsv" else ",")
    rows = sheet_records(sheet_lines(spark, folder, suffix, legacy), sep).where(F.btrim("record") != "")
    heads = rows.groupBy("path").agg(F.min(F.struct("block", "at")).alias("head"))
    rows = rows.join(heads, "path").where(F.struct("block", "at") != F.col("head"))
    schema = ", ".join(f"c{i} string" for i in range(max_columns)) + ", _more string"
    rows = rows.select("path", "block", "at", F.from_csv("record", schema, {"sep": sep, "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("x")).select("path", "block", "at", "x.*")
    line = F.when(F.col("_more").isNotNull(), F.raise_error(F.lit(f"a row has over {max_columns} cells"))).otherwise(row_line(F.array(*[f"c{i}" for i in range(max_columns)])))
    lines = rows.select("path", "block", "at", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("block", "at", "line")))), lambda x: x["line"]), "\n")
    pages = lines.groupBy("path").agg(text.alias("text"))
    kept = F.when(F.col("text") != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    return pages.select(base_name(F.col("path")).alias("source"), F.lit(1).alias("page_no"), F.lit("Sheet1").alias("sheet"), F.lit(suffix).alias("method"), "text", kept.alias("paragraphs"), none.alias("header"), none.alias("footer"))


def extracted_pages(files: DataFrame, extractor: Callable[[str, bytes], list[str]], method: str) -> DataFrame:
    """Page records of binary files by a plug-in that gives a file's page texts; a file at which it fails has none."""

    def run(parts: Iterator):
        import pandas as pd

        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    texts = extractor(path, bytes(content))
                except Exception:  # one broken file must not end the job
                    texts = []
                rows += [(path, i, x or "") for i, x in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    pages = files.select("path", "content").mapInPandas(run, "path string, page_no int, text string")
    return pages.select("path", base_name(F.col("path")).alias("source"), "page_no", F.lit(method).alias("method"), "text")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Page records from JSON lines, with the file they are in; lines that are no JSON are left out."""
    rows = spark.read.schema(PAGE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(folder)
    named = rows.withColumn("file_jsonl", F.col("_metadata.file_path"))
    return named.where("_bad is null").drop("_bad").withColumn("file_name", base_name(F.col("file_jsonl")))


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(folder)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields written out; overwrites."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_texts(rows: DataFrame, path: str, key: str, text: str = "text") -> None:
    """Texts as text files, in one folder per value of ``key``."""
    rows.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
