"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir.

    Only where the setting is empty (local tests) is a temporary folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/docloom-work"
    path = f"{base.rstrip('/')}/docloom/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)  # what a query's result still needs goes when the driver ends
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def finished(df: DataFrame, base: str) -> DataFrame:
    """``df`` as a table of its own, after which all else below the folder ``base`` is removed."""
    out = written(df, f"{base}/result")
    jvm = df.sparkSession.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(where):
        if status.getPath().getName() != "result":
            fs.delete(status.getPath(), True)
    return out


def working(columns: list[str], *names: str) -> list[str]:
    """The names with a prefix that keeps them apart from a table's own ``columns``, whatever those are."""
    own, prefix = {c.lower() for c in columns}, "_"
    while any(f"{prefix}{n}".lower() in own for n in names):
        prefix += "_"
    return [f"{prefix}{n}" for n in names]


def by_bytes(batch: pa.RecordBatch, column: int, most: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts of up to ``rows`` rows and ``most`` bytes of a text column; a longer text is a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).tolist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start == rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if sizes:
        yield batch.slice(start)


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")), "UTF-8")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty array."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE_CLASS}+"))
