"""Incremental ingest: new JSON files of chunks are appended to a table, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.keyed import KeyedTable
from docloom.operators.store import insert_or_ignore
from docloom.sources.files import CHUNK


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, key: str = "doc_id", order: str = "chunk_id", schema: str = CHUNK, files_per_batch: int = 1000) -> StreamingQuery:
    """Takes in the files of ``folder`` that are new since the last call, then ends.

    Each micro-batch overwrites its own folder ``batch=N`` of the table and is held against the
    batches before it only, so a batch that is run again after a failure gives the same rows."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]

    def take(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        before = own.createDataFrame([], f"{schema}, batch long")
        if batch:
            before = own.read.schema(f"{schema}, batch long").option("basePath", table).parquet(table).where(F.col("batch") < batch)
        new = insert_or_ignore(before, rows.select(*names).where(F.col(key).isNotNull()), key, order)
        new.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()


def ingest_keyed(spark: SparkSession, folder: str, table: str, checkpoint: str, key: str = "doc_id", order: str = "chunk_id", schema: str = CHUNK, files_per_batch: int = 1000, buckets: int = 64) -> StreamingQuery:
    """As ``ingest``, into the ``KeyedTable`` at ``table``: a micro-batch reads the buckets of its own keys in place of
    all earlier batches, and one that is run again after a failure finds its keys there and changes nothing."""
    shape = spark.createDataFrame([], schema).schema

    def take(rows: DataFrame, batch: int) -> None:
        KeyedTable(rows.sparkSession, table, shape, key, buckets).insert(rows.select(*shape.fieldNames()), order)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
