"""A keyed table that lasts: buckets of rows by their key's hash, written aside and published by one manifest.

A change reads and writes only the buckets that its keys fall into. What it writes goes to a folder of its own;
the table is what the manifest with the highest number lists, and a manifest is put in place by a rename. A job
that dies before that leaves the table as it was, and what it wrote is in no manifest. A change that changes
nothing publishes nothing, so a batch that is run again leaves the table alone.

Rows with a null key are left out. Of incoming rows with one key, ``insert`` takes the first in the given order and
``upsert`` the last; of equals in that order, any.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators.store import insert_or_ignore, upsert


class Conflict(RuntimeError):
    """Another writer has published meanwhile; run the change again."""


class KeyedTable:
    """A table at ``path``, created if it is absent; schema, key and the number of buckets are those it was made with."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None, key: str = "doc_id", buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._files = self._at("data").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._latest() < 0:
            if schema is None:
                raise ValueError(f"no table at {path}")
            try:
                self._publish(0, {"key": key, "buckets": buckets, "schema": schema.jsonValue(), "folders": {}})
            except Conflict:
                pass  # someone else has made it
        self._state()

    def _latest(self) -> int:
        where = self._at("manifest")
        if not self._files.exists(where):
            return -1
        names = [s.getPath().getName() for s in self._files.listStatus(where)]
        return max([int(n) for n in names if n.isdigit()], default=-1)

    def _state(self) -> tuple[int, dict]:
        number = self._latest()
        line = self.spark.read.text(f"{self.path}/manifest/{number}").first()[0]
        state = json.loads(line)
        self.key, self.buckets, self.schema = state["key"], state["buckets"], StructType.fromJson(state["schema"])
        return number, state

    def _publish(self, number: int, state: dict) -> None:
        aside = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = self._files.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._at(f"manifest/{number}")
        if self._files.exists(target) or not self._files.rename(aside, target):
            self._files.delete(aside, False)
            raise Conflict(f"{self.path}: {number} is there already")

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _read(self, state: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{f}/_bucket={b}" for b, fs in state["folders"].items() if only is None or int(b) in only for f in fs]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._state()[1])

    def version(self) -> int:
        return self._latest()

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows by bucket, sorted by key, in a folder of their own; the folder and its buckets."""
        folder = uuid.uuid4().hex
        rows = self._bucket(rows.select(*self.schema.fieldNames()))
        rows.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(f"data/{folder}"))]
        return folder, [int(n.split("=")[1]) for n in names if n.startswith("_bucket=")]

    def _aside(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """The incoming rows as a table, for they are looked at more than once."""
        folder = f"incoming/{uuid.uuid4().hex}"
        rows = rows.where(F.col(self.key).isNotNull())
        rows.write.parquet(f"{self.path}/{folder}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}"), folder

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in self._bucket(rows.select(self.key)).select("_bucket").distinct().collect()]  # buckets, not rows

    def insert(self, rows: DataFrame, order: str) -> int:
        """Adds the rows whose key is new; returns how many. They go into folders beside the others of their buckets."""
        number, state = self._state()
        rows, folder = self._aside(rows)
        new = insert_or_ignore(self._read(state, self._touched(rows)), rows, self.key, order)
        written, own = self._write(new)
        self._files.delete(self._at(folder), True)
        if not own:
            self._files.delete(self._at(f"data/{written}"), True)
            return 0
        for b in own:
            state["folders"].setdefault(str(b), []).append(written)
        self._publish(number + 1, state)
        return self.spark.read.parquet(f"{self.path}/data/{written}").count()

    def upsert(self, rows: DataFrame, order: str) -> None:
        """Puts the rows in place of those with their keys; rewrites the touched buckets."""
        self._replace(rows, order)

    def delete(self, keys: DataFrame) -> None:
        """Removes the rows with the keys; rewrites the touched buckets."""
        self._replace(keys.select(self.key), None)

    def _replace(self, rows: DataFrame, order: str | None) -> None:
        number, state = self._state()
        rows, folder = self._aside(rows)
        touched = self._touched(rows)
        held = self._read(state, touched)
        stay = held.join(rows.select(self.key), self.key, "left_anti").select(*held.columns)
        if order is None:
            changed, both = held.join(rows, self.key, "left_semi").limit(1).count(), stay
        else:
            last = upsert(rows, self.key, order).select(*self.schema.fieldNames())
            changed, both = last.exceptAll(held).limit(1).count(), stay.unionByName(last)
        if changed:
            written, own = self._write(both)
            for b in touched:
                state["folders"].pop(str(b), None)
            for b in own:
                state["folders"][str(b)] = [written]
            self._publish(number + 1, state)
        self._files.delete(self._at(folder), True)

    def compact(self, most: int = 8) -> None:
        """Rewrites the buckets that lie in more than ``most`` folders."""
        number, state = self._state()
        many = [int(b) for b, fs in state["folders"].items() if len(fs) > most]
        if many:
            written, own = self._write(self._read(state, many))
            state["folders"] |= {str(b): [written] for b in own}
            self._publish(number + 1, state)

    def vacuum(self) -> int:
        """Removes folders that the table no longer lists, and older manifests; not while others read or write."""
        number, state = self._state()
        held = {f for fs in state["folders"].values() for f in fs}
        gone = 0
        for part, keep in (("data", held), ("manifest", {str(number)}), ("incoming", set())):
            if self._files.exists(self._at(part)):
                for s in self._files.listStatus(self._at(part)):
                    if s.getPath().getName() not in keep:
                        self._files.delete(s.getPath(), True)
                        gone += 1
        return gone
