"""Paragraphs: exploding, bullet islands, page headers and footers, budgeted chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions.text import SENTENCE_END, is_bullet, is_heading, strip_ascii
from docloom.sources.scratch import scratch

#: Fixed value: the letter that also ends a sentence in the batch script.
BATCH_END = "ฮ"


def tagged(paras: DataFrame) -> DataFrame:
    """Non-blank paragraphs, stripped, with heading and bullet flags."""
    rows = paras.withColumn("text", strip_ascii(F.col("text"))).where("text <> ''")
    return rows.withColumn("is_heading", is_heading(F.col("text"))).withColumn("is_bullet", is_bullet(F.col("text")))


def bullet_islands(paras: DataFrame, group: str, order: str, *carried: str) -> DataFrame:
    """Runs of bullet paragraphs become one, joined by line feeds, with the first one's place and ``carried`` columns."""
    w = W.partitionBy(group).orderBy(order)
    rows = tagged(paras).withColumn("prev", F.coalesce(F.lag("is_bullet").over(w), F.lit(False)))
    rows = rows.withColumn("island", F.sum((~(F.col("is_bullet") & F.col("prev"))).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = [F.min_by(c, order).alias(c) for c in carried]
    return rows.groupBy(group, "island").agg(F.min(order).alias(order), F.count("*").alias("n_paras"), *first, F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n").alias("text"))


def edge_lines(pages: DataFrame, n: int = 2) -> DataFrame:
    """First and last ``n`` non-blank lines of each page, as ``(source, page_no, side, line)``; computed within the row."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select("source", "page_no", lines.alias("l"))
    head = F.transform(F.slice("l", 1, n), lambda x: F.struct(F.lit("header").alias("side"), x.alias("line")))
    tail = F.transform(F.slice("l", F.greatest(F.size("l") - n + 1, F.lit(1)), n), lambda x: F.struct(F.lit("footer").alias("side"), x.alias("line")))
    return rows.select("source", "page_no", F.explode(F.concat(head, tail)).alias("e")).select("source", "page_no", "e.*")


def headers_footers(pages: DataFrame) -> DataFrame:
    """Edge lines that recur on at least max(3, a quarter) of a source's pages."""
    least = pages.groupBy("source").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 4)).alias("min_occ"))
    counts = edge_lines(pages).groupBy("source", "side", "line").agg(F.count("*").alias("n"))
    kept = counts.join(least, "source").where("n >= min_occ")
    return kept.where(F.length("line") >= F.when(F.col("side") == "header", 5).otherwise(3)).select("source", "side", "line", "n", "min_occ")


def strip_headers_footers(pages: DataFrame, window: int = 4) -> DataFrame:
    """Blanks the first header in the first ``window`` lines and the last footer in the last ones."""
    known = headers_footers(pages).groupBy("source").agg(F.collect_set(F.when(F.col("side") == "header", F.col("line"))).alias("hs"), F.collect_set(F.when(F.col("side") == "footer", F.col("line"))).alias("fs"))
    rows = pages.join(known, "source", "left").withColumn("l", F.when(F.col("hs").isNotNull(), F.split("text", "\n"))).withColumn("i", F.when(F.col("l").isNotNull(), F.sequence(F.lit(0), F.size("l") - 1)))
    at = lambda i: F.trim(F.get("l", i))
    rows = rows.withColumn("h", F.array_min(F.filter("i", lambda i: (i < window) & F.array_contains("hs", at(i))))).withColumn("f", F.array_max(F.filter("i", lambda i: (i >= F.size("l") - window) & F.array_contains("fs", at(i)))))
    # without lines known of its source a text is as it was
    body = F.when(F.col("hs").isNull(), F.col("text")).otherwise(F.array_join(F.transform("l", lambda x, i: F.when((i == F.coalesce("h", F.lit(-1))) | (i == F.coalesce("f", F.lit(-1))), "").otherwise(x)), "\n"))
    return rows.select("source", "page_no", body.alias("body"), F.trim(F.get("l", F.col("h"))).alias("header"), F.trim(F.get("l", F.col("f"))).alias("footer"))


def estimate(text: str) -> int:
    return max(1, ceil(len(text) / 4))


def cut_sentences(text: str, most: int, batch: bool) -> list[str]:
    """The sentences of a paragraph; in the batch script's way one more letter ends a sentence, and a paragraph of
    a single one is cut into pieces of a fixed width, three fifths of the budget."""
    if not batch:
        return re.split(f"(?<=[{SENTENCE_END}])\\s+", text)
    text = text.strip()
    parts = re.split(f"(?<=[{SENTENCE_END}{BATCH_END}])\\s+", text)
    width = max(300, int(most * 4 * 0.6))
    return [p for p in parts if p.strip()] if len(parts) > 1 else [text[i:i + width] for i in range(0, len(text), width)]


class Fold:
    """The chunks of one source's ordered paragraphs, which are added one after another.

    ``compat`` keeps two quirks: a closed chunk is prefixed with its own tail, and of a paragraph over
    the budget only the last sentence buffer stays. Without it the tail goes to the next chunk and all
    buffers stay. ``batch`` is the batch script's way: a chunk that a heading closes gets no tail, and sentences are
    cut as it does. With ``compat`` nothing is carried over a heading, so a fold may as well begin there."""

    def __init__(self, most: int = 800, overlap: float = 0.12, compat: bool = True, batch: bool = False):
        self.most, self.overlap, self.compat, self.batch = most, overlap, compat, batch
        self.out: list[dict] = []
        self.held: list[tuple[int, str]] = []
        self.used, self.carry = 0, ""

    def close(self, tail: bool) -> None:
        if not self.held:
            return
        body = "\n\n".join(t for _, t in self.held).strip()
        n = int(self.overlap * len(body)) if tail else 0
        end = body[len(body) - n:] if n else ""
        before = end if self.compat else self.carry
        text = f"{before}\n{body}" if before else body
        self.out.append({"text": text, "page_start": min(p for p, _ in self.held), "page_end": max(p for p, _ in self.held), "tokens_est": estimate(text)})
        self.used, self.carry = 0, "" if self.compat else end
        self.held.clear()

    def add(self, page: int, text: str, heading: bool) -> None:
        if heading:
            self.close(not self.batch)
        size = estimate(text)
        if self.used + size > self.most:
            self.close(True)
            if size > self.most:
                buffer = ""
                for s in cut_sentences(text, self.most, self.batch):
                    if buffer and estimate(f"{buffer} {s}") > self.most:
                        if not self.compat:
                            self.held.append((page, buffer))
                            self.close(True)
                        buffer = s
                    else:
                        buffer = f"{buffer} {s}".strip()
                text, size = buffer, estimate(buffer)
        self.held.append((page, text))
        self.used += size

    def take(self) -> list[dict]:
        out, self.out = self.out, []
        return out


def fold_paragraphs(paras: list[tuple[int, str, bool]], most: int = 800, overlap: float = 0.12, compat: bool = True, batch: bool = False) -> list[dict]:
    """The chunks of one source's ordered paragraphs (page, text, is_heading)."""
    fold = Fold(most, overlap, compat, batch)
    for page, text, heading in paras:
        fold.add(page, text, heading)
    fold.close(False)
    return fold.take()


def segmented(paras: DataFrame, group: str, order: str, page: str, path: str, at_headings: bool = True) -> DataFrame:
    """``(segment, id, group, page, text, is_heading, is_bullet)``: the non-blank paragraphs, numbered in the order of
    the table, with the number of the stretch they are in. A stretch begins at each new group and, with
    ``at_headings``, at each heading, so that a group of any size is many stretches.

    A heading also ends the stretch before it, which gets a row without text for that, of the heading's group.

    The rows are sorted over the whole table once and numbered where they lie; what a partition's first rows go on
    with is told by the partitions' ends, a row for each."""
    spark = paras.sparkSession
    # by the stripped text, as ``tagged`` has it
    rows = tagged(paras.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col(page).cast("long").alias("page"), "text"))
    rows.write.mode("overwrite").parquet(f"{path}/paragraphs")  # the sort reads its input twice
    rows = spark.read.schema(rows.schema).parquet(f"{path}/paragraphs").orderBy(F.asc_nulls_first("_group"), "_order").select(F.monotonically_increasing_id().alias("id"), "_group", "page", "text", "is_heading", "is_bullet")
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], T.StructField("local", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, -1
        for batch in batches:
            local, marks = [], []
            for i, (g, heading) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())):
                heading = at_headings and heading
                if heading and (n < 0 or g == last):
                    marks.append((i, n))
                if n < 0 or g != last or heading:
                    n += 1
                last = g
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=shape.names)
            ends = batch.take(pa.array([i for i, _ in marks], pa.int64()))
            none = pa.nulls(len(marks), pa.string())
            yield pa.RecordBatch.from_arrays([*ends.columns[:3], none, *ends.columns[4:], pa.array([x for _, x in marks], pa.int64())], names=shape.names)

    rows.mapInArrow(run, shape).write.mode("overwrite").parquet(f"{path}/sorted")
    rows = spark.read.schema(shape).parquet(f"{path}/sorted").withColumn("part", F.shiftright("id", 33))
    first, last = F.min_by(F.struct("_group", "is_heading"), "id"), F.max_by(F.struct("_group"), "id")
    ends = rows.where("text is not null").groupBy("part").agg(first.alias("first"), last.alias("last"), (F.max("local") + 1).alias("n"))
    w = W.orderBy("part")  # a row for each partition
    goes_on = F.lag("part").over(w).isNotNull() & F.lag("last._group").over(w).eqNullSafe(F.col("first._group")) & ~(F.col("first.is_heading") & F.lit(at_headings))
    ends = ends.select("part", "n", goes_on.cast("long").alias("goes_on"))
    base = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.sum("goes_on").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.join(F.broadcast(ends.select("part", base.alias("base"))), "part")
    return rows.select((F.col("base") + F.col("local")).alias("segment"), "id", F.col("_group").alias(group), "page", "text", "is_heading", "is_bullet")


def chunks(paras: DataFrame, group: str, order: str, page: str, most: int = 800, compat: bool = True, batch: bool = False, path: str | None = None) -> DataFrame:
    """Chunks of each group, bullets in a row taken together: ``(group, chunk, text, page_start, page_end, tokens_est)``.

    Every task folds the stretches between headings (``segmented``) that fall to it, one row after another, and holds
    one chunk; a group is spread over the tasks by its headings. Tables go below ``path``."""
    spark = paras.sparkSession
    path = f"{path or scratch(spark)}/chunks"
    kind = paras.schema[group].dataType
    rows = segmented(paras, group, order, page, path, compat).repartition("segment").sortWithinPartitions("segment", "id")
    shape = T.StructType([T.StructField(group, kind), T.StructField("segment", T.LongType()), T.StructField("_nth", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("page_start", "page_end", "tokens_est")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now, nth, bullets, done, tail = Fold(most, compat=compat, batch=batch), None, 0, [], [], False

        def flush() -> None:
            if bullets:
                fold.add(bullets[0][0], "\n".join(t for _, t in bullets), False)
                bullets.clear()

        def emit() -> None:
            nonlocal nth
            for c in fold.take():
                done.append((*now, nth, c["text"], c["page_start"], c["page_end"], c["tokens_est"]))
                nth += 1

        def end() -> None:
            nonlocal fold, nth, tail
            flush()
            fold.close(tail)
            emit()
            fold, nth, tail = Fold(most, compat=compat, batch=batch), 0, False

        def table() -> pa.RecordBatch:
            cols = list(zip(*done)) or [()] * len(shape)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, to_arrow_schema(shape).types)], names=shape.names)

        for part in batches:
            for segment, _, g, p, text, heading, bullet in zip(*(c.to_pylist() for c in part.columns)):
                if now is None or now[1] != segment:
                    if now:
                        end()
                    now = (g, segment)
                if text is None:  # a heading comes next
                    tail = g == now[0] and not batch
                elif bullet:
                    bullets.append((p, text))
                else:
                    flush()
                    fold.add(p, text, heading)
                    emit()
            yield table()
        if now:
            end()
        yield table()

    rows.mapInArrow(run, shape).write.mode("overwrite").parquet(f"{path}/folded")
    found = spark.read.schema(shape).parquet(f"{path}/folded")
    before = F.sum("n").over(W.partitionBy(group).orderBy("segment").rowsBetween(W.unboundedPreceding, -1))
    sizes = found.groupBy(group, "segment").agg(F.count("*").alias("n")).select("segment", F.coalesce(before, F.lit(0)).alias("_before"))
    return found.join(sizes, "segment").select(group, (F.col("_before") + F.col("_nth")).alias("chunk"), "text", "page_start", "page_end", "tokens_est")


def numbered(df: DataFrame, name: str, path: str, *order: str) -> DataFrame:
    """``df`` with its rows' ordinal from 0 over the whole table: a range-partitioned sort, written below
    ``path``, whose partitions' sizes are added up."""
    rows = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
