"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A run is a Parquet table of line keys (a 128-bit hash), sorted by key within hash partitions, with the
number of documents that hold the line and the largest of their ids. Batches of documents arrive one
after another. Each new batch is merged with the runs by a sort-merge anti-join on the key: keys that no
run has yet are its own, the others only count again. Both go into a new run at level 0, so every key is
``own`` in one run alone; ``fan`` runs of a level are compacted into one of the next.

The corpus query reads the documents once for their lines, which it writes as keys, and feeds them in
batches. "At least ``min_docs`` documents, and the largest id keeps the line" needs the counts over all
batches, so the runs are merged at the end, and the lines meet the keys that must go.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Null and empty texts
are one empty line. Rows with a null id are left whole and count for no key; repeated rows count as
one document and are each returned; where rows of one id differ, each keeps or loses its own lines. Ties
don't occur: of the ids that hold a line, the largest keeps it, in every row and place. A text of any
length is one row, a line of any length one key. An empty table gives an empty result; other columns pass
through, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, ascii_lower, remove, table, work_dir, working, written

#: Up to so many keys (24 bytes each) are broadcast; beyond, both sides are sorted and merged.
BROADCAST_KEYS = 400_000


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(bare.rlike("[^\\x00-\\x7F]"), ascii_lower(bare)).otherwise(F.lower(bare))


def hashed(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key, F.length(key)).alias("h2")]


RUN = "h1 long, h2 long, n_docs long, last_doc long, own boolean"


class LineRuns:
    """Levelled sorted runs below a folder that all executors share."""

    def __init__(self, spark, base: str, fan: int = 2):
        self.spark, self.base, self.fan = spark, base, fan
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.base}/run-{level}-{self.made}"
        self.made += 1
        written(rows.sortWithinPartitions("h1", "h2"), path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merge(old), level + 1)
            for p in old:
                remove(self.spark, p)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _merge(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.max("own").alias("own"))

    def _paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def add(self, lines: DataFrame) -> None:
        """``lines(doc_id, h1, h2)`` of one batch; no document may be in two batches."""
        once = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("n"))
        batch = once.groupBy("h1", "h2").agg(F.count("n").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if not self._paths():
            self._write(batch.withColumn("own", F.lit(True)), 0)
            return
        batch = written(batch, f"{self.base}/batch-{self.made}")
        own = self.unseen(batch).withColumn("own", F.lit(True))
        again = batch.join(self._keys(), ["h1", "h2"], "left_semi").withColumn("own", F.lit(False))
        path = f"{self.base}/batch-{self.made}"
        self._write(own.unionByName(again), 0)
        remove(self.spark, path)

    def merged(self) -> DataFrame:
        """Every key once, with the number of documents and the largest id."""
        paths = self._paths()
        return (self._read(paths) if len(paths) < 2 else self._merge(paths)).drop("own")

    def _keys(self) -> DataFrame:
        return self._read(self._paths()).where("own").select("h1", "h2").hint("merge")

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines (or keys) of a new batch whose keys are in no run: a merge anti-join."""
        return lines.join(self._keys(), ["h1", "h2"], "left_anti")


def exploded(docs: DataFrame, text_col: str, min_chars: int, *carried: Column) -> DataFrame:
    """Lines with keys of at least ``min_chars`` code points: carried columns, pos, h1, h2."""
    lines = docs.select(*carried, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return lines.select("*", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars).select(*[c for c in lines.columns if c != "line"], *hashed("key"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fan: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` cut down, plus ``n_lines`` (before) and ``n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines except in the largest id that holds them. The other lines stay, joined by a line feed.
    """
    spark = docs.sparkSession
    base = work_dir(spark)
    docs = docs.drop("n_lines", "n_dropped")
    id_ = F.col(id_col).cast("long")
    # the text's hash tells rows with one id apart
    lines = exploded(docs.where(F.col(id_col).isNotNull()), text_col, min_chars, id_.alias("_id"), F.xxhash64(text_col).alias("_text"))
    lines.withColumn("batch", F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(f"{base}/lines")
    lines = spark.read.schema("_id long, _text long, pos int, h1 long, h2 long, batch int").parquet(f"{base}/lines")
    runs = LineRuns(spark, f"{base}/runs", fan)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i).select(F.col("_id").alias("doc_id"), "h1", "h2"))
    goes = written(runs.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"), f"{base}/goes")
    remove(spark, f"{base}/runs")
    if goes.count() <= BROADCAST_KEYS:
        goes = F.broadcast(goes)
    lost = lines.join(goes, ["h1", "h2"]).where("_id <> last_doc").groupBy("_id", "_text").agg(F.collect_set("pos").alias("_lost"))
    lost = written(lost, f"{base}/lost")
    for name in ("lines", "goes"):
        remove(spark, f"{base}/{name}")
    own, hash_, gone, cut = working(docs.columns, "id", "text", "lost", "lines")
    lost = lost.select(F.col("_id").alias(own), F.col("_text").alias(hash_), F.col("_lost").alias(gone))
    out = docs.withColumn(own, id_).withColumn(hash_, F.xxhash64(text_col)).join(lost, [own, hash_], "left")
    out = out.withColumn(cut, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n"))
    kept = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, F.size(cut).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, u.pos as pos, u.line as line,
         translate(trim(u.line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) as u from documents)
), gone as (
  select k, max(doc_id) as last_doc from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), marked as (
  select l.doc_id, l.pos, l.line, coalesce(g.last_doc <> l.doc_id, false) as goes from lines l left join gone g on l.k = g.k
)
select doc_id, count(*) as n_lines, count(*) filter (goes) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not goes), '')) as kept_sha256
from marked group by doc_id
"""
