"""Audit of how filters interact: every order of the filters is replayed over every document.

Each document carries the flags of the filters that it fails, one bit each. It is crossed with a broadcast
table of all orders of the filters (a fixed number of rows, 120 for five filters), its first failing step is
found, and its five steps are exploded. The counts of a part, an order and a step are conditional aggregates,
combined on the map side, so that a task passes on one row for each part, order and step that it met, however
many documents it read; a source with a third of all rows weighs no more than others. The Shapley sum of a
filter adds up what it removes over all orders.

"Identical to a smaller id's text" is decided over the whole table: the least id of each text (by a 128-bit
hash) comes from a map-side aggregate, and only texts that occur again are joined back; Spark splits that join
where one text holds many of the rows.

Null texts are empty, null parts are the part of the empty string. Rows with a null id count like others, but
are identical to no smaller id and have no labels; rows that repeat an id count each, and none is the smaller.
Of an id's labels any that is set counts. Ties don't occur. Texts of any length are whole. A document that
fails nothing is kept at every step. Other columns, whatever their names, are ignored. An empty table gives an
empty result, empty labels give no losses.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm.common import finished, split_words, table, work_dir, written

LETTERS = "ABCDE"


def row_flags(text: Column) -> list[Column]:
    """The conditions that a text fails by itself: short, repetitive, shouting, symbols."""
    words = split_words(text)
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
            100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text), text.rlike("[#$%&*|]")]


def flagged(docs: DataFrame, labels: DataFrame, work: str, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(part, fails, good, toxic)`` of each row: the bits of the filters A to E that it fails, and its labels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(row_flags(F.col("said")))), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("said"))
    rows = rows.select("doc_id", "part", bits.alias("own"), F.xxhash64("said").alias("h1"), F.xxhash64(F.lit("text"), "said", F.length("said")).alias("h2"))
    rows = written(rows, f"{work}/rows")
    again = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(again, ["h1", "h2"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << 4).otherwise(0)
    return rows.select("part", (F.col("own") + copy).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replay(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of
    ``rows(part, fails, good, toxic)``; bit i of ``fails`` is the i-th letter's filter. Meant for few filters:
    a row is replayed in every order of them."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    every = [("".join(p), [bit[c] for c in p]) for p in permutations(letters)]
    orders = rows.sparkSession.createDataFrame([(i, x) for i, (_, x) in enumerate(every)], "nr short, filters array<int>")
    fails = lambda x: F.col("fails").bitwiseAND(x) != 0
    first = F
    for k in range(len(letters)):
        first = first.when(fails(F.get("filters", F.lit(k))), k)
    crossed = rows.crossJoin(F.broadcast(orders)).withColumn("first", first.otherwise(len(letters)))
    steps = crossed.select("part", "nr", "fails", "first", "good", "toxic", F.posexplode("filters").alias("at", "own"))
    gone = F.col("first") == F.col("at")
    counts = steps.groupBy("part", "nr", "at").agg(
        F.count_if(F.col("first") > F.col("at")).alias("kept"), F.count_if(gone).alias("removed"), F.count_if((F.col("first") < F.col("at")) & fails(F.col("own"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("own")).alias("unique_fails"), F.count_if(gone & F.col("good")).alias("good_lost"), F.count_if(gone & F.col("toxic")).alias("toxic_lost"))
    names = F.array(*[F.lit(x) for x, _ in every])
    counts = counts.select("part", F.get(names, F.col("nr")).alias("filter_order"), (F.col("at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    # one row for each part, order and step by now: a filter has 120 rows in a part
    over = W.partitionBy("part", F.substr("filter_order", "step", F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(over))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    work = work_dir(spark)
    rows = flagged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), work)
    return finished(replay(rows), work)


_WORDS = r"list_filter(string_split_regex(said, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as said from documents),
w as (select *, {_WORDS} as x, min(doc_id) over (partition by said) as least from t),
f as (
  select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad,
         {{'A': len(x) < 50, 'B': 100 * len(list_distinct(x)) < 65 * len(x),
           'C': 100 * length(regexp_replace(said, '[^A-Z]', '', 'g')) > 5 * length(said),
           'D': regexp_matches(said, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)}} as f
  from w left join labels l on w.doc_id = l.doc_id
), g as (
  select part, good, bad, map {{'A': f.A, 'B': f.B, 'C': f.C, 'D': f.D, 'E': f.E}} as f, f.A::int + f.B::int + f.C::int + f.D::int + f.E::int as n_fails from f
), l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r as (
  select part, good, bad, n_fails, f, filter_order, coalesce(list_position(list_transform(string_split(filter_order, ''), lambda y: f[y]), true), 6) as first from g, o
), s as (
  select r.*, step, f[filter_order[step:step]] as own from r, (select unnest(range(1, 6))::int as step)
), a as (
  select part, filter_order, step, filter_order[step:step] as letter, count(*) filter (first > step) as kept, count(*) filter (first = step) as removed,
         count(*) filter (own and first < step) as redundant, count(*) filter (own and n_fails = 1) as unique_fails,
         count(*) filter (first = step and good) as good_lost, count(*) filter (first = step and bad) as toxic_lost
  from s group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, letter)::bigint as shapley from a
"""
