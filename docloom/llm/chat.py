"""Chat formatting of reply trees. DataFrame functions only.

Messages form trees: each names the message it replies to. Pointer-doubling self-joins give every
message the depth and the score of its path from the root (a path of n messages takes log2 n rounds); a
row stays as small as at the start, whatever the depth. The leaves are ranked by the score of their paths
in each tree. The messages of the chosen paths alone are then enumerated by the rounds' pointers, the longest
first: each self-join with one round doubles the places known of a path. Each chosen path is formatted as
one conversation.

The template marks turns as ``<turn role>text</turn>`` and a line feed. In roles and texts ``&``, ``<``,
``>`` and ``[`` are replaced by entities (roles also escape white space), so no control string of any
template survives inside a text, and unescaping gives the text back. The loss mask is an array of
code-point spans of the assistant texts in the formatted conversation.

Null texts and roles are empty. Messages whose parent is missing are roots. Rows with a null
conversation id form one conversation of id null. Ties of rank go to the smaller leaf. Messages in or
below a cycle reach no root and are left out. Repeated rows of a plain conversation are turns of their own.
In a plain conversation each turn replies to the one before it. The self-joins climb over all its turns; its one leaf's
path holds every turn, at the depth that they give, so that each round's table goes with the next, and its texts
are shuffled once, whatever its depth.
A conversation is one row, so that it must fit into one; very long texts are whole. Other columns, whatever
their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm.common import finished, remove, table, work_dir, written

ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"))
ROLE_ENTITIES = ((" ", "&#32;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"))


def escape(text: Column, more: tuple = ()) -> Column:
    for a, b in (*ENTITIES, *more):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column, more: tuple = ()) -> Column:
    for a, b in reversed((*ENTITIES, *more)):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def climb(messages: DataFrame, work: str) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves ``(tree, leaf, depth, score)`` of ``messages(tree, id, parent, score)`` that have a root, and each
    round's pointers ``(tree, id, up)``, 1, 2, 4, ... messages upwards. Ids are unique in a tree."""
    rows = messages.select("tree", "id", "parent", "score")
    known = rows.select(F.col("tree").alias("t"), F.col("id").alias("p")).distinct()
    now = rows.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    now, rounds = doubled(now.select("tree", "id", F.col("p").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total")), work)
    parents = rows.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    ends = now.where("up is null").join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    return ends.select("tree", F.col("id").alias("leaf"), "depth", F.col("total").alias("score")), rounds


def doubled(now: DataFrame, work: str, keep: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """``now(tree, id, up, total, ...)`` with ``depth``, and with the sum of ``total`` from the root, after the last of
    the self-joins; and, if they are to be kept, each round's pointers. ``up`` stays where there is no root."""
    # depth and total are of the chain down to the message, whose top has `up` above it
    carried = [c for c in now.columns if c not in ("tree", "id", "up", "total")]
    now = written(now.select("tree", "id", "up", F.lit(1).cast("long").alias("depth"), "total", *carried), f"{work}/0")
    rounds, left, n = [], now.where("up is not null").count(), 0
    while left:
        opened = now.where("up is not null")
        if keep:
            rounds.append(opened.select("tree", "id", "up"))
        above = now.select(F.col("tree").alias("t"), F.col("id").alias("a"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        step = opened.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("a")))
        step = step.select("tree", "id", F.col("up2").alias("up"), (F.col("depth2") + F.col("depth")).alias("depth"), (F.col("total2") + F.col("total")).alias("total"), *carried)
        n += 1
        now = written(now.where("up is null").unionByName(step), f"{work}/{n}")
        if not keep:
            remove(now.sparkSession, f"{work}/{n - 1}")
        before, left = left, now.where("up is not null").count()
        if left == before:  # while a path is open, one of each smaller depth ends in every round: these are cycles
            break
    return now, rounds


def trace(leaves: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``leaves(tree, leaf, depth, ...)`` with ``path``, the array of ids from the root."""
    steps = leaves.select("*", F.col("leaf").alias("id"), (F.col("depth") - 1).alias("pos"))
    for k in reversed(range(len(rounds))):
        up = rounds[k].select(F.col("tree").alias("t"), F.col("id").alias("m"), "up")
        steps = steps.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("m")), "left")
        here, there = F.struct("id", "pos"), F.struct(F.col("up").alias("id"), (F.col("pos") - 2 ** k).alias("pos"))
        steps = steps.select(*leaves.columns, F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")).select(*leaves.columns, "x.*")
    found = steps.groupBy(*leaves.columns).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return found.select(*leaves.columns, F.col("x.id").alias("path"))


def paths(messages: DataFrame, work: str) -> DataFrame:
    """``(tree, leaf, path, score)`` of every root-to-leaf path of ``messages(tree, id, parent, score)``."""
    return trace(*climb(messages, work)).select("tree", "leaf", "path", "score")


def best_paths(found: DataFrame, per_tree: int = 1) -> DataFrame:
    """The ``per_tree`` paths or leaves ``(tree, leaf, score, ...)`` of each tree with the highest scores, and their
    rank; of equals, the smaller leaf."""
    if per_tree == 1:  # aggregates on the map side, whatever the tree's size
        one = F.max_by(F.struct(*[c for c in found.columns if c != "tree"]), F.struct("score", (-F.col("leaf")).alias("o")))
        return found.groupBy("tree").agg(one.alias("x")).select("tree", "x.*", F.lit(1).alias("rank"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return found.withColumn("rank", rank).where(F.col("rank") <= per_tree)


def formatted(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """``(tree, rank, n_turns, text, loss)``: the chosen paths' conversations and their loss masks
    (0-based start and length in code points)."""
    turns = chosen.select("tree", "rank", F.posexplode("path").alias("pos", "id"))
    said = messages.select(F.col("tree").alias("t"), F.col("id").alias("m"), "role", "text")
    turns = turns.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("m")))
    return joined_turns(turns.select("tree", "rank", "pos", "role", "text"), ["tree", "rank"], ["pos"])


def joined_turns(turns: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``(*by, n_turns, text, loss)`` of ``turns``, ordered by ``order``, nulls first; rows that lie together by some of
    ``by`` already are not shuffled again."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    head, body = F.concat(F.lit("<turn "), escape(role, ROLE_ENTITIES), F.lit(">")), escape(text)
    turn = F.concat(head, body, F.lit("</turn>\n"))
    before = F.sum("chars").over(W.partitionBy(*by).orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(W.unboundedPreceding, -1))
    placed = turns.withColumn("chars", F.length(turn)).withColumn("before", F.coalesce(before, F.lit(0)))
    placed = placed.select(*by, F.struct((F.col("before") + F.length(head)).cast("int").alias("start"), turn.alias("turn"), F.length(body).alias("length"), (role == "assistant").alias("learn")).alias("x"))
    whole = placed.groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("x"))
    spans = F.transform(F.filter("x", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select(*by, F.size("x").cast("long").alias("n_turns"), F.array_join("x.turn", "").alias("text"), spans.alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """Turns (role, text) and learned text, recovered from the formatted conversations alone."""
    parts = F.filter(F.split("text", "</turn>\n"), lambda x: x != "")
    turns = F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(7)), ">", 1), ROLE_ENTITIES).alias("role"),
        unescape(F.substr(x, F.instr(x, ">") + 1)).alias("text")))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr("text", s["start"] + 1, s["length"]))), "")
    return rows.select("*", turns.alias("turns"), learned.alias("learned"))


def chain(turns: DataFrame, work: str) -> DataFrame:
    """``(tree, id, parent, at)``: the reply chains of plain conversations, a message for each turn.

    Each turn of ``turns(tree, at)`` replies to the one before it, nulls first. The sort is over all turns, so that a
    conversation of any length is spread over many tasks; ids ascend in a conversation. Texts take no part."""
    rows = turns.select("tree", "at").distinct().orderBy(F.asc_nulls_first("tree"), F.asc_nulls_first("at"))
    rows = written(rows.select("tree", "at", F.monotonically_increasing_id().alias("id")), f"{work}/sorted")
    # ids count on inside a partition, so only a conversation's first turn of each partition needs to look for its parent:
    # the window holds a row for each partition that a conversation reaches into
    parts = rows.groupBy("tree", F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    above = F.lag("last").over(W.partitionBy("tree").orderBy("part"))
    linked = rows.join(parts.select("first", above.alias("above")), F.col("id") == F.col("first"), "left")
    return linked.select("tree", "id", F.when(F.col("first").isNull(), F.col("id") - 1).otherwise(F.col("above")).alias("parent"), "at")


def plain_conversations(conversations: DataFrame, work: str, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``(tree, n_turns, text, loss)`` of plain conversations, by way of their reply chains.

    Rows are ordered by turn, nulls first, then role and text; rows of one turn are one message of the chain, and
    repeated rows stay turns of their own. The texts are read at the end only and shuffled once, to their conversation."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).alias("at"), "role", "text")
    messages = chain(rows, work).select("tree", "id", F.col("parent").alias("up"), F.lit(0.0).alias("total"), "at")
    known, _ = doubled(messages, f"{work}/rounds", keep=False)
    remove(known.sparkSession, f"{work}/sorted")
    # a message's place in the path of its conversation's only leaf goes the texts' way and is handed to the rows of its turn
    places = known.select("tree", "at", F.col("depth").alias("place"))
    both = rows.unionByName(places, allowMissingColumns=True).withColumn("none", F.col("tree").isNull()).withColumn("tree", F.coalesce("tree", F.lit(0)))
    turn = W.partitionBy("tree", "none", "at").orderBy(F.desc_nulls_last("place")).rowsBetween(W.unboundedPreceding, 0)
    turns = both.repartition("tree", "none").withColumn("pos", F.first("place").over(turn)).where("place is null")
    done = joined_turns(turns.select("tree", "none", "pos", "role", "text"), ["tree", "none"], ["pos", "role", "text"])
    return done.select(F.when(~F.col("none"), F.col("tree")).alias("tree"), "n_turns", "text", "loss")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """A conversation -1 in the table itself is one with the added one, in the order of their turns."""
    work = work_dir(spark)
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(control).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = read_back(plain_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra), work))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = rows.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), sha(F.col("learned")).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))
    return finished(rows, work)


SQL = """
with c as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;') as e from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role) + length(e) + length('<turn ></turn>') + 1)::bigint as formatted_chars
from t group by conv_id
"""
