"""Benchmark decontamination by canonical templates. DataFrame functions only.

A text's template is its sequence of words (runs of letters and digits), lower-cased, in which
numbers, units after a number and names (capitalised words that begin no sentence) are replaced by
typed placeholders; what stood there is the word's slot. Benchmark items are cut into windows at every
word, documents at every ``stride`` words, and the windows meet by hash. Each meeting fixes how item
and document lie against each other; there the templates are compared word by word over the item's
whole length. A document is contaminated if a stretch of at least ``min_run`` equal template words (all
words, for shorter items) has consistent slots: one slot value of the item always stands against one
slot value of the document, and different ones against different ones. Every consistent stretch counts,
also one that is a part of a longer run whose slots contradict each other. So a question with other
numbers, names or units is caught, and a chance meeting of placeholders is not.

A capitalised word that begins a sentence may be a name or not. It equals the same word, and is a name
slot against a name or another such word; windows that hold some meet in each of these readings.

A shared run of ``width + stride - 1`` words always holds one of the document's windows whole, so no
passage of that length is missed. Windows of fewer than ``min_literals`` words that are no placeholders would meet
each other everywhere, as rows of numbers or names do. They are keys as they were written, with their slots' values, and
items that have such windows also meet documents by whole runs of ``min_run`` words with literals enough (there
the words that may be names are read either all as names or all as words). A stretch without literals enough counts
if document and item agree in every value. ``min_run`` must not be below that length. Items of fewer than that many words are compared with every window of the documents that is as
long as the item, poor ones as they were written; of fewer than ``min_literals`` words altogether, in a single number or
name say, an item is no evidence and finds nothing.

Null or empty texts have no template. Rows with a null id are ignored. Repeated rows give one result
row. Of stretches of equal length the first counts. A text of any length is compared whole. An empty
documents or benchmark table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import finished, table, work_dir, written

#: Up to so many benchmark windows (some 20 bytes each) are broadcast; beyond, they are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: Items are broadcast with their words only while they have so many (some 20 bytes each) together.
BROADCAST_WORDS = 1_000_000
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hour hours day days week weeks month months year years percent usd eur gbp dollars dollar euros cents mph kmh hz w kw v degrees c f"


def template(text: Column) -> Column:
    """The template's words, joined by spaces; a placeholder is a control character (U+0001 unit,
    U+0002 name, U+0003 number) followed by what it stands for. U+0005 marks a capitalised word that may be a name."""
    t = F.regexp_replace(text, "[\x01\x02\x03\x05]", " ")
    # names: a capital letter then small ones, not at the start of the text, a line or a sentence
    t = F.regexp_replace(t, r"(\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+)(?![\p{L}\p{N}])", "\x05$1")
    t = F.lower(F.regexp_replace(t, r"\x05(?<=[\p{L}\p{N},;] \x05)", "\x02"))  # what is rare first: a look behind at every letter costs more
    t = F.regexp_replace(t, r"(?=\p{N})(?<![\p{L}\p{N}])(\p{N}+(?:[.,]\p{N}+)*)", " \x03$1 ")
    t = F.regexp_replace(t, r"(\x03[^ ]+ [ -]?)\x05?(" + "|".join(UNITS.split()) + r"|%)(?![\p{L}\p{N}])", "$1 \x01$2 ")
    other = r"[^\p{L}\p{N}\x01\x02\x03\x05%]"  # a single space stays, unmatched
    return F.btrim(F.regexp_replace(t, f"{other}(?:{other}++|(?<! ))|%(?<!\x01%)", " "))


def words_of(t: Column) -> Column:
    return F.when(F.coalesce(F.length(t), F.lit(0)) > 0, F.split(t, " +"))


def bare_slots(t: Column) -> Column:
    """A template without its slots' values."""
    return F.regexp_replace(t, "([\x01\x02\x03])[^ ]*", "$1")


def read_bare(t: Column) -> tuple[Column, Column]:
    """The words of a template without slots' values (``bare_slots``), where those that may be names are words, and where they are names."""
    some = F.length(t) > 0
    return F.when(some, F.split(F.replace(t, F.lit("\x05"), F.lit("")), " +")).alias("canon"), F.when(some, F.split(F.regexp_replace(t, "\x05[^ ]*", "\x02"), " +")).alias("named")


def canonical(templates: DataFrame, *keep: str) -> DataFrame:
    """``keep`` of ``templates(t, ...)`` with ``canon`` and ``named``, the words in both readings; each step is made once."""
    return templates.select(*keep, bare_slots(F.col("t")).alias("_bare")).select(*keep, *read_bare(F.col("_bare")))


def opened(words: Column, canon: Column, at: Column, n: Column) -> Column:
    """``n`` canonical words from ``at``, for a whole item: its first word may be a name only inside a document."""
    return F.concat(F.array(F.ltrim(F.get(words, at - 1), F.lit("\x02\x05"))), F.slice(canon, at + 1, n - 1))


def differing(plain: Column, named: Column, n: int) -> Column:
    """The readings of ``n`` words, as bit masks: each subset of the words that ``named`` has otherwise."""
    bits = sum(F.when(F.get(plain, F.lit(i)) != F.get(named, F.lit(i)), 1 << i).otherwise(0) for i in range(n))
    subsets = json.dumps([[m for m in range(whole + 1) if m & whole == m] for whole in range(1 << n)])
    return F.get(F.from_json(F.lit(subsets), "array<array<int>>"), bits)


def reading(plain: Column, named: Column, mask: Column, n: int) -> Column:
    return F.array(*[F.get(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, named).otherwise(plain), F.lit(i)) for i in range(n)])


def slot_runs(n: int, most_literals: int) -> str:
    """A pattern for templates, after a space, that have a window of ``n`` words of which at most ``most_literals`` are no placeholders
    (words that may be names counted as such). Each word allows one branch only, so a start costs ``n`` words at most."""
    rest = [""] * (most_literals + 1)
    for left in range(max(1, n - most_literals)):  # from the last placeholder to the first; rest[m]: m literals are left
        longer: list[str] = []
        for m in range(most_literals + 1):
            literal = f"| +[^ \x01\x02\x03\x05][^ ]*{longer[m - 1]}" if m and left < n - most_literals - 1 else ""
            longer.append(f"(?: +[\x01\x02\x03\x05][^ ]*{rest[m]}{literal})")
        rest = longer
    return rest[-1]


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 6, stride: int = 4, min_run: int = 13, min_literals: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, at_word, run_words, item_words)``: each contaminated document with each item
    found in it, at the place of the longest run (of equals, the first).

    Windows of fewer than ``min_literals`` words that are no placeholders meet by their words as written."""
    spark = docs.sparkSession
    base = work_dir(spark)
    if min_run < width + stride - 1:
        raise ValueError("min_run must be at least width + stride - 1")
    literals = lambda a: F.size(F.filter(a, lambda w: ~F.substring(w, 1, 1).isin("\x01", "\x02", "\x03")))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), template(F.col(item_text)).alias("t"))
    items = items.select("item_id", words_of(F.col("t")).alias("item"), bare_slots(F.col("t")).alias("bare")).select("item_id", "item", *read_bare(F.col("bare")))
    items = written(items.where("item is not null").dropDuplicates(), f"{base}/items")
    long_items, short_items = items.where(F.size("canon") >= width + stride - 1), items.where(F.size("canon") < width + stride - 1)

    at = long_items.select("item_id", "item", "canon", "named", F.explode(F.sequence(F.lit(1), F.size("canon") - width + 1)).alias("b"))
    readings = lambda df, n, *keep: df.select(*keep, "plain", "other", F.explode(differing(F.col("plain"), F.col("other"), n)).alias("mask")).select(*keep, reading(F.col("plain"), F.col("other"), F.col("mask"), n).alias("w"))
    windows = readings(at.select("item_id", "b", F.slice("canon", F.col("b"), width).alias("plain"), F.slice("named", F.col("b"), width).alias("other")), width, "item_id", "b").where(literals("w") >= min_literals)
    windows = written(windows.select(F.xxhash64("w").alias("h"), "b", "item_id").distinct(), f"{base}/windows")
    n_words = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    small = n_words <= BROADCAST_WORDS and windows.count() <= BROADCAST_WINDOWS

    # the templates are made once, into a table of their own
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), template(F.col(text_col)).alias("t"))
    texts = written(texts, f"{base}/templates")
    # no function with a lambda up to the join: the template stays in place while its windows pass
    texts = canonical(texts, "doc_id", "t")
    places = lambda n, step: F.explode(F.when(F.size("canon") >= n, F.sequence(F.lit(1), F.size("canon") - n + 1, F.lit(step)))).alias("a")
    cut = texts.select("doc_id", "t", "canon", "named", places(width, stride)).select("doc_id", "t", "a", F.slice("canon", F.col("a"), width).alias("plain"), F.slice("named", F.col("a"), width).alias("other"))
    cut = readings(cut, width, "doc_id", "t", "a").select("doc_id", "t", "a", F.xxhash64("w").alias("h"))
    # windows poor in literals: as they were written. Documents are looked at only if they have a run of placeholders
    bare = lambda c: F.ltrim(c, F.lit("\x02\x05"))
    plainly = lambda words, n: F.xxhash64(F.lit("as written"), F.array(*[bare(F.get(words, F.lit(i))) for i in range(n)]))
    slots, most_literals = "[\x01\x02\x03\x05][^ ]*", min_literals - 1
    rich_in_slots = lambda n: F.col("t").rlike(f"(?:^| )(?:{slots}(?: [^ ]+){{0,{most_literals}}}?(?: |$)){{{max(1, n - most_literals)}}}")
    either = (literals(F.slice("canon", F.col("b"), width)) < min_literals) | (literals(F.slice("named", F.col("b"), width)) < min_literals)
    poor = written(at.where(either).select("item_id", "b", plainly(F.slice("item", F.col("b"), width), width).alias("h")).distinct(), f"{base}/poor")
    met_poor = None
    if poor.limit(1).count():
        rich = written(texts.select("doc_id", "t").where(rich_in_slots(width)), f"{base}/rich")
        rich = canonical(rich, "doc_id", "t")
        raw = rich.select("doc_id", words_of(F.col("t")).alias("canon")).select("doc_id", "canon", places(width, stride))
        raw = raw.select("doc_id", "a", plainly(F.slice("canon", F.col("a"), width), width).alias("h"))
        met_poor = raw.join(F.broadcast(poor) if small else poor, "h").select("doc_id", "item_id", (F.col("a") - F.col("b")).alias("shift"))
        # and, with other values, by whole runs with literals enough: all that is compared of a short item, else min_run words.
        # Such a run holds one of the document's windows whole, so that without a poor window it has met already
        mixed = long_items.join(poor.select("item_id").distinct(), "item_id", "left_semi")
        dense = rich.where(F.concat(F.lit(" "), F.col("t")).rlike(slot_runs(width, most_literals)))
        for n in [r[0] for r in mixed.select(F.least(F.size("canon"), F.lit(min_run)).alias("n")).distinct().collect()]:
            runs = mixed.where(F.least(F.size("canon"), F.lit(min_run)) == n).select("item_id", "canon", "named", F.explode(F.sequence(F.lit(1), F.size("canon") - n + 1)).alias("b"))
            both = lambda c: F.explode(F.array(F.slice("canon", c, n), F.slice("named", c, n))).alias("w")
            runs = runs.select("item_id", "b", both(F.col("b"))).where(literals("w") >= min_literals).select("item_id", "b", F.xxhash64("w").alias("h")).distinct()
            wide = dense.select("doc_id", "canon", "named", places(n, 1)).select("doc_id", "a", both(F.col("a"))).select("doc_id", "a", F.xxhash64("w").alias("h"))
            met_poor = met_poor.unionByName(wide.join(F.broadcast(runs) if small else runs, "h").select("doc_id", "item_id", (F.col("a") - F.col("b")).alias("shift")))
        met_poor = written(met_poor.distinct(), f"{base}/met-poor")
        if met_poor.count() <= BROADCAST_WINDOWS:
            met_poor = F.broadcast(met_poor)
        met_poor = rich.select("doc_id", "t").join(met_poor, "doc_id").join(items.select("item_id", "item"), "item_id").select("doc_id", "t", "shift", "item_id", "item")

    if small:
        keys = F.broadcast(windows.groupBy("h").agg(F.collect_list(F.struct("b", "item_id")).alias("at")))
        met = cut.join(keys, "h").select("doc_id", "t", "a", F.explode("at").alias("x")).select("doc_id", "t", (F.col("a") - F.col("x.b")).alias("shift"), "x.item_id")
        met = met.join(F.broadcast(items.select("item_id", "item")), "item_id")
    else:
        pairs = cut.select("doc_id", "a", "h").join(windows, "h").select("doc_id", (F.col("a") - F.col("b")).alias("shift"), "item_id").distinct()
        met = texts.select("doc_id", "t").join(pairs, "doc_id").join(items.select("item_id", "item"), "item_id")
    if met_poor is not None:
        met = met.select("doc_id", "t", "shift", "item_id", "item").unionByName(met_poor)
    shift = F.col("shift")
    met = met.select("doc_id", "item_id", "item", "shift", F.slice(words_of(F.col("t")), F.greatest(shift + 1, F.lit(1)), F.size("item") + F.least(shift, F.lit(0))).alias("part"))
    met = met.dropDuplicates(["doc_id", "item_id", "shift"])

    # short items: one window as long as the item, at every word of the documents
    usable = short_items.where(literals("canon") >= min_literals)
    for n in [r[0] for r in usable.select(F.size("canon").alias("n")).distinct().collect()]:
        keys = usable.where(F.size("canon") == n).select("item_id", "item", opened(F.col("item"), F.col("canon"), F.lit(1), F.lit(n)).alias("plain"), F.col("named").alias("other"))
        keys = readings(keys, n, "item_id", "item").select("item_id", "item", F.xxhash64("w").alias("h"))
        every = texts.select("doc_id", "canon", "named", words_of(F.col("t")).alias("words")).select("doc_id", "canon", "named", "words", places(n, 1))
        every = every.select("doc_id", (F.col("a") - 1).alias("shift"), F.slice("words", F.col("a"), n).alias("part"), opened(F.col("words"), F.col("canon"), F.col("a"), F.lit(n)).alias("plain"), F.slice("named", F.col("a"), n).alias("other"))
        every = readings(every, n, "doc_id", "shift", "part").select("doc_id", "shift", "part", F.xxhash64("w").alias("h"))
        met = met.unionByName(every.join(F.broadcast(keys) if small else keys, "h").select("doc_id", "item_id", "item", "shift", "part"))

    poor_short = short_items.where((literals("canon") < min_literals) & (F.size("canon") >= min_literals))
    for n in [r[0] for r in poor_short.select(F.size("canon").alias("n")).distinct().collect()]:
        keys = poor_short.where(F.size("canon") == n).select("item_id", "item", plainly(F.col("item"), n).alias("h"))
        every = texts.where(rich_in_slots(n)).select("doc_id", "canon", words_of(F.col("t")).alias("words")).select("doc_id", "words", places(n, 1))
        every = every.select("doc_id", (F.col("a") - 1).alias("shift"), F.slice("words", F.col("a"), n).alias("part"))
        every = every.withColumn("h", plainly(F.col("part"), n))
        met = met.unionByName(every.join(F.broadcast(keys) if small else keys, "h").select("doc_id", "item_id", "item", "shift", "part"))

    # word by word: equal template words, and among them the longest consistent stretch
    lined = met.withColumn("from", F.greatest(-F.col("shift"), F.lit(0)))
    lined = lined.withColumn("mine", F.slice("item", F.col("from") + 1, F.size("part")))
    pairs = F.zip_with("part", "mine", lambda d, i: F.struct(bare(d).alias("d"), bare(i).alias("i"), F.substring(d, 1, 1).alias("k"), F.substring(i, 1, 1).alias("l")))
    slot = lambda c: c.isin("\x01", "\x02", "\x03")
    names = lambda x: x["k"].isin("\x02", "\x05") & x["l"].isin("\x02", "\x05")
    lined = lined.withColumn("p", pairs)
    lined = lined.withColumn("good", F.transform("p", lambda x: (x["d"] == x["i"]) | (slot(x["k"]) & (x["k"] == x["l"])) | names(x)))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    run = F.aggregate("good", zero, lambda s, g: F.struct(
        F.when(g, s["now"] + 1).otherwise(0).alias("now"),
        F.when(g, F.greatest(s["now"] + 1, s["best"])).otherwise(s["best"]).alias("best")), lambda s: s["best"])
    least = F.least(F.lit(min_run), F.size("item"))
    lined = lined.where(run >= least)
    bound = lambda x: slot(x["k"]) | (names(x) & (x["d"] != x["i"]))  # noqa: E731  # a word pair that enters the mapping
    lined = lined.withColumn("p", F.zip_with("p", "good", lambda x, g: F.struct(
        x["d"].alias("d"), x["i"].alias("i"), g.alias("good"), (g & bound(x)).alias("slot"), (g & ~slot(x["l"]) & ~bound(x)).alias("literal"))))
    # the stretch [start, n] that ends at each word; a contradiction with an earlier slot moves the start behind that
    zero = F.struct(F.lit(1).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("literals"), F.array().cast("array<struct<i:string,d:string,at:int>>").alias("seen"), F.lit(0).alias("best"), F.lit(0).alias("end"))

    def better(s: Column) -> list[Column]:
        more = (s["n"] - s["start"] + 1 > s["best"]) & (s["literals"] >= min_literals)
        return [F.when(more, s["n"] - s["start"] + 1).otherwise(s["best"]).alias("best"), F.when(more, s["n"]).otherwise(s["end"]).alias("end")]

    def step(s: Column, x: Column) -> Column:
        against = F.array_max(F.transform(F.filter(s["seen"], lambda y: (y["i"] == x["i"]) != (y["d"] == x["d"])), lambda y: y["at"]))
        start = F.greatest(s["start"], F.when(~x["good"], s["n"] + 2).when(x["slot"], against + 1))
        now = F.when(x["slot"], F.concat(s["seen"], F.array(F.struct(x["i"].alias("i"), x["d"].alias("d"), (s["n"] + 1).alias("at"))))).otherwise(s["seen"])
        left = F.size(F.filter(F.slice("p", s["start"], start - s["start"]), lambda y: y["literal"]))
        return F.struct(start.alias("start"), (s["n"] + 1).alias("n"), (s["literals"] + x["literal"].cast("int") - left).alias("literals"), F.filter(now, lambda y: y["at"] >= start).alias("seen"), *better(s))

    lined = lined.withColumn("run", F.aggregate("p", zero, step, lambda s: F.struct(*better(s))))
    # a stretch that agrees in every word as written needs no literals
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("at"), F.lit(0).alias("best"), F.lit(0).alias("end"))
    same = F.aggregate("p", zero, lambda s, x: F.struct(
        F.when(x["d"] == x["i"], s["now"] + 1).otherwise(0).alias("now"), (s["at"] + 1).alias("at"),
        F.when((x["d"] == x["i"]) & (s["now"] + 1 > s["best"]), s["now"] + 1).otherwise(s["best"]).alias("best"),
        F.when((x["d"] == x["i"]) & (s["now"] + 1 > s["best"]), s["at"] + 1).otherwise(s["end"]).alias("end")), lambda s: F.struct(s["best"].alias("best"), s["end"].alias("end")))
    lined = lined.withColumn("same", same)
    lined = lined.withColumn("run", F.when(F.col("same.best") > F.col("run.best"), F.col("same")).otherwise(F.col("run")))
    kept = lined.where(F.col("run.best") >= least)
    found = kept.select("doc_id", "item_id", (F.col("shift") + F.col("from") + F.col("run.end") - F.col("run.best")).cast("long").alias("at_word"), F.col("run.best").cast("long").alias("run_words"), F.size("item").cast("long").alias("item_words"))
    best = F.max(F.struct("run_words", (-F.col("at_word")).alias("at"), "item_words")).alias("m")
    out = found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("m.at")).alias("at_word"), F.col("m.run_words").alias("run_words"), F.col("m.item_words").alias("item_words"))
    return finished(out, base)


def op1_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
