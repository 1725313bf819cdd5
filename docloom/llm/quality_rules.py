"""Quality rules as a learned decision list. DataFrame functions only.

The statistics of a text are columns computed inside its row, without any shuffle. A decision list is
learned by sequential covering on a bounded sample of labelled documents (``max_rows``): a rule, a
conjunction of thresholds, is grown on two thirds of the rows by FOIL's information gain and pruned on
the last third, and what it covers is taken away. A rule below ``min_precision`` is left out; the bad rows
that it covers are set aside for the rules to come, which are learned from the rest. The list becomes one
ordered conditional expression.

Repeated windows are found by sorting their hashes; where two equal hashes are of different words, as
happens in texts of millions of words, the windows of that text are sorted as words instead.

Null texts have no words; every ratio of an empty text is 0. Rows with a null id are scored like the
others. Rows are neither dropped nor merged, repeated rows are scored alike, and equal windows or lines
count however far apart they stand. A text of any length is one row. Columns named like a statistic give
way to it. Without labels, or with labels of one class, nothing is rejected beyond the base rule; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_CLASS, SPACES, split_words, table, work_dir, written

FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate", "distinct_rate", "line_words"]


def statistics(docs: DataFrame, text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``docs`` with the base statistics and ``FEATURES``, in place of the text. Fewer ``hash_bits`` change no result."""
    made = {c.lower() for c in (text_col, *FEATURES, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    names = ["_row"]  # the table's own columns, apart from the working ones
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")).cast("long")
    rows = docs.select(F.struct(*kept or [F.lit(0)]).alias("_row"), text.alias("_t"))
    rows = rows.select(*names, size(f"{SPACE_CLASS}+").alias("word_chars"), size("[^#*$%&|<>]+").alias("n_symbols"), size("[^\\p{Lu}]+").alias("_upper"), size("[^!?*#$%&|<>@=+~^_]+").alias("_marks"), size("[^0-9]+").alias("_digits"),
                       F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"), split_words(F.col("_t")).alias("_w"))
    rows = rows.select(*names, "word_chars", "n_symbols", "_upper", "_marks", "_digits", "_w", F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("_n_lines"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("_w")).alias("_distinct"),
                       F.greatest(F.ceil(F.log2(F.size("_w") + F.lit(2))), F.lit(64 - hash_bits)).cast("int").alias("_bits"))
    # each 3-word window as one number: its hash above, its place in the low bits; sorted, equal hashes meet
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    packed = F.transform(F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>")),
                         lambda i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", window(i), F.col("_bits")), F.col("_bits")).bitwiseOR(i.cast("long")))
    rows = rows.select(*rows.columns, F.sort_array(packed).alias("_s"))
    high = lambda x: F.call_function("shiftrightunsigned", x, F.col("_bits"))
    again = F.filter("_s", lambda x, i: F.coalesce(high(x) == high(F.get("_s", i + 1)), F.lit(False)) | F.coalesce((i > 0) & (high(x) == high(F.get("_s", i - 1))), F.lit(False)))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)
    alike = lambda x, y: (F.get("_w", x) == F.get("_w", y)) & (F.get("_w", x + 1) == F.get("_w", y + 1)) & (F.get("_w", x + 2) == F.get("_w", y + 2))
    chance = F.exists(F.filter("_s", lambda x, i: F.coalesce((i > 0) & (high(x) == high(F.get("_s", i - 1))) & ~alike(place(x).cast("int"), place(F.get("_s", i - 1)).cast("int")), F.lit(False))), lambda x: F.lit(True))
    spelt = F.sort_array(F.transform("_s", lambda x: F.struct(*[F.get("_w", place(x).cast("int") + j).alias(f"w{j}") for j in range(3)], place(x).alias("at"))))
    rows = rows.select(*[c for c in rows.columns if c != "_w"], F.transform(again, place).alias("_again"), F.when(chance, spelt).alias("_spelt"))
    equal = lambda x, y: F.coalesce((x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"]), F.lit(False))
    exact = F.transform(F.filter("_spelt", lambda x, i: equal(x, F.get("_spelt", i + 1)) | ((i > 0) & equal(x, F.get("_spelt", i - 1)))), lambda x: x["at"])
    rows = rows.withColumn("_again", F.when(F.col("_spelt").isNotNull(), exact).otherwise(F.col("_again")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_again", lambda x: F.array(x, x + 1, x + 2)))))
    rows = rows.select(*[c for c in rows.columns if c not in ("_s", "_again", "_spelt")], covered.cast("long").alias("n_repeat_words"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.select(*["_row.*"] * bool(kept), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "_n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("_upper", "word_chars").alias("upper_rate"), rate("_marks", "word_chars").alias("mark_rate"), rate("_digits", "word_chars").alias("digit_rate"), rate("_distinct", "n_words").alias("distinct_rate"), rate("n_words", "_n_lines").alias("line_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above


def _covered(rows: list[tuple[dict, bool]], rule: list[Condition]) -> tuple[int, int]:
    hit = [bad for row, bad in rows if all(c.holds(row) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list[tuple[dict, bool]], cuts: dict[str, list[float]], longest: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < longest and any(bad for _, bad in rows) and not all(bad for _, bad in rows):
        p0 = sum(bad for _, bad in rows)
        info0, best = math.log2(p0 / len(rows)), (1e-9, None)
        for f, ts in cuts.items():
            column = sorted((row[f], bad) for row, bad in rows)
            i = p = 0
            for t in ts:
                while i < len(column) and column[i][0] <= t:
                    p += column[i][1]
                    i += 1
                for above, pos, n in ((False, p, i), (True, p0 - p, len(column) - i)):
                    if pos and (gain := pos * (math.log2(pos / n) - info0)) > best[0]:
                        best = gain, Condition(f, above, t)
        if best[1] is None:
            break
        f, t = best[1].feature, best[1].threshold
        # halfway to the next value seen: the same rows, with a margin on both sides
        above = min((row[f] for row, _ in rows if row[f] > t), default=t)
        best = best[0], Condition(f, best[1].above, (max((row[f] for row, _ in rows if row[f] <= t), default=t) + above) / 2)
        rule.append(best[1])
        rows = [x for x in rows if best[1].holds(x[0])]
    return rule


def learn(rows: list[tuple[dict, bool]], max_rules: int = 16, longest: int = 3, min_precision: float = 0.9, n_cuts: int = 48) -> list[list[Condition]]:
    """A decision list of rules for the rows marked True (bad), from their features; ``max_rules`` are tried."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[list[Condition]] = []
    for _ in range(max_rules):
        if not any(bad for _, bad in grow):
            break
        cuts = {}
        for f in FEATURES:  # thresholds at even ranks of the bad rows and of all rows
            values = sorted({row[f] for row, _ in grow})
            bad = sorted({row[f] for row, b in grow if b})
            cuts[f] = sorted({v[len(v) * j // n_cuts] for v in (values, bad) for j in range(n_cuts)})
        rule = _grow(grow, cuts, longest)
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_covered(prune, r))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = _covered(prune + grow, rule)
        q, m = _covered(prune, rule)
        if not rule:
            break
        good = p >= 3 and p >= min_precision * (p + n) and q >= min_precision * (q + m)
        if good:
            rules.append(rule)
        elif not any(bad and all(c.holds(row) for c in rule) for row, bad in grow):
            break  # nothing to set aside
        # a failed rule takes its bad rows along, a good one all that it covers
        grow = [x for x in grow if not ((good or x[1]) and all(c.holds(x[0]) for c in rule))]
        if good:
            prune = [x for x in prune if not all(c.holds(x[0]) for c in rule)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule of the list holds."""
    out = F
    for rule in rules:
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = out.when(every, False)
    return out.otherwise(True) if rules else F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, label_col: str = "quality") -> list[list[Condition]]:
    """Learns from at most ``max_rows`` labelled documents that pass the base rule, those with the smallest hashes of their ids."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min(label_col) == 0).alias("bad"))
    few = marks.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_rows)
    base = work_dir(docs.sparkSession)
    few = written(few, f"{base}/labels")
    # written first: a filter on the statistics would be pushed down and compute them again
    rows = written(statistics(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")), f"{base}/rows")
    rows = rows.where(~base_failed()).orderBy(F.xxhash64("doc_id"), "doc_id").select("bad", *FEATURES).limit(max_rows).collect()
    return learn([({f: float(r[f]) for f in FEATURES}, r["bad"]) for r in rows])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    # written: a filter on the result would be pushed into the statistics and compute them many times over
    rows = written(statistics(docs), f"{work_dir(spark)}/statistics").withColumn("base_failed", base_failed())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
