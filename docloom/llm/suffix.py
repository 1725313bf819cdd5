"""Repeated passages by sparse suffix arrays.

Of each text, the suffixes at content-selected positions are retained: a position whose ``k``-word
hash is the least of ``w`` consecutive ones (minimisers). Every passage of ``k + w - 1`` = ``min_words``
words that occurs twice holds the same minimiser at the same place in both. So a word lies in a repeated
passage if some ``min_words`` words around it, with a minimiser inside, stand in another document too.

1. Suffixes whose first ``k`` words occur in one document only are dropped. The others are sorted by
   what follows, and once more by what precedes (backwards), by range partitioning over the whole key,
   so that a passage which very many documents share is spread over many tasks. Suffixes of one document
   that agree in all words within reach are one row with several places.
2. In each order, a suffix is compared with the nearest suffixes of another document on both sides, and
   each match is extended left and right as far as passages with this minimiser can reach. Where both
   together have ``min_words`` words, they give a span. The nearest suffix to the right shares the most
   words to the right of all, that of the other order the most to the left: passages beyond these bounds
   can't repeat. Suffixes next to the border of two partitions are compared across it, border by border.
3. What lies within both bounds and in no span of the document (the longest match to the left and that
   to the right may be of different documents) is settled exactly: just these windows of ``min_words`` words
   around the minimiser are hashed, in every suffix that has it and the core of such a window (the words that
   it has in common with its neighbours), and those found in two documents give spans. A window is looked at
   under its least hash only, so once.

So no repeated passage of ``min_words`` words is missed, and every word of a span lies in one. Overlapping
and touching spans of a document are joined. Copies of a whole text are found first and stand aside: only
the one with the smallest id enters the suffix array, and all get their whole text as the span.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, compared by 32-bit hashes. Null, empty and short
texts have no spans and no row. Rows with a null id are ignored. Rows that repeat an id count as one
document, with the spans of all its texts; a passage that repeats in one document only is no repeat. Ties
don't matter: all that repeat get spans. Very long texts are taken whole, one at a time. An empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import by_bytes, finished, remove, table, work_dir, written
from docloom.llm.near_dup import BLOCK, _grams, cells, raw_text, word_hashes

#: So many suffixes on each side are compared before a window is left to the exact step.
FARTHER = 24
#: Up to so many anchors or ids (8 bytes each) are broadcast; beyond, they are shuffled.
BROADCAST_IDS = 300_000
#: Minimisers of long texts are looked for in stretches of so many windows.
STRETCH = 1 << 16
#: Contexts go out in rows of up to so many.
CONTEXT_ROWS = 20_000
#: So many windows, each beginning a word before the other, are told apart by their common core first.
CORE = 8


def _hashes(text) -> np.ndarray:
    return word_hashes(raw_text(text))


def minimisers(h: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-word hashes of the minimisers of a text's word hashes, from stretches of ``STRETCH`` windows."""
    places, found = [], []
    for start in range(0, len(h) - k - w + 2, STRETCH):
        grams = _grams(h[start:start + STRETCH + k + w - 2], k)
        least = grams  # of 1, 2, 4, ... positions, then of w
        size = 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[:len(grams) - w + 1], least[w - size:][:len(grams) - w + 1])
        if len(grams) < 4 * w:
            windows = np.lib.stride_tricks.sliding_window_view(grams, w)
            at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        else:
            at = np.flatnonzero(np.isin(grams, least))
        places.append(at + start)
        found.append(grams[at])
    if len(places) < 2:
        return (places[0], found[0]) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))
    places, first = np.unique(np.concatenate(places), return_index=True)  # stretches overlap by w - 1 grams
    return places, np.concatenate(found)[first]


def _anchors(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BLOCK):
                found = [minimisers(_hashes(t), k, w) for t in cells(part.column(1))]
                ids = np.repeat(np.asarray(part.column(0)), [len(p) for p, _ in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()),
                    pa.array(np.concatenate([p for p, _ in found])),
                    pa.array(np.concatenate([g for _, g in found]).view(np.int64))], names=["doc_id", "pos", "anchor"])

    return run


CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())


def _led(grams: np.ndarray, at: np.ndarray, reach: int) -> tuple[list[int], list[int]]:
    """Of the windows that hold the gram at a place, those in which it is the least begin ``low`` to ``high`` words before it."""
    steps = np.arange(1, reach + 1)
    high, low = np.full(len(at), reach), np.zeros(len(at), np.int64)
    for sign in (-1, 1):
        place = at[:, None] + sign * steps
        less = (place >= 0) & (place < len(grams))
        less &= grams[np.clip(place, 0, max(len(grams) - 1, 0))] < grams[at][:, None] if len(at) else False
        free = np.where(less.any(axis=1), less.argmax(axis=1), reach)
        if sign < 0:
            high = free
        else:
            low = reach - free
    return low.tolist(), high.tolist()


def _context_rows(rows: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, CONTEXT_TYPES)], names=["doc_id", "pos", "anchor", "left", "right", "places", "low", "high"])


def _contexts(k: int, before: int, after: int):
    """Suffixes with up to ``before`` words before them (backwards) and ``after`` from them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BLOCK, 128):
                rows: tuple[list, ...] = ([], [], [], [], [], [], [], [])
                for doc_id, text, found in zip(part.column(0).to_pylist(), cells(part.column(1)), part.column(2)):
                    h = _hashes(text)
                    raw = (h >> np.uint64(32)).astype(">u4")
                    back, fore, n = raw[::-1].tobytes(), raw.tobytes(), len(raw)
                    grams = _grams(h, k)
                    # of this text, not of another one with its id
                    pos, anchor = np.asarray(found.values.field("pos")), np.asarray(found.values.field("anchor")).view(np.uint64)
                    inside = pos < len(grams)
                    pos, anchor = pos[inside], anchor[inside]
                    pos = pos[grams[pos] == anchor]
                    same: dict[tuple, list[int]] = {}
                    for start in range(0, len(pos), CONTEXT_ROWS):
                        some = pos[start:start + CONTEXT_ROWS]
                        for p, low, high in zip(some.tolist(), *_led(grams, some, before)):
                            same.setdefault((int(grams[p].view(np.int64)), low, high, back[4 * (n - p):4 * (n - p + before)], fore[4 * p:4 * (p + after)]), []).append(p)
                    for (anchor, low, high, left, right), places in same.items():
                        for col, v in zip(rows, (doc_id, places[0], anchor, left, right, places, low, high)):
                            col.append(v)
                        if len(rows[0]) == CONTEXT_ROWS:
                            yield _context_rows(rows)
                            rows = ([], [], [], [], [], [], [], [])
                yield _context_rows(rows)

    return run


class _Words:
    """A binary column of 32-bit words as a matrix."""

    def __init__(self, column: pa.Array, width: int):
        self.lengths = np.asarray(pc.binary_length(column), dtype=np.int64) // 4
        self.there = np.arange(width) < self.lengths[:, None]
        self.words = np.zeros(self.there.shape, np.uint32)
        self.words[self.there] = np.frombuffer(b"".join(column.to_pylist()), np.uint32)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that rows i and j share from their start."""
        differ = (self.words[i] != self.words[j]) | ~self.there[i] | ~self.there[j]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers with bits low to high set; none where low > high."""
    one = np.uint64(1)
    ones = lambda n: (one << np.maximum(n, 0).astype(np.uint64)) - one
    return np.where(low <= high, ones(high + 1) & ~ones(low), np.uint64(0))


COMPARED = {"kind": pa.int32(), "doc_id": pa.int64(), "x": pa.int64(), "y": pa.int64(), "anchor": pa.int64(), "mask": pa.int64(), "places": pa.list_(pa.int64()),
            "border": pa.int32(), "left": pa.binary(), "right": pa.binary(), "low": pa.int64(), "high": pa.int64()}
COMPARED_SCHEMA = "kind int, doc_id long, x long, y long, anchor long, mask long, places array<long>, border int, left binary, right binary, low long, high long"


def _compare(by_right: bool, min_words: int, k: int, edges: bool = False):
    """Spans (kind 0: doc_id, x, y) and open windows (kind 1 or 2: doc_id, suffix x, anchor, mask, places) of sorted suffixes.

    Bit j of a mask stands for the window that begins j words before the suffix. The suffixes at a
    partition's start and end come out as kind 5 and 6, and, where ``edges`` are compared across the
    border to the next partition, the masks of those that lacked a neighbour once more as kind 3 or 4."""

    def runs_of(rows) -> tuple:
        anchor, doc = np.asarray(rows.column("anchor")), np.asarray(rows.column("doc_id"))
        starts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        number = np.searchsorted(starts, np.arange(len(doc)), "right") - 1
        return anchor, doc, starts, starts[number], np.append(starts[1:], len(doc))[number]

    def edge(rows, kind: int) -> pa.RecordBatch:
        """The rows of the first or last run and some beyond, of the same anchor."""
        from pyspark import TaskContext

        anchor, _, starts, _, behind = runs_of(rows)
        some = slice(0, int(behind[0]) + FARTHER) if kind == 5 else slice(max(int(starts[-1]) - FARTHER, 0), len(anchor))
        keep = np.arange(len(anchor))[some]
        rows = rows.take(pa.array(keep[anchor[keep] == anchor[0 if kind == 5 else -1]]))
        part = TaskContext.get().partitionId() - (kind == 5)  # the number of the border
        return shaped({c: rows.column(c) for c in ("doc_id", "anchor", "places", "left", "right", "low", "high")} | {"x": rows.column("pos"), "kind": np.full(rows.num_rows, kind, np.int32), "border": np.full(rows.num_rows, part, np.int32)}, rows.num_rows)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by border, then like the suffixes: compares those next to each border with both sides."""
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        rows = table.combine_chunks().to_batches()[0]
        border, kind = np.asarray(rows.column("border")), np.asarray(rows.column("side"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(border)) + 1, [len(border)]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            first = a + int((kind[a:z] == 6).sum())  # of the partition behind the border
            if a < first < z:
                some = rows.slice(a, z - a)
                anchor, doc, _, begin, behind = runs_of(some)
                near = np.flatnonzero((begin == begin[first - a]) | (begin == begin[first - a - 1]))
                near = near[(begin[near] > 0) & (behind[near] < z - a)]
                if len(near):
                    yield compared(some, near, anchor, doc, begin - 1, behind, np.zeros(z - a, bool), all_masks=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # carried on: the last document's suffixes of one anchor, and the row before them
        carry, context, earlier = None, False, None
        for batch in itertools.chain(batches, [None]):
            last_batch = batch is None
            if last_batch and carry is None:
                return
            if not last_batch and not batch.num_rows:
                continue
            rows = carry if last_batch else batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            n = rows.num_rows
            anchor, doc, starts, first, behind = runs_of(rows)
            unknown = np.zeros(n, bool)
            if not context:
                unknown |= first == 0
            if last_batch:
                unknown |= behind == n
                yield edge(rows if earlier is None else pa.Table.from_batches([earlier, rows.slice(1 if context else 0)]).combine_chunks().to_batches()[0], 6)
            here = np.arange(1 if context else 0, n if last_batch else starts[-1])
            unknown = np.zeros(n, bool)
            if not context:
                unknown |= first == 0
            if last_batch:
                unknown |= behind == n
            if not context and (len(starts) > 1 or last_batch):
                yield edge(rows, 5)
            if len(here):
                yield compared(rows, here, anchor, doc, first - 1, behind, unknown)
            if last_batch:
                return
            carry, context = rows.slice(max(starts[-1] - 1, 0)), bool(starts[-1] > 0)
            earlier = rows.slice(max(starts[-1] - FARTHER, 0), min(starts[-1], FARTHER)) if context else None

    def shaped(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if isinstance(columns.get(c), np.ndarray) else columns.get(c, pa.nulls(n, t)) for c, t in COMPARED.items()], names=list(COMPARED))

    def compared(rows, here, anchor, doc, before, behind, unknown, all_masks: bool = False) -> pa.RecordBatch:
        n = len(anchor)
        left, right = _Words(rows.column("left"), min_words - k), _Words(rows.column("right"), min_words)
        best_l, best_r = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)  # of any match
        span_l, span_r = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)  # of whole ones
        known, met = np.zeros(len(here), np.uint64), unknown[here]

        def meet(i: np.ndarray, other: np.ndarray) -> np.ndarray:
            """Compares suffixes ``here[i]`` with others; tells which of these are of the same anchor and another document."""
            there = (other >= 0) & (other < n)
            there[there] = (anchor[other[there]] == anchor[here[i[there]]]) & (doc[other[there]] != doc[here[i[there]]])
            i, other = i[there], other[there]
            l, r = left.shared(here[i], other), right.shared(here[i], other)  # noqa: E741
            best_l[i], best_r[i] = np.maximum(best_l[i], l), np.maximum(best_r[i], r)
            whole = l + r >= min_words
            i, l, r = i[whole], l[whole], r[whole]  # noqa: E741
            known[i] |= _bits(np.maximum(min_words - r, 0), l)
            span_l[i], span_r[i] = np.maximum(span_l[i], l), np.maximum(span_r[i], r)
            return there

        every = np.arange(len(here))
        for other in (before, behind):
            met = met | meet(every, other[here])
        if by_right:
            bound = np.where(unknown[here], right.lengths[here], best_r)
            possible = _bits(np.maximum(min_words - bound, 0), left.lengths[here])
        else:
            bound = np.where(unknown[here], left.lengths[here], best_l)
            possible = _bits(np.maximum(min_words - right.lengths[here], 0), bound)
        possible &= np.where(met, _bits(np.asarray(rows.column("low"))[here], np.asarray(rows.column("high"))[here]), np.uint64(0))
        # farther ones give no new bound, but may hold windows that the nearest lack: in a family with scattered edits most do
        for step in range(1, FARTHER):
            still = np.flatnonzero(possible & ~known)
            if not len(still):
                break
            meet(still, before[here[still]] - step)
            meet(still, behind[here[still]] + step)
        mask = (possible & ~known).view(np.int64)
        # all matches hold the suffix's place, so they join to one span
        some = np.flatnonzero(span_r)
        places = rows.column("places").take(pa.array(here[some]))
        times = np.asarray(pc.list_value_length(places), dtype=np.int64)
        at, some = np.asarray(places.flatten(), dtype=np.int64), np.repeat(some, times)
        l, r = span_l, span_r  # noqa: E741
        spans = shaped({"kind": np.zeros(len(some), np.int32), "doc_id": doc[here[some]], "x": at - l[some], "y": at + r[some]}, len(some))
        i = every if all_masks else np.flatnonzero(mask)
        kind = (1 if by_right else 2) + (2 if all_masks else 0)
        opens = shaped({"kind": np.full(len(i), kind, np.int32), "doc_id": doc[here[i]], "x": np.asarray(rows.column("pos"))[here[i]], "anchor": anchor[here[i]], "mask": mask[i], "places": rows.column("places").take(pa.array(here[i]))}, len(i))
        return pa.Table.from_batches([spans, opens]).combine_chunks().to_batches(max_chunksize=None)[0] if len(some) + len(i) else spans

    return across if edges else run


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_spans, repeat_words, spans, n_copies)`` of each document with a repeated passage;
    spans are 0-based word ranges [start, end); n_copies counts documents with the same whole text."""
    spark, base = docs.sparkSession, work_dir(docs.sparkSession)
    w = min_words - k + 1
    if not 1 <= w <= 63:
        raise ValueError("k must be at most min_words and at least min_words - 62")
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = written(docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("copy"), "text", F.length("text")).alias("h2")).distinct(), f"{base}/keys")
    same = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")).where("n_copies > 1")
    copies = written(keys.join(same, ["h1", "h2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n_copies").alias("n_copies")), f"{base}/copies")
    aside = copies.where("doc_id <> rep").select("doc_id")

    suffixes = docs.mapInArrow(_anchors(k, w), "doc_id long, pos long, anchor long").join(aside, "doc_id", "left_anti")
    suffixes = written(suffixes, f"{base}/suffixes")
    often = suffixes.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("anchor")
    # as a table of its own it is broadcast while small; beyond, both sides are plain shuffles, of which AQE splits a hot anchor
    often = written(often, f"{base}/often")
    wanted = suffixes.join(F.broadcast(often) if often.count() <= BROADCAST_IDS else often, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "anchor")).alias("found"))
    wanted = written(wanted, f"{base}/wanted")
    ids = wanted.select("doc_id")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    near = texts.join(wanted, "doc_id").select("doc_id", "text", "found").mapInArrow(_contexts(k, min_words - k, min_words), "doc_id long, pos long, anchor long, left binary, right binary, places array<long>, low long, high long")
    near = written(near.withColumn("pos", F.xxhash64("doc_id", "anchor", "left", "right")), f"{base}/contexts")
    for name in ("suffixes", "wanted"):
        remove(spark, f"{base}/{name}")
    compared = None
    for order in (["anchor", "right", "left"], ["anchor", "left", "right"]):
        by_right = order[1] == "right"
        rows = written(near.orderBy(*order, "doc_id", "pos").mapInArrow(_compare(by_right, min_words, k), COMPARED_SCHEMA), f"{base}/{order[1]}")
        # some rows of each partition, dealt by border
        edges = rows.where("kind > 4").select("border", F.col("kind").alias("side"), "doc_id", F.col("x").alias("pos"), "anchor", "places", "left", "right", "low", "high")
        edges = edges.repartition("border").sortWithinPartitions("border", F.desc("side"), *order, "doc_id", "pos").mapInArrow(_compare(by_right, min_words, k, edges=True), COMPARED_SCHEMA)
        rows = rows.where("kind < 5").unionByName(edges)
        compared = rows if compared is None else compared.unionByName(rows)
    joined = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "end"))), F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda s, x: F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1)["end"] >= x["start"]),
                            F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.get(s, F.size(s) - 1)["start"].alias("start"), F.greatest(F.get(s, F.size(s) - 1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(s, F.array(x))))
    spans = compared.where("kind = 0").select("doc_id", F.col("x").alias("start"), F.col("y").alias("end"))
    spans = written(spans.groupBy("doc_id").agg(joined.alias("spans")), f"{base}/spans")

    # windows that a document's spans hold already need no answer
    one = lambda kind: F.bit_or(F.when(F.col("kind") == kind, F.col("mask")))
    both = one(1).bitwiseAND(one(2)).bitwiseAND(F.coalesce(one(3), F.lit(-1).cast("long"))).bitwiseAND(F.coalesce(one(4), F.lit(-1).cast("long")))
    opened = compared.where("kind between 1 and 4").groupBy("doc_id", "x", "anchor").agg(both.alias("mask"), F.first("places").alias("places")).where("mask <> 0").join(spans, "doc_id", "left")
    begins = F.filter(F.sequence(F.lit(0), F.lit(w - 1)), lambda j: (F.getbit("mask", j) == 1) & F.exists("places", lambda p: ~F.coalesce(F.exists("spans", lambda s: (s["start"] <= p - j) & (p - j + min_words <= s["end"])), F.lit(False))))
    asked = F.aggregate(begins, F.lit(0).cast("long"), lambda m, j: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
    opened = written(opened.select(F.col("x").alias("pos"), "anchor", asked.alias("own")).where("own <> 0"), f"{base}/opened")
    wide = written(opened.groupBy("anchor").agg(F.bit_or("own").alias("wide")), f"{base}/wide")
    for name in ("right", "left"):
        remove(spark, f"{base}/{name}")
    small = lambda d: F.broadcast(d) if d.count() <= BROADCAST_IDS else d
    held = near.join(small(wide), "anchor").join(small(opened.select("pos", "own")), "pos", "left")
    held = held.withColumn("js", F.expr(f"filter(sequence(0, {w - 1}), j -> getbit(wide, j) = 1 and j between low and high and octet_length(left) >= 4 * j and octet_length(right) >= 4 * ({min_words} - j))"))
    # windows that begin close together have most of their words, the core, in common: one is looked at only where an open one has its core
    held = held.withColumn("parts", F.expr(f"array_distinct(transform(js, j -> j div {CORE}))")).select("*", F.explode("parts").alias("b"))
    core = [F.expr(f"substring(left, 1, 4 * b * {CORE})"), F.expr(f"substring(right, 1, 4 * ({min_words} - least(b * {CORE} + {CORE - 1}, {w - 1})))")]

    def window(j):
        parts = [F.substring("left", F.lit(1), 4 * j), F.substring("right", F.lit(1), 4 * (min_words - j))]
        return F.struct(j.alias("j"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("window"), *parts).alias("h2"))

    inside = F.filter("js", lambda j: F.floor(j / CORE) == F.col("b"))
    held = written(held.select("anchor", "b", F.xxhash64(*core).alias("core"), F.exists(inside, lambda j: F.getbit(F.coalesce("own", F.lit(0).cast("long")), j) == 1).alias("open"), "doc_id", "places", F.transform(inside, window).alias("windows")), f"{base}/held")
    cores = written(held.where("open").select("anchor", "b", "core").distinct(), f"{base}/cores")
    held = held.join(small(cores), ["anchor", "b", "core"], "left_semi").select("anchor", "doc_id", "places", F.inline("windows"))
    shared = held.groupBy("anchor", "j", "h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").drop("lo", "hi")
    settled = held.join(shared, ["anchor", "j", "h1", "h2"], "left_semi").select("doc_id", F.explode("places").alias("p"), "j")
    settled = settled.select("doc_id", (F.col("p") - F.col("j")).alias("start"), (F.col("p") - F.col("j") + min_words).alias("end"))
    found = spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end").unionByName(settled).groupBy("doc_id").agg(joined.alias("spans"))
    whole = docs.join(copies.select("doc_id", "n_copies"), "doc_id").select("doc_id", "n_copies", F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")).cast("long").alias("n"))
    whole = whole.where(F.col("n") >= min_words).groupBy("doc_id").agg(F.max("n_copies").alias("n_copies"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.max("n").alias("end"))).alias("whole"))
    out = found.join(whole, "doc_id", "full_outer").select("doc_id", F.coalesce("whole", "spans").alias("spans"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    out = out.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("repeat_words"), "spans", "n_copies")
    return finished(out, base)


def op6_sparse_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
