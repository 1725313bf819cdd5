"""The choice of each page's text between its text layer and the results of OCR engines."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.functions.quality import needs_ocr, ocr_language, script_ratios, text_quality


#: From this length on ``difflib`` has popular characters, which begin no block.
POPULAR = 200
#: Below this length ``difflib`` itself is the quicker one.
LONG = 800


def similar(a: str, b: str, least: float) -> bool:
    """Whether ``difflib.SequenceMatcher(None, a, b).ratio()`` is at least ``least``.

    The same blocks, but those of one length at once: of the pairs of equal runs of the longest length that still meets in a
    gap between the blocks, the first in ``a``, then the first in ``b``, is taken, and the next behind it. A length is a few sorts of
    the gaps' unpopular characters, so that a text costs in proportion to its length, but for the logarithm and the number of lengths. It ends as soon as the matched characters, or those that can't match, decide."""
    if a == b:
        return least <= 1
    total = len(a) + len(b)
    enough = lambda n: 2.0 * n / total >= least
    if not enough(min(len(a), len(b))) or not enough(sum((Counter(a) & Counter(b)).values())):
        return False
    if len(b) < POPULAR:
        return SequenceMatcher(None, a, b).ratio() >= least
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (a, b))
    signs, counts = np.unique(y, return_counts=True)
    rare = signs[counts <= len(b) // 100 + 1]
    unpopular = [np.isin(z, rare) for z in (x, y)]
    if not enough(min(_reached(np.isin(x, signs), unpopular[0]), _reached(np.isin(y, np.unique(x)), unpopular[1]))):
        return False
    if len(b) < LONG:
        return SequenceMatcher(None, a, b).ratio() >= least
    runs = [_runs(z) for z in unpopular]  # unpopular characters in a row from each place
    names = [np.unique(np.concatenate([x, y]), return_inverse=True)[1]]  # of the runs of 1, 2, 4, ... characters, equal for equal ones

    def named(k: int) -> tuple[np.ndarray, np.ndarray]:
        p = k.bit_length() - 1
        while len(names) <= p:
            names.append(_pairs(names[-1], np.append(names[-1][1 << len(names) - 1:], np.zeros(1 << len(names) - 1, np.int64))))
        one = names[p]
        if k > 1 << p:
            one = _pairs(one, np.append(one[k - (1 << p):], np.zeros(k - (1 << p), np.int64)))
        return one[:len(a)], one[len(a):]

    def meetings(k: int) -> tuple[np.ndarray, ...]:
        """Of ``k`` characters: the places in ``a`` that meet one in ``b``, their gaps and keys; the keys and places in ``b``, sorted."""
        found = []
        for side, (name, run) in enumerate(zip(named(k), runs)):
            at = np.flatnonzero(run >= k)
            gap = np.searchsorted(gaps[:, 2 * side], at, "right") - 1
            inside = (gap >= 0) & (at + k <= gaps[gap, 2 * side + 1])
            at, gap = at[inside], gap[inside]
            found.append((at, gap, gap * np.int64(total) + name[at]))
        (i, gap, key), (j, _, other) = found
        met = np.isin(key, other)
        order = np.argsort(other, kind="stable")
        return i[met], gap[met], key[met], other[order], j[order]

    gaps = np.asarray([[0, len(a), 0, len(b)]], np.int64)
    matched, most = 0, int(min(r.max() for r in runs))
    while most and len(gaps):
        if enough(matched) or not enough(matched + int(np.minimum(gaps[:, 1] - gaps[:, 0], gaps[:, 3] - gaps[:, 2]).sum())):
            return enough(matched)
        least_k, step = most + 1, 1  # the longest length that still meets: downwards in growing steps, then between the bounds
        while least_k > 1:
            k = max(1, least_k - step)
            if len(meetings(k)[0]):
                break
            least_k, step = k, 2 * step
        else:
            break
        while least_k - k > 1:
            mid = (k + least_k) // 2
            k, least_k = (mid, least_k) if len(meetings(mid)[0]) else (k, mid)
        starts, where, keys, others, places = meetings(k)
        left, ends, now = [], gaps.tolist(), -1
        first, last = np.searchsorted(others, keys, "left").tolist(), np.searchsorted(others, keys, "right").tolist()
        touched = set()
        for i, g, lo, hi in zip(starts.tolist(), where.tolist(), first, last):
            if g != now:
                now = g
                touched.add(g)
                alo, ahi, blo, bhi = ends[g]
            if i < alo or i + k > ahi:
                continue
            nth = lo + int(np.searchsorted(places[lo:hi], blo))
            if nth == hi:
                continue
            j, size = int(places[nth]), k
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
            matched += size
            left.append([alo, i, blo, j])
            alo, blo = i + size, j + size
            ends[g] = [alo, ahi, blo, bhi]
        gaps = np.asarray(sorted(x for x in left + ends if x[0] < x[1] and x[2] < x[3]), np.int64).reshape(-1, 4)
        most = k
    for alo, ahi, blo, bhi in gaps.tolist():  # without a block, what both begin with
        n = 0
        while alo + n < ahi and blo + n < bhi and a[alo + n] == b[blo + n]:
            n += 1
        matched += n
    return enough(matched)


def _reached(known: np.ndarray, unpopular: np.ndarray) -> int:
    """The most characters of a text that blocks can hold: a block lies in a stretch of characters that the other text has, too,
    and that stretch has an unpopular one or is the text's beginning (all other gaps begin where two texts differ)."""
    stretch = np.cumsum(~known)
    sizes = np.bincount(stretch[known], minlength=1)
    some = np.bincount(stretch[known & unpopular], minlength=len(sizes)) > 0
    some[0] = True
    return int(sizes[some].sum())


def _runs(marked: np.ndarray) -> np.ndarray:
    """For each place, how many from it on are marked in a row."""
    ends = np.append(np.flatnonzero(~marked), len(marked))
    at = np.arange(len(marked))
    return ends[np.searchsorted(ends, at)] - at


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.unique(x * np.int64(len(x) + 1) + y, return_inverse=True)[1]


def alike(a: Column, b: Column, least: float) -> Column:
    """Whether two texts have a Ratcliff-Obershelp similarity of ``least``; Spark has none, so an Arrow UDF, for pairs of
    page texts only. Its cheap upper bounds come first: most unlike pairs never get to the matching of blocks."""
    @F.pandas_udf("boolean")
    def judged(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(p or "", q or "", least) for p, q in zip(x, y)], dtype="bool")

    return judged(a, b)


def filled(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s", "")) > 0


def choose_ocr(pages: DataFrame, first: str, second: str, least: float = 0.6, out: str = "text") -> DataFrame:
    """Of two OCR texts the first, if they are alike or it scores no less; if one is blank, the other.

    Scores decide before the similarity, which is only computed where the second text scores more."""
    a, b = F.coalesce(F.col(first), F.lit("")), F.coalesce(F.col(second), F.lit(""))
    rows = pages.withColumn("_second", filled(b) & (~filled(a) | (text_quality(a) < text_quality(b))))
    doubt = F.col("_second") & filled(a)
    rows = rows.withColumn("_alike", doubt & alike(F.when(doubt, a), F.when(doubt, b), least))
    return rows.withColumn(out, F.when(F.col("_second") & ~F.col("_alike"), b).otherwise(F.when(filled(a), a).otherwise(b))).drop("_second", "_alike")


def with_fallback(pages: DataFrame, ocr: DataFrame, keys: list[str], min_length: int = 50, min_score: float = 0.2) -> DataFrame:
    """``pages`` (text, method) with ``ocr`` (first, second) in place of texts that are blank, short or poor.

    A page without any OCR text keeps its own; ``method`` tells which was taken."""
    needed = needs_ocr(F.coalesce("text", F.lit("")), min_length, min_score)
    asked = ocr.join(pages.where(needed).select(*keys).distinct(), keys, "left_semi")  # the choice is only made for these
    best = choose_ocr(asked, "first", "second", out="ocr_text").select(*keys, "ocr_text")
    rows = pages.join(best, keys, "left")
    swap = needed & filled(F.col("ocr_text"))
    return rows.withColumn("method", F.when(swap, "ocr").otherwise(F.col("method"))).withColumn("text", F.when(swap, F.col("ocr_text")).otherwise(F.coalesce("text", F.lit("")))).drop("ocr_text")


def page_languages(pages: DataFrame, first: int = 3, threshold: float = 0.15) -> DataFrame:
    """``pages(source, page_no, text)`` with ``ocr_lang``: what the page's own letters tell, else what those of the
    document's first pages do.

    The first pages of a document come from an aggregate that keeps no more of them, whatever the document's size."""
    lead = pages.select("source", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(W.partitionBy("source").orderBy("page_no", "text"))  # cut to the first on the map side
    lead = lead.withColumn("nth", nth).where(F.col("nth") <= first)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n")
    lang = lead.groupBy("source").agg(joined.alias("text")).select(F.col("source").alias("_source"), ocr_language(F.col("text"), threshold=threshold).alias("_lang"))
    rows = pages.join(lang, F.col("source").eqNullSafe(F.col("_source")), "left")
    own = script_ratios(F.coalesce("text", F.lit("")))[1] >= threshold
    return rows.withColumn("ocr_lang", F.when(own, "tha+eng").otherwise(F.col("_lang"))).drop("_source", "_lang")
