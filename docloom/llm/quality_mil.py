"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded: counts of byte classes and of
kinds of words become rates, which a learned layer turns into a hidden vector. Gated attention, a tanh gate times
a sigmoid gate, weighs the passages of a document against each other; a logistic layer scores the weighted sum of
their hidden vectors. All weights are learned together from the documents' labels alone, so the attention
learns which passages decide.

The model is fitted on at most ``max_docs`` labelled documents, those with the smallest hashes of their ids, with
at most ``max_passages`` evenly spaced passages of each; scoring reads every passage of every document. Documents
are scored where they lie, without a shuffle. Long texts are encoded in stretches of ``STRETCH`` bytes, and the
attention's sums are carried from one to the next, so memory stays bounded whatever a text's length.

Null and blank texts are one passage without words and are scored like others. Rows are neither dropped nor
merged, repeated rows are scored alike; a null id counts as the empty text in the hold-out. Ties don't occur. Without
labels of both kinds all score the share of good ones, or 1 where there are no labels. An empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import crc_mod, table, work_dir, written

#: Words of a passage.
PASSAGE = 48
#: Bytes of text that are encoded at once.
STRETCH = 2_000_000
#: Classes of bytes: white space is 0, what no other class holds is the last.
CLASSES = [" \t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", "!?", ",;:", "#$%&*", "|<>", "@=^~_+\\/", "'\"()[]{}-"]
_CLASS = np.full(256, len(CLASSES) + 1, dtype=np.uint8)
_CLASS[128:] = len(CLASSES)
for _i, _chars in enumerate(CLASSES):
    _CLASS[list(_chars.encode())] = _i
N_CLASSES = len(CLASSES) + 2
_MARK = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)
WORD_KINDS = ["again", "fresh", "capital", "shouted", "long", "tiny", "ends_odd", "no_letter"]
N_FEATURES = N_CLASSES - 1 + len(WORD_KINDS) + 2


def count_passages(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each passage, and its features; ``bounds`` are the starts of the texts in ``raw``, which white
    space separates. Texts without words have no passage here."""
    b = np.frombuffer(raw, dtype=np.uint8)
    code = _CLASS[b]
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = code != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, N_FEATURES))
    text = np.searchsorted(bounds, starts, "right") - 1
    first = np.searchsorted(starts, bounds)
    nth = np.arange(len(starts)) - first[text]
    opens = np.flatnonzero(nth % PASSAGE == 0)  # the first word of each passage
    of_word = np.cumsum(nth % PASSAGE == 0) - 1
    n = len(opens)
    # bytes by passage and class; white space doesn't count
    spans = np.diff(np.append(starts[opens], len(b)))
    of_byte = np.repeat(np.arange(n), spans)
    chars = np.bincount(of_byte * N_CLASSES + code[starts[opens[0]]:], minlength=n * N_CLASSES).reshape(n, N_CLASSES)[:, 1:].astype(np.float64)
    size = ends - starts
    total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  # over the word and the white space behind it, which counts nothing
    name = total(np.where(code == 0, np.uint64(0), _MARK[b])) * np.uint64(2) + size.astype(np.uint64)
    upper, lower = total((code == 2).astype(np.int64)), total((code == 1).astype(np.int64))
    letters = upper + lower + total((code == len(CLASSES)).astype(np.int64))
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = name[1:] == name[:-1]
    again[opens] = False
    order = np.lexsort((name, of_word))
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    last = code[ends - 1]
    kinds = [again, fresh, code[starts] == 2, (upper >= 2) & (lower == 0), size > 12, size <= 2, (last >= 7) & (last <= 9), letters == 0]
    words = np.bincount(of_word, minlength=n).astype(np.float64)
    by_kind = [np.bincount(of_word[order] if i == 1 else of_word, weights=k, minlength=n) / words for i, k in enumerate(kinds)]
    solid = np.maximum(chars.sum(axis=1), 1)
    return text[opens], np.column_stack([chars / solid[:, None], *by_kind, np.log1p(words), np.log1p(solid / words)])


NO_WORDS = np.zeros((1, N_FEATURES))


def text_passages(text: str | None) -> Iterator[np.ndarray]:
    """The features of a long text's passages, a stretch at a time."""
    raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
    any_ = False
    while at < len(raw):
        size = STRETCH
        while True:
            part = raw[at:at + size]
            if at + size >= len(raw):
                end = len(part)
                break
            # up to the first word of the last passage, which may go on behind the stretch
            starts = np.flatnonzero(np.diff(np.concatenate([[False], _CLASS[np.frombuffer(part, dtype=np.uint8)] != 0]).astype(np.int8)) == 1)
            if len(starts) > PASSAGE:
                end = int(starts[(len(starts) - 1) // PASSAGE * PASSAGE])
                break
            size *= 2
        _, x = count_passages(part[:end], np.zeros(1, np.int64))
        if len(x):
            any_ = True
            yield x
        at += end
    if not any_:
        yield NO_WORDS


def bags(texts: list[str | None]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(place in ``texts``, features of its passages in stretches); short texts are encoded together."""

    def together(group: list[int]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        raws = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in group]
        bounds = np.cumsum([0] + [len(r) + 1 for r in raws[:-1]])
        own, x = count_passages(b"\n".join(raws), bounds)
        cuts = np.searchsorted(own, np.arange(len(group) + 1))
        for i, a, z in zip(group, cuts, cuts[1:]):
            yield i, iter([x[a:z] if z > a else NO_WORDS])

    group, held = [], 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if 4 * n > STRETCH:
            yield i, text_passages(text)
            continue
        if held + n > STRETCH // 2:
            yield from together(group)
            group, held = [], 0
        group.append(i)
        held += n
    if group:
        yield from together(group)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Gated attention over encoded passages. ``weights`` is None where there was nothing to learn from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    share: float = 1.0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden vectors of passages, and their attention before it is normed."""
        p = self.weights
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ p["w"] + p["b"])
        return h, (np.tanh(h @ p["v"]) * _sigmoid(h @ p["u"])) @ p["a"]

    def score_bag(self, stretches: Iterator[np.ndarray]) -> float:
        top, weight, total = -np.inf, 0.0, 0.0
        for x in stretches:
            h, s = self.encode(x)
            new = max(top, float(s.max()))
            e, old = np.exp(s - new), np.exp(top - new)
            weight, total, top = weight * old + e.sum(), total * old + e @ h, new
        return float(_sigmoid(total / weight @ self.weights["c"] + self.weights["d"])[0])

    def score(self, docs: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
        """The carried columns and ``score``, one row for each row of ``docs``."""
        if self.weights is None:
            return docs.select(*carried, F.lit(self.share).alias("score"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    found = np.zeros(part.num_rows)
                    for i, stretches in bags(part.column(part.num_columns - 1).to_pylist()):
                        found[i] = self.score_bag(stretches)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], names=[*carried, "score"])

        return docs.select(*carried, F.col(text_col).alias("__text")).mapInArrow(run, docs.select(*carried).schema.add("score", "double"))


def learn(found: list[tuple[np.ndarray, float]], hidden: int = 16, gates: int = 8, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 13) -> AttentionModel:
    """Fits the model to bags (features of the passages, label) by Adam over the documents' log loss."""
    labels = np.array([y for _, y in found])
    if not len(found) or labels.min() == labels.max():
        return AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, float(labels.mean()) if len(found) else 1.0)
    whole = np.concatenate([x for x, _ in found])
    model = AttentionModel(whole.mean(axis=0), np.maximum(whole.std(axis=0), 1e-3), None, float(labels.mean()))
    rng = np.random.default_rng(seed)
    drawn = lambda n, m: rng.normal(0, 1 / np.sqrt(n), (n, m))
    p = {"w": drawn(N_FEATURES, hidden), "b": np.zeros(hidden), "v": drawn(hidden, gates), "u": drawn(hidden, gates), "a": drawn(gates, 1)[:, 0], "c": drawn(hidden, 1)[:, 0], "d": np.zeros(1)}
    first, second, steps = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    normed = [np.clip((x - model.mean) / model.scale, -6, 6) for x, _ in found]
    for epoch in range(epochs):
        places = rng.permutation(len(found))
        for at in range(0, len(found), batch):
            own = places[at:at + batch]
            x, y = np.concatenate([normed[i] for i in own]), labels[own]
            sizes = np.array([len(normed[i]) for i in own])
            cuts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(own)), sizes)
            # forwards
            h = np.tanh(x @ p["w"] + p["b"])
            t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
            s = (t * g) @ p["a"]
            e = np.exp(s - np.maximum.reduceat(s, cuts)[bag])
            share = e / np.add.reduceat(e, cuts)[bag]
            z = np.add.reduceat(share[:, None] * h, cuts)
            # backwards
            dl = (_sigmoid(z @ p["c"] + p["d"]) - y) / len(own)
            dz = dl[:, None] * p["c"]
            dshare = (dz[bag] * h).sum(axis=1)
            ds = share * (dshare - np.add.reduceat(share * dshare, cuts)[bag])
            dtg = ds[:, None] * p["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (share[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            slopes = {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ dl, "d": np.array([dl.sum()])}
            steps += 1
            for k, slope in slopes.items():
                slope = slope + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                p[k] -= rate / (1 + epoch / 10) * (first[k] / (1 - 0.9 ** steps)) / (np.sqrt(second[k] / (1 - 0.999 ** steps)) + 1e-8)
    model.weights = p
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_docs: int = 6_000, max_passages: int = 64) -> AttentionModel:
    """Fits a model on documents joined with ``labels(doc_id, quality)``, which hold training rows only."""
    base = work_dir(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("label"))
    few = written(marks.orderBy(F.xxhash64("doc_id", F.lit("mil")), "doc_id").limit(max_docs), f"{base}/labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes] = [b""] * batch.num_rows
            for i, stretches in bags(batch.column(2).to_pylist()):
                x = np.concatenate(list(stretches))
                if len(x) > max_passages:
                    x = x[np.arange(max_passages) * len(x) // max_passages]
                raw[i] = x.astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["doc_id", "label", "passages"])

    rows = docs.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label double, passages binary")
    found = written(rows, f"{base}/passages").orderBy(F.xxhash64("doc_id"), "doc_id", "passages").limit(max_docs).collect()
    return learn([(np.frombuffer(r["passages"], "<f4").reshape(-1, N_FEATURES).astype(np.float64), r["label"]) for r in found])


def op13_quality_attention(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2).select("doc_id", "quality")
    rows = train(docs, labels).score(docs, ["doc_id"])
    return rows.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
