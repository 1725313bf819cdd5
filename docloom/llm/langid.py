"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word (a run of
letters, lower-cased, with the vocabulary's word mark before it) has as its probability the sum over
all its segmentations into pieces, which a forward pass gives; a text's is the product over its
words. Piece probabilities are fitted by expectation maximisation over the same lattices, on a
bounded sample of labelled documents (``docs_per_language``). Scoring reads every text whole and
shuffles nothing; each distinct word is scored once in a worker.

A prediction also says whether the text is ``typical`` of its language: whether its probability is no
farther below what the training words lead to expect of so many words and letters than ``SPREADS``
standard deviations and a drift of ``DRIFT`` of the mean letter's log probability. Random letters and
languages of another build than the learned ones are not; a few words always are.

Null texts and texts without a letter (``\\p{L}``) get ``und`` and score 0 and are not typical; ties go to
the first language in alphabetical order. Words and texts of any length are scored whole, words of more
than 28 letters by a slower pass that rescales, one after another; they don't count in training. A letter
that the vocabulary lacks has the same small probability in each language. Without any labelled document
every text is ``und``. Repeated rows are scored alike, an empty table gives an empty result, and columns
named like the results give way to them. Training collects at most ``words_per_language`` distinct words a
language; the model is sent to the tasks with the function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from docloom.llm.common import by_bytes, crc_mod

MARK = "▁"
#: Up to so many letters the product of probabilities stays within a double's range.
LONGEST = 28
SPREADS, DRIFT = 8.0, 0.5
UNKNOWN = 1e-7
FACTOR = np.uint64(1099511628211)
#: Words beyond which a worker's scores start anew, words that one forward pass takes at once, and bytes of text that a worker splits at once.
WORD_CACHE, AT_ONCE, STRETCH = 100_000, 4_000, 1_000_000
_letters = re.compile(r"[^\W\d_]+").findall
_only_letters = regex.compile(r"\p{L}+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters; the quicker pattern also takes some numerals, which the check finds."""
    text = text.lower()
    found = _letters(text)
    return found if text.isascii() or "".join(found).isalpha() else _only_letters(text)


@dataclass
class PieceModel:
    """Piece probabilities by language. Piece ids are places in ``keys``' order, then a piece that
    never occurs, then the unknown letter."""

    languages: list[str]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # sorted hashes and the pieces' ids
    probs: np.ndarray  # (pieces + 2) x languages
    mean: np.ndarray  # log probability a letter, by language
    variance: np.ndarray  # of a word's log probability about what its letters lead to expect
    index: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"index": {}, "scores": None}

    def lattice(self, words: list[str], at_once: int = 20_000) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
        """For the words of each length, ``at_once`` at a time: their places, and by piece length the piece starting at each position."""
        none, unknown = len(self.probs) - 2, len(self.probs) - 1
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(lengths):
            for at in np.array_split(places := np.flatnonzero(lengths == n), len(places) // at_once + 1):
                text = "".join([MARK + words[i] for i in at])
                codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(len(at), n + 1).astype(np.uint64)
                h, found = np.zeros_like(codes), []
                for k in range(1, int(n) + 2):
                    h = h[:, :codes.shape[1] - k + 1] * FACTOR + codes[:, k - 1:]
                    if k not in self.by_length:
                        continue
                    keys, ids = self.by_length[k]
                    j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = keys[j] == h
                    if k == 1 or hit.any():
                        found.append((k, np.where(hit, ids[j], unknown if k == 1 else none)))
                yield at, found

    def forward(self, n: int, found: list, rows: int) -> np.ndarray:
        a = np.zeros((n + 1, rows, self.probs.shape[1]))
        a[0] = 1
        for end in range(1, n + 1):
            for k, ids in found:
                if k <= end:
                    a[end] += a[end - k] * self.probs[ids[:, end - k]]
        return a

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), self.probs.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONGEST]
        some = [words[i] for i in short]
        for at, found in self.lattice(some, AT_ONCE):
            out[np.asarray(short)[at]] = np.log(np.maximum(self.forward(found[0][1].shape[1], found, len(at))[-1], 1e-300))
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = self.long_word(w)
        return out

    def long_word(self, word: str) -> np.ndarray:
        """The forward pass over one word of any length, in blocks, rescaled every few letters."""
        none, unknown, far = len(self.probs) - 2, len(self.probs) - 1, max(self.by_length)
        codes = np.frombuffer((MARK + word).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        back, scale = np.zeros((far, self.probs.shape[1])), np.zeros(self.probs.shape[1])  # back[k - 1]: k letters ago
        back[0] = 1
        for start in range(0, len(codes), 4096):
            some = codes[max(0, start - far + 1):start + 4096]
            n = min(4096, len(codes) - start)
            ids, h = np.full((n, far), none), np.zeros_like(some)  # by end and length
            for k in range(1, min(far, len(some)) + 1):
                h = h[:len(some) - k + 1] * FACTOR + some[k - 1:]
                if k in self.by_length:
                    keys, pieces = self.by_length[k]
                    j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = np.where(keys[j] == h, pieces[j], unknown if k == 1 else none)[-n:]
                    ids[n - len(hit):, k - 1] = hit
                elif k == 1:
                    ids[:, 0] = unknown
            for i in range(n):
                now = np.einsum("kl,kl->l", back, self.probs[ids[i]])
                back[1:] = back[:-1]
                back[0] = now
                if i % 8 == 7:
                    back /= now
                    scale += np.log(now)
        return np.log(back[0]) + scale

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts: words (of ``LONGEST`` letters at most) x languages."""
        total = np.zeros_like(self.probs)
        for at, found in self.lattice(words):
            n = found[0][1].shape[1]
            a, b = self.forward(n, found, len(at)), np.zeros((n + 1, len(at), self.probs.shape[1]))
            b[n] = counts[at] / np.maximum(a[n], 1e-300)
            for start in range(n - 1, -1, -1):
                for k, ids in found:
                    if start + k <= n:
                        way = self.probs[ids[:, start]] * b[start + k]
                        b[start] += way
                        for lang in range(total.shape[1]):
                            total[:, lang] += np.bincount(ids[:, start], way[:, lang] * a[start][:, lang], len(total))
        return total

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior, and whether it is typical, of each text."""
        if len(self.index) > WORD_CACHE or self.scores is None:
            self.index, self.scores = {}, np.empty((0, len(self.languages)))
        split = [words_of(t) if t else [] for t in texts]
        new = list(set().union(*split) - self.index.keys())
        if new:
            self.index.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            self.scores = np.concatenate([self.scores, self.word_scores(new)])
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        some = np.flatnonzero(sizes)
        best, score, typical = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if len(some) and self.languages:
            get = self.index.__getitem__
            at = np.fromiter((get(w) for s in split for w in s), dtype=np.int64, count=int(sizes.sum()))
            starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            sums = np.add.reduceat(self.scores[at], starts, axis=0)
            best[some] = sums.argmax(axis=1)
            score[some] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            letters = np.fromiter((sum(map(len, split[i])) for i in some), dtype=np.int64, count=len(some))
            mean, variance = self.mean[best[some]], self.variance[best[some]]
            least = (1 + DRIFT) * mean * letters - SPREADS * np.sqrt(variance * sizes[some])
            typical[some] = sums.max(axis=1) >= least
        return [self.languages[b] if b >= 0 else "und" for b in best], score, typical


def vocabulary(model_path: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, lower-cased, with or without the word mark."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p == MARK or (q := p.removeprefix(MARK)) and q.isalpha())


def train(docs: DataFrame, labelled: Column, model_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 200, words_per_language: int = 100_000, rounds: int = 2) -> PieceModel:
    """Fits piece probabilities on at most ``docs_per_language`` labelled documents a language,
    those with the smallest hashes of their ids, and there on the ``words_per_language`` most frequent words."""
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(sizes)
    pieces = vocabulary(model_path)
    by_length = {}
    for k in {len(p) for p in pieces}:
        some = [i for i, p in enumerate(pieces) if len(p) == k]
        codes = np.frombuffer("".join(pieces[i] for i in some).encode("utf-32-le"), dtype="<u4").reshape(-1, k).astype(np.uint64)
        h = np.zeros(len(some), dtype=np.uint64)
        for j in range(k):
            h = h * FACTOR + codes[:, j]
        order = np.argsort(h)
        by_length[k] = h[order], np.asarray(some)[order]
    probs = np.zeros((len(pieces) + 2, len(languages)))
    probs[:-2] = 1 / len(pieces)
    probs[-1] = UNKNOWN
    model = PieceModel(languages, by_length, probs, np.zeros(len(languages)), np.zeros(len(languages)))
    if not languages:
        return model
    # a hash below a bound that lets twice the wanted number pass, then exactly the smallest hashes
    key = F.xxhash64(F.col(id_col), F.lit("langid"))
    bound = F.lit(0).cast("long")
    for lang, n in sizes.items():
        share = min(1.0, (2 * docs_per_language + 20) / n)
        bound = F.when(F.col(lang_col) == lang, F.lit(int(-2**63 + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).otherwise(bound)
    few = rows.where(key <= bound).withColumn("_n", F.row_number().over(W.partitionBy(lang_col).orderBy(key, id_col))).where(F.col("_n") <= docs_per_language)
    seen = (few.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(text_col), "[^\\p{L}]+")).alias("w"))
            .where(F.length("w").between(1, LONGEST)).groupBy("lang", "w").agg(F.count("*").alias("n")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "w"))
    seen = seen.withColumn("_r", rank).where(F.col("_r") <= words_per_language).select("lang", "w", "n").collect()
    words = sorted({w for _, w, _ in seen})
    place, lang_at = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(words), len(languages)))
    for lang, w, n in seen:
        counts[place[w], lang_at[lang]] += n
    for _ in range(rounds):
        uses = model.expected(words, counts)[:-2] + 0.02
        model.probs[:-2] = uses / uses.sum(axis=0)
    if words:
        scores, sizes = model.word_scores(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))[:, None]
        model.mean = (counts * scores).sum(axis=0) / np.maximum((counts * sizes).sum(axis=0), 1)
        model.variance = (counts * (scores - model.mean * sizes) ** 2).sum(axis=0) / np.maximum(counts.sum(axis=0), 1)
    return model


def identify(docs: DataFrame, model: PieceModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with ``lang_pred``, ``score`` and ``typical``, one row for each row."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "typical")]
    shape = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("typical", T.BooleanType())])

    at = kept.index(text_col) if text_col in kept else len(kept)  # a text is sent to the worker once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, at, STRETCH, 2000):
                names, score, typical = model.texts(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(typical, pa.bool_())], names=shape.names)

    return docs.select(*[F.col(f"`{c}`") for c in kept], *[F.col(text_col).alias("__text")] * (at == len(kept))).mapInArrow(run, shape)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod("doc_id", 3) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
