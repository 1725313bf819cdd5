"""Sum-of-squares online packing of token sequences into fixed windows.

Every Spark partition is packed on its own, in one pass, so nothing is shuffled. A document is its
tokenizer ids followed by an end id. Stretches of ``window`` ids are cut off and fill windows alone;
the rest is placed online: of the fill levels at which an open window exists (or an empty one), it
goes to the level after which the sum over all levels of (number of windows at the level) squared is
least. The counts live in one level array. Open windows are bounded: beyond ``max_open`` of them, and
at the end of the partition, the open windows' pieces are laid end to end and recut, which leaves at
most one window of a partition partly filled.

Null texts count as empty (their document is the end id alone); a null id is carried along; repeated
rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])
#: Words (and 16 times as many ids) beyond which a worker's encoder starts anew.
WORD_CACHE = 300_000
#: Strings in a text at which white space does not tell where pre-tokens end.
APART = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Bytes of text that a worker encodes at once.
STRETCH = 2_000_000


class WordEncoder:
    """The ids of ``tokenizers`` for a lower-casing byte-level word BPE, with each word encoded once.

    The vocabulary's pre-tokens never cross white space, so a text's ids are those of its
    white-space chunks in turn, and a chunk's are those of its pre-tokens. Arrow cuts a batch of texts
    into chunks and numbers the distinct ones; only these are looked up in Python. Texts in which
    that might not hold (special tokens, the separators U+001C to U+001F, code points that Python's
    Unicode tables don't know, which the tokenizer may class otherwise) are encoded whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = self.tokenizer.model.tokenize
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}  # chunk -> its place in starts and lengths
        self.pieces: dict[str, bytes] = {}
        # place 0 is of chunks that can't be encoded by themselves
        self.starts, self.lengths, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def direct(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def piece(self, p: str) -> bytes:
        shown = p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.alphabet)
        self.pieces[p] = raw = array("I", [t.id for t in self.bpe(shown)]).tobytes()
        return raw

    def learn(self, chunks: list[str]) -> None:
        known, one = self.pieces, self.piece
        odd = {c for c in chunks if not (c.isascii() or c.isprintable()) and any(category(x) == "Cn" for x in c)}
        if odd:
            self.places.update(dict.fromkeys(odd, 0))
            chunks = [c for c in chunks if c not in odd]
        raws = [b"".join([known[p] if p in known else one(p) for p in self.split(c)]) for c in chunks]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        self.places.update(zip(chunks, range(len(self.lengths), len(self.lengths) + len(chunks))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(raws), "<u4")])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        if len(self.places) > WORD_CACHE or len(self.pool) > 16 * WORD_CACHE:
            self.forget()
        out: list = [self.direct(t) if any(x in t for x in APART) else None for t in texts]
        plain = [i for i, ids in enumerate(out) if ids is None]
        norm = [t.lower() if (t := texts[i]).isascii() else " ".join(normalize("NFC", t).replace("Σ", "σ").lower().split()) for i in plain]
        chunks = pc.ascii_split_whitespace(pa.array(norm, pa.large_string()))
        coded = chunks.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [c for c in names if c not in self.places]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.places.__getitem__, names), np.int32, len(names))[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        from_ = np.repeat((self.starts[at] - ends[:-1]).astype(np.int32), lengths)
        from_ += np.arange(len(from_), dtype=np.int32)
        ids = self.pool[from_]
        bounds = ends[chunks.offsets.to_numpy()].tolist()
        for i, a, z in zip(plain, bounds, bounds[1:]):
            out[i] = ids[a:z]
        for i in np.unique(np.searchsorted(chunks.offsets.to_numpy(), np.flatnonzero(at == 0), "right") - 1).tolist():
            out[plain[i]] = self.direct(texts[plain[i]])
        return out


class Packer:
    """The level array and the open windows of one partition."""

    def __init__(self, window: int, first_id: int, max_open: int):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)  # windows at each fill level
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        cut = n - n % w
        for a in range(0, cut, w):
            self.close([(doc_id, a, ids[a:a + w], n)])
        if cut < n:
            self.place((doc_id, cut, ids[cut:].copy(), n))  # an open window holds no long document

    def place(self, piece: tuple) -> None:
        s, w, counts = len(piece[2]), self.window, self.counts
        # the change of the sum of squares, halved, less one half: N[h+s] - N[h] + 1 in general
        change = counts[s:].astype(np.float64)  # by level h = 0 .. w - s
        change[1:] += 1 - counts[1:w - s + 1]
        change[0] += 0.5
        change[w - s] -= 0.5 + counts[w]  # a full window is in no level
        change[1:][counts[1:w - s + 1] == 0] = np.inf
        level = w - s - int(np.argmin(change[::-1]))  # of equals, the fullest
        if level:
            windows = self.open[level]
            pieces = windows.pop()
            counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + s == w:
            self.close(pieces)
            return
        self.open.setdefault(level + s, []).append(pieces)
        counts[level + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.recut(last=False)

    def close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), n, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def recut(self, last: bool) -> None:
        """Lays the open windows' pieces end to end and cuts them anew at every full window."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        now, fill = [], 0
        for doc_id, start, ids, n in pieces:
            while len(ids):
                part = ids[:self.window - fill]
                now.append((doc_id, start, part, n))
                start, ids, fill = start + len(part), ids[len(part):], fill + len(part)
                if fill == self.window:
                    self.close(now)
                    now, fill = [], 0
        if now and last:
            self.close(now)
        elif now:
            self.open[fill] = [now]
            self.counts[fill] = self.n_open = 1


_encoders: dict[str, WordEncoder] = {}


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of a batch that hold about ``STRETCH`` bytes of text, one row at least."""
    place = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)) // STRETCH
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
    yield from ((int(a), int(z - a)) for a, z in zip(cuts, cuts[1:]) if z > a)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = 2048, max_open: int = 1024) -> DataFrame:
    """One row per piece; see the module's notes. ``sequence_id`` is unique over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
        encode = _encoders[tokenizer_path]
        packer = Packer(window, TaskContext.get().partitionId() << 36, max_open)

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows)) or [()] * len(SCHEMA)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=SCHEMA.names)

        end = np.full(1, end_id, dtype="<u4")
        for batch in batches:
            for at, n in _stretches(batch.column(1)):
                part = batch.slice(at, n)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    packer.add(doc_id, np.concatenate([ids, end]))
                yield out()
        packer.recut(last=True)
        yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op2_pack_sequences(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docloom.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
