"""Hashing in blocks and bounded batches: results do not depend on the cuts, memory on no batch size."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from docloom.llm import near_dup, suffix
from docloom.llm.common import by_bytes


def test_hashes_in_blocks(monkeypatch):
    """Words and shingle sets do not depend on where the blocks end, also for words longer than a block."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "é", "ก", " ", "\n", "zebra", "x" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", None, " \t ", "one"]
    whole = [near_dup.word_hashes(near_dup.raw_text(t)) for t in texts]
    sets = [near_dup.shingle_sets([t], 4)[0] for t in texts]
    for t, h in zip(texts, whole):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(h) == len(words)
        assert [near_dup.word_hashes(w.encode())[0] for w in words] == h.tolist()
    together = near_dup.shingle_sets(texts, 4)
    for block in (1, 7, 64):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "_UP", near_dup._powers(near_dup._BASE))
        monkeypatch.setattr(near_dup, "_DOWN", near_dup._powers(near_dup._UNBASE))
        for i, t in enumerate(texts):
            assert np.array_equal(near_dup.word_hashes(near_dup.raw_text(t)), whole[i])
            assert np.array_equal(near_dup.shingle_sets([t], 4)[0], sets[i]) and np.array_equal(together[i], sets[i])


def test_minimisers_in_stretches(monkeypatch):
    """Every window of grams keeps its first least one, wherever the stretches end."""
    for n, kinds in ((0, 9), (49, 9), (50, 9), (51, 3), (400, 5), (1000, 2**60)):
        h = np.random.default_rng(n).integers(0, kinds, n, dtype=np.uint64)
        grams = near_dup._grams(h, 12)
        need = {i + int(grams[i:i + 39].argmin()) for i in range(len(grams) - 38)}
        for stretch in (1, 30, 1 << 16):
            monkeypatch.setattr(suffix, "STRETCH", stretch)
            at, found = suffix.minimisers(h, 12, 39)
            assert need <= set(at.tolist()) and np.array_equal(grams[at], found) and (np.diff(at) > 0).all()


def test_batches_by_bytes_and_memory_of_long_texts():
    sizes = [5, 200, 5, 5, 0, 90, 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["y" * n for n in sizes] + [None])], names=["doc_id", "text"])
    parts = [p.column(0).to_pylist() for p in by_bytes(batch, 1, 100, rows=3)]
    assert sum(parts, []) == list(range(8)) and parts == [[0], [1], [2, 3, 4], [5], [6, 7]]
    assert not list(by_bytes(batch.slice(8), 1, 100))
    raw = np.random.default_rng(1).integers(97, 123, 24_000_000, dtype=np.uint8)
    raw[np.random.default_rng(2).integers(0, len(raw), len(raw) // 6)] = 32
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([raw.tobytes().decode()])], names=["doc_id", "text"])
    for work in (near_dup._signatures(4), near_dup._sets(4), suffix._anchors(12, 39)):
        tracemalloc.start()
        assert sum(b.num_rows for b in work(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 5 * len(raw)
