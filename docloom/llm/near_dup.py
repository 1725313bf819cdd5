"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each document's shingle set gets a digest and a signature of ``COORDINATES`` minima. Documents
   with equal sets form one class, whose smallest id stands for it from here on.
2. Each class is posted under its coordinate-value pairs. Values seen once are dropped, and of the
   rest each class skips its ``MATCHES - 1`` most frequent: two classes that agree in ``MATCHES``
   coordinates still meet under one of the remaining (the prefix filter).
3. Merging the postings, first every class is paired only with the most central class of each
   posting, the one whose coordinates are most widely shared. Pairs that agree in ``MATCHES``
   coordinates are confirmed on their full shingle sets and give components.
4. Then only postings that still hold more than one component are merged, and there only pairs from
   different components: a large family costs one pair a member, not all its pairs.

Pairs must also pass an exact test on a parity sketch (bit i tells whether an odd number of the set's
hashes end in i): sketches differ in no more bits than the sets differ in shingles, so a pair whose
sketches differ in more than the similarity allows cannot be a link. No link is lost by it.

Two sets of similarity 0.8 agree in fewer than 16 of 32 coordinates with a chance below 4 in 100,000.

Null and blank texts have an empty set and are linked with nothing. Rows with a null id are returned
with a null component and kept. Rows that share an id count as versions of one document and share a
component. Ties of any kind go to the smaller id. Very long texts are taken whole, hashed in blocks, so that
beside the text a worker holds some 16 bytes a word. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import by_bytes, remove, table, work_dir, written

COORDINATES, MATCHES = 32, 16
#: Bits of the parity sketch, kept as 64-bit numbers.
SKETCH_BITS = 1024
#: Up to so many candidate ids (8 bytes each) are broadcast; beyond, they are shuffled.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERM = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = np.arange(256) + 32 * ((np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z")))
_FOLDED = _BYTE[_LOWERED]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Short texts are hashed together up to so many bytes; a longer one alone, in blocks of as many.
BLOCK = 1 << 18


def _powers(base: np.uint64) -> np.ndarray:
    p = np.full(BLOCK + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_UNBASE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def cells(column: pa.Array) -> list:
    """A column's texts; a text alone (so maybe a long one) as an Arrow cell, which is not copied."""
    return [column[0]] if len(column) == 1 else column.to_pylist()


def raw_text(text) -> bytes | pa.Buffer:
    """UTF-8 bytes of a text or of an Arrow cell; null is empty."""
    if isinstance(text, pa.Scalar):
        return text.as_buffer() or b""
    return (text or "").encode("utf-8", "surrogatepass")


def word_blocks(raw: bytes | pa.Buffer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased, block by
    block; a word that crosses blocks, however long, comes out whole with the block that ends it."""
    b = np.frombuffer(raw, dtype=np.uint8)
    open_start, open_sum = -1, np.uint64(0)  # the word that reaches the block's start
    for at in range(0, len(b), BLOCK):
        part = b[at:at + BLOCK]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[part]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_FOLDED[part] * _UP[:len(part)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _DOWN[starts]
        starts += at
        if open_start >= 0:
            if len(starts) and starts[0] == at:
                h[0] = np.uint64((int(open_sum) + int(h[0]) * pow(int(_BASE), at - open_start, 1 << 64)) % (1 << 64))
                starts[0] = open_start
            else:
                starts, h = np.append(open_start, starts), np.append(open_sum, h)
            open_start = -1
        if len(ends) and ends[-1] == len(part) and at + BLOCK < len(b):
            open_start, open_sum, starts, h = int(starts[-1]), h[-1], starts[:-1], h[:-1]
        yield starts, mix(h)


def word_hashes(raw: bytes | pa.Buffer) -> np.ndarray:
    blocks = [h for _, h in word_blocks(raw)]
    return blocks[0] if len(blocks) == 1 else np.concatenate(blocks or [np.empty(0, np.uint64)])


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return h[:0]
    total = h[:len(h) - width + 1] * _PLACE[0]
    for i in range(1, width):
        total += h[i:len(h) - width + 1 + i] * _PLACE[i]
    return mix(total)


def _whole(h: np.ndarray) -> np.ndarray:
    """Fewer words than a shingle: the whole sequence, told apart by its length."""
    return mix((h * _PLACE[:len(h)]).sum(dtype=np.uint64, keepdims=True) + _PERM[len(h)]) if len(h) else h


def long_set(raw: bytes | pa.Buffer, width: int) -> np.ndarray:
    """The shingle set of one long text, from blocks that overlap by ``width - 1`` words."""
    found, last = [], np.empty(0, np.uint64)
    for _, h in word_blocks(raw):
        h = np.concatenate([last, h])
        found.append(np.unique(_grams(h, width)))
        last = h[max(0, len(h) - width + 1):]
    items = np.concatenate(found or [last])
    del found
    if not len(items):
        return _whole(last)
    items.sort()
    return items[np.append(True, items[1:] != items[:-1])]


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text, A-Z lower-cased."""
    raws = [raw_text(t) for t in texts]
    if len(raws) == 1:
        return [long_set(raws[0], width)]
    bounds = np.cumsum([0] + [len(r) + 1 for r in raws])
    blocks = list(word_blocks(b"\n".join(raws)))
    starts, h = np.concatenate([s for s, _ in blocks]), np.concatenate([h for _, h in blocks])
    first = np.searchsorted(starts, bounds).tolist()
    grams = _grams(h, width)
    return [np.unique(grams[a:z - width + 1]) if z - a >= width else _whole(h[a:z]) for a, z in zip(first[:-1], first[1:])]


def _digest(s: np.ndarray) -> tuple[int, int, np.ndarray | None, np.ndarray]:
    """Two digests of a set, its signature and its parity sketch, some thousand shingles at a time."""
    perm, salt = _PERM[:COORDINATES, None], _PERM[100:100 + COORDINATES]
    a = b = np.zeros(1, np.uint64)
    least, odd = np.full(COORDINATES, 2**64 - 1, np.uint64), np.zeros(SKETCH_BITS, np.int64)
    for at in range(0, len(s), 4096):
        x = s[at:at + 4096]
        a, b = a + mix(x ^ _PERM[200]).sum(dtype=np.uint64), b + mix(x + _PERM[201]).sum(dtype=np.uint64)
        least = np.minimum(least, (x[None, :] * perm).min(axis=1))
        odd += np.bincount((x % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    # a coordinate's value is salted by its place, so the value alone names the pair
    sig = mix(least + salt).astype(np.int64) if len(s) else None
    return int(a.astype(np.int64)[0]), int(b.astype(np.int64)[0]), sig, np.packbits((odd & 1).astype(np.uint8)).view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BLOCK):
                made = [(len(s), *_digest(s)) for s in shingle_sets(cells(part.column(1)), width)]
                n, a, b, sig, odd = zip(*made)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "odd"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, BLOCK):
                sets = shingle_sets(cells(part.column(1)), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.data for s in sets], pa.binary())], names=["doc_id", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(x) + len(y)
                shared = both - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * shared >= percent * (both - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, path: str) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``: the smallest id reachable.

    Alternating large-star and small-star steps; each round is a table below ``path``.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{path}/0")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first()
    was, n = state(now), 0
    while was[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        n += 1
        old, now = f"{path}/{n - 1}", written(small, f"{path}/{n}")
        remove(spark, old)
        if (new := state(now)) == was:
            break
        was = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over
    links of at least ``percent`` % similarity of ``width``-word shingle sets), kept, n_copies (rows
    with an equal set, itself included)."""
    spark, base = docs.sparkSession, work_dir(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = written(docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>, odd array<long>"), f"{base}/sigs")
    whole = sigs.where("doc_id is not null and n_shingles > 0")
    classes = written(whole.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"), F.first("odd").alias("odd")), f"{base}/classes")

    posts = classes.select("rep", F.explode("sig").alias("key"))
    common = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    met = posts.join(common, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
    met = met.where(F.size("keys") >= MATCHES).select("rep", F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("shared"), F.slice("keys", 1, F.size("keys") - (MATCHES - 1)).alias("keys"))
    prefix = written(met.select("rep", "shared", F.explode("keys.key").alias("key")), f"{base}/prefix")
    centres = prefix.groupBy("key").agg(F.max(F.struct("shared", (-F.col("rep")).alias("id"))).alias("c")).select("key", (-F.col("c.id")).alias("centre"))
    by_rep = classes.select("rep", "n_shingles", "sig", "odd")

    def agreeing(x: str, y: str):
        return F.size(F.array_intersect(x, y)) >= MATCHES  # values are salted by place

    def sized(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def close(x: str, y: str, nx: str, ny: str):
        # sets of that similarity differ in at most (100 - percent) / (100 + percent) of both sizes
        apart = sum(F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(SKETCH_BITS // 64))
        return apart * (100 + percent) <= (F.col(nx) + F.col(ny)) * (100 - percent)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = written(pairs, f"{base}/{name}-pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        ids = written(ids, f"{base}/{name}-ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = written(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, items binary").distinct(), f"{base}/{name}-sets")
        sided = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        links = written(sided.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"), f"{base}/{name}-links")
        remove(spark, f"{base}/{name}-sets")
        return links

    star = prefix.join(centres, "key").where("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    star = (star.join(by_rep.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"), F.col("odd").alias("oa")), "a")
            .join(by_rep.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"), F.col("odd").alias("ob")), "b")
            .where(sized("na", "nb") & close("oa", "ob", "na", "nb") & agreeing("sa", "sb")).select("a", "b"))
    links = confirmed(star, "star")
    roots = components(links, f"{base}/star-roots")

    placed = prefix.select("rep", "key").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = written(placed.join(open_keys, "key").join(centres, "key").join(by_rep, "rep"), f"{base}/rest")
    hub = rest.where("rep = centre").select("key", F.col("root").alias("hub"))
    rest = rest.join(hub, "key")
    x = rest.where("root <> hub").select("key", F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"), F.col("odd").alias("oa"))
    y = rest.where("rep <> centre").select("key", F.col("rep").alias("b"), F.col("root").alias("rb"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"), F.col("odd").alias("ob"), (F.col("root") == F.col("hub")).alias("of_hub"))
    cross = x.join(y, (x["key"] == y["key"]) & (F.col("ra") != F.col("rb")) & (F.col("of_hub") | (F.col("a") < F.col("b"))) & sized("na", "nb") & close("oa", "ob", "na", "nb") & agreeing("sa", "sb"))
    more = confirmed(cross.select("a", "b").distinct(), "cross")
    roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), f"{base}/roots"), f"{base}/final")
    for name in ("star-roots", "roots", "rest", "prefix"):
        remove(spark, f"{base}/{name}")

    changed = (classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").where("n_copies > 1 or root is not null")
               .select("n_shingles", "set_a", "set_b", "n_copies", F.coalesce("root", "rep").alias("root")))
    # rows with an empty set or a null id find no class
    own = sigs.select("doc_id", "n_shingles", "set_a", "set_b")
    out = own.join(changed, ["n_shingles", "set_a", "set_b"], "left")
    root = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def op3_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
