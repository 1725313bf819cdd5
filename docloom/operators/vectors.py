"""Vector search by blocks: a stated set of queries against every vector, or against a written collection.

Queries go out in blocks of ``QUERY_BLOCK`` as a matrix. Each task multiplies batches of vectors with it and keeps
the best ``k`` of each query, so a task passes on k rows a query, however many vectors it read. No join is made.

A collection is written in cells: centroids are learned on a bounded sample, every vector goes to the nearest
one, and each cell knows how far its farthest vector lies from its centroid. For a query q and a cell of
centroid c and radius r no vector scores over q.c + |q| r, so after the first cells the bound tells which of the others
can still hold a better one: the result is exact (recall 1), whatever the sample.

Scores are rounded to six decimals, and equal ones go to the smaller id. Null vectors are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.retrieval import top

#: Queries that go out to the tasks at once.
QUERY_BLOCK = 1024
#: Vectors that a task multiplies at once, and scores that it holds at once.
VECTOR_BLOCK, SCORE_BLOCK = 2048, 1 << 19


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros, longer ones cut."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :min(n, dim)] = flat[at:at + min(n, dim)]
        at += n
    return out


class Best:
    """The best ``k`` of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        """``scores`` of vectors (rows) for some ``queries`` (columns); NaN is no hit."""
        least = self.least[queries]
        # where most pass, as at first: no score below the block's own k-th best is of use; equal ones are
        if len(scores) > 2 * self.k and np.count_nonzero(scores >= least) > 4 * self.k * len(queries):
            least = np.maximum(least, -np.partition(np.nan_to_num(-scores, nan=np.inf), self.k - 1, axis=0)[self.k - 1])
        rows, cols = np.nonzero(scores >= least)
        if not len(rows):
            return
        query = np.concatenate([self.query, queries[cols]])
        score, own = np.concatenate([self.score, scores[rows, cols]]), np.concatenate([self.id, ids[rows]]) if len(self.id) else ids[rows]
        by = np.unique(own, return_inverse=True)[1] if own.dtype == object else own
        order = np.lexsort((by, -score, query))
        query, score, own = query[order], score[order], own[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], own[keep]
        full = place[keep] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; null vectors stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=x.copy(), where=size > 0)


def _search(vectors: DataFrame, queries: np.ndarray, k: int, by_cell: dict[int, np.ndarray] | None = None, cosine: bool = False) -> DataFrame:
    """``(place, id, score)`` of the best ``k`` of each query and task; ``vectors(id, embedding[, cell])``.
    ``by_cell`` has the places of the queries that look into a cell."""
    n, dim = queries.shape
    every, step = np.arange(n), max(1, min(VECTOR_BLOCK, SCORE_BLOCK // n))
    queries = units(queries) if cosine else queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n, k)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if part.column(1).null_count:
                    part = part.filter(part.column(1).is_valid())
                ids, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim)
                x = units(x) if cosine else x
                if by_cell is None:
                    best.add(np.round(x @ queries.T, 6) + 0.0, ids, every)
                    continue
                cells = part.column(2).to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    if len(asked := by_cell.get(int(cell), every[:0])):
                        own = cells == cell
                        best.add(np.round(x[own] @ queries[asked].T, 6) + 0.0, ids[own], asked)
        yield pa.RecordBatch.from_arrays([pa.array(best.query.astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["place", "id", "score"])

    return vectors.mapInArrow(run, "place int, id long, score double")


def _blocks(queries: DataFrame, query_id: str, vec: str) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """The queries in blocks: ``(place, query)`` as a small table, and the matrix."""
    spark, kind = queries.sparkSession, queries.schema[query_id].dataType.simpleString()
    rows = queries.select(query_id, F.col(vec).cast("array<double>").alias("q")).toLocalIterator()
    held: list = []

    def block() -> tuple[DataFrame, np.ndarray]:
        dim = len(held[0][1])
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(held)], f"place int, `{query_id}` {kind}")
        return names, np.array([[*r[1], *[0.0] * dim][:dim] for r in held])

    for row in rows:
        if row[1] is None:
            continue
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def _ranked(parts: list[DataFrame], query_id: str, id_col: str, k: int, like: DataFrame) -> DataFrame:
    if not parts:
        kind = like.schema[query_id].dataType.simpleString()
        return like.sparkSession.createDataFrame([], f"`{query_id}` {kind}, `{id_col}` long, score double, rank int")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return top(rows.select(query_id, F.col("id").alias(id_col), "score"), query_id, k, F.desc("score"), F.col(id_col))


def top_vectors(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", id_col: str = "vec_id", query_vec: str = "q", vec: str = "embedding", cosine: bool = False) -> DataFrame:
    """``(query, id, score, rank)``: the ``k`` vectors with the largest products of each query, of all vectors; with
    ``cosine``, of queries and vectors at length 1."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("embedding"))
    parts = [_search(rows, matrix, k, cosine=cosine).join(F.broadcast(names), "place") for names, matrix in _blocks(queries, query_id, query_vec)]
    return _ranked(parts, query_id, id_col, k, queries)


def learn_centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means on a sample; a cell that loses all its vectors starts anew at the one farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        apart = (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)
        near = apart.argmin(axis=1)
        far = np.argsort(-apart[np.arange(len(x)), near])
        for c in range(len(centroids)):
            own = near == c
            centroids[c] = x[own].mean(axis=0) if own.any() else x[far[c]]
    return centroids


def _placed(rows: DataFrame, vec: str, centroids: np.ndarray) -> DataFrame:
    """``rows`` with ``cell`` and ``gap``, the distance to its centroid."""
    names = rows.columns
    place, dim = names.index(vec), centroids.shape[1]
    squares = (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(place), dim)
            cell = (squares - 2 * x @ centroids.T).argmin(axis=1)
            gap = np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], names=[*names, "cell", "gap"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]))


def _write_cells(placed: DataFrame, path: str, mode: str) -> None:
    # each task writes its rows of a cell, so a cell of any size is spread
    placed.write.mode(mode).partitionBy("cell").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/vectors")


def _write_bounds(spark, path: str, centroids: np.ndarray) -> None:
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    far = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n"))
    known.join(far, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def write_collection(vectors: DataFrame, path: str, cells: int = 64, sample: int = 20_000, id_col: str = "vec_id", vec: str = "embedding") -> None:
    """A collection below ``path``. The centroids are learned on the ``sample`` vectors with the smallest hashes
    of their ids; every row is written, with all its columns. The vectors' dimension is that of the first."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull())
    some = rows.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("x")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not some:
        raise ValueError("a collection needs a vector to learn its cells from")
    dim = len(some[0]["x"])
    centroids = learn_centroids(np.array([[*r["x"], *[0.0] * dim][:dim] for r in some]), cells)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _write_cells(_placed(rows, vec, centroids), path, "overwrite")
    _write_bounds(spark, path, centroids)


def _centroids(spark, path: str) -> np.ndarray:
    return np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])


def upsert_collection(rows: DataFrame, path: str, id_col: str = "vec_id", vec: str = "embedding") -> list[int]:
    """Puts rows into a collection, in place of those with their ids; rewrites and returns the touched cells:
    those that rows go to, and those that hold a row with one of the ids. Rows of one id: any."""
    spark = rows.sparkSession
    centroids = _centroids(spark, path)
    placed = _placed(rows.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).dropDuplicates([id_col]), vec, centroids)
    placed.write.mode("overwrite").parquet(f"{path}/incoming")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/incoming")
    now = spark.read.parquet(f"{path}/vectors")
    held = now.select(id_col, "cell").join(placed.select(id_col), id_col, "left_semi")
    touched = sorted(r[0] for r in placed.select("cell").union(held.select("cell")).distinct().collect())  # cells, not rows
    stay = now.where(F.col("cell").isin(touched)).join(placed.select(id_col), id_col, "left_anti")
    both = stay.select(*placed.columns).unionByName(placed)
    both.write.mode("overwrite").parquet(f"{path}/rewritten")  # the cells are read and replaced
    emptied = set(touched) - {r[0] for r in spark.read.parquet(f"{path}/rewritten").select("cell").distinct().collect()}
    _write_cells(spark.read.schema(both.schema).parquet(f"{path}/rewritten"), path, "overwrite")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in (*[f"vectors/cell={c}" for c in emptied], "incoming", "rewritten"):
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    _write_bounds(spark, path, centroids)
    return touched


def search_collection(queries: DataFrame, path: str, k: int, probes: int = 4, exact: bool = True, query_id: str = "query_id", id_col: str = "vec_id", query_vec: str = "q", where: str = "true") -> DataFrame:
    """``(query, id, score, rank)`` from a collection, of the rows that meet ``where``.

    First each query looks into the ``probes`` cells with the highest bounds; then, if ``exact``, into every other
    cell whose bound is not below its k-th best score so far. Folders of cells that no query needs are not read."""
    spark = queries.sparkSession
    known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    cells, radius = np.array([r["cell"] for r in known]), np.array([r["radius"] for r in known])
    centroids = np.array([r["centroid"] for r in known])
    rows = spark.read.parquet(f"{path}/vectors").where(where).select(F.col(id_col).cast("long").alias("id"), F.col("embedding"), "cell")
    parts = []
    for names, matrix in _blocks(queries, query_id, query_vec):
        dim = centroids.shape[1]
        matrix = np.pad(matrix, ((0, 0), (0, max(0, dim - matrix.shape[1]))))[:, :dim]
        bound = matrix @ centroids.T + np.linalg.norm(matrix, axis=1)[:, None] * radius + 2e-6
        order = np.argsort(-bound, axis=1, kind="stable")
        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, order[:, :probes], True, axis=1)

        def look(wanted: np.ndarray, matrix: np.ndarray = matrix) -> DataFrame:
            asked = {int(cells[j]): np.flatnonzero(wanted[:, j]) for j in range(len(cells)) if wanted[:, j].any()}
            return _search(rows.where(F.col("cell").isin(list(asked))), matrix, k, asked)

        found = look(first)
        if exact and probes < len(cells):
            best = np.full(len(matrix), -np.inf)
            kth = top(found, "place", k, F.desc("score"), F.col("id")).where(F.col("rank") == k)
            for r in kth.select("place", "score").collect():  # a number for each query of the block
                best[r["place"]] = r["score"]
            rest = ~first & (bound >= best[:, None])
            if rest.any():
                found = found.unionByName(look(rest))
        parts.append(found.join(F.broadcast(names), "place"))
    return _ranked(parts, query_id, id_col, k, queries)
