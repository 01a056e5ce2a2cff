"""Exact top-k inner products by a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import stage

SCALE = 1024
CELLS = 16
# Queries looked for in one pass over the file; a block of them is what each task holds.
QUERY_BLOCK = 2048
# Vectors whose bounds are computed together, and exact vectors read between two looks at the bound.
SCAN_ROWS = 2048
READ_ROWS = 32


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector``: components floor(1024 * x); vectors null or with null or non-finite
    components, and rows without a vec_id, are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vector"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def build(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The file, ``vec_id, cells, vector``, and the edges of the cells of each dimension.

    A dimension's range over all vectors is cut into ``CELLS`` equal cells; a vector's
    approximation is one byte per dimension. Every vector is in the file, which is written to the
    shared folder. The driver sees one row per dimension.
    """
    vectors = stage(vectors, "vectors")
    ranges = vectors.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rows = sorted(ranges.collect())
    width = len(rows)
    low = np.array([min(r.a, 0) for r in rows], np.int64)
    high = np.array([max(r.b, 0) for r in rows], np.int64)
    step = (high - low) // CELLS + 1
    edges = low[:, None] + step[:, None] * np.arange(CELLS + 1)

    def approximate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = _matrix(batch.column("vector"), width)
            cells = ((exact - low) // step).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed, batch.column("vector")], ["vec_id", "cells", "vector"])

    return stage(vectors.mapInArrow(approximate, "vec_id long, cells binary, vector array<long>"), "cells"), edges


class _Best:
    """The k best vectors seen so far for one query, larger scores and then smaller ids first."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bound(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort([ids, -scores])[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _scan(ids: np.ndarray, cells: np.ndarray, exact: np.ndarray, edges: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: list[_Best]) -> None:
    """Bounds of all vectors for all queries from the cells, then exact scores in the order of the bounds."""
    dims = np.arange(cells.shape[1])
    lower, upper = edges[dims, cells].astype(float), (edges[dims, cells + 1] - 1).astype(float)
    positive, negative = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    most = positive @ upper.T + negative @ lower.T
    for number, found in enumerate(best):
        bounds = most[number]
        hopeful = np.flatnonzero((bounds >= found.bound) & (ids != query_ids[number]))
        hopeful = hopeful[np.argsort(-bounds[hopeful], kind="stable")]
        for at in range(0, len(hopeful), READ_ROWS):
            read = hopeful[at : at + READ_ROWS]
            if bounds[read[0]] < found.bound:
                break
            found.add(exact[read] @ queries[number], ids[read])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k vectors of largest inner product.

    Both sides are ``vec_id, vector`` of integers; a vector with the query's own vec_id is not a
    candidate. Ties go to the smaller vec_id; fewer than k candidates are all returned; repeated
    rows count each. Shorter vectors count as filled up with zeros. Each block of ``QUERY_BLOCK``
    queries is held by every task of one pass over the file, which keeps k vectors per query; the
    lists of all tasks are then merged per query. Inner products must fit a long, and
    bounds are exact while they stay below 2^53. Empty sides give no rows.
    """
    index, edges = build(vectors)
    width = len(edges)
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    merged = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        query_ids = own.column("vec_id").to_numpy()
        longest = max([width, *[len(v) for v in own.column("vector").to_pylist()]])
        chunk = own.column("vector").combine_chunks()
        held = _matrix(chunk, longest)[:, :width] if own.num_rows else np.zeros((0, width), np.int64)

        def scan(batches: Iterable[pa.RecordBatch], query_ids: np.ndarray = query_ids, held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            best = [_Best(k) for _ in query_ids]
            for batch in batches:
                for at in range(0, batch.num_rows, SCAN_ROWS):
                    piece = batch.slice(at, SCAN_ROWS)
                    cells = np.frombuffer(b"".join(piece.column("cells").to_pylist()), np.uint8).reshape(-1, width)
                    exact = _matrix(pa.array(piece.column("vector").to_pylist(), pa.list_(pa.int64())), width)
                    _scan(piece.column("vec_id").to_numpy(), cells, exact, edges, query_ids, held, best)
            sizes = [len(b.ids) for b in best]
            columns = [
                np.repeat(np.arange(len(best)), sizes),
                np.repeat(query_ids, sizes),
                np.concatenate([np.empty(0, np.int64), *[b.ids for b in best]]),
                np.concatenate([np.empty(0, np.int64), *[b.scores for b in best]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["number", "query_id", "vec_id", "score"])

        part = index.mapInArrow(scan, "number long, query_id long, vec_id long, score long")
        part = part.withColumn("block", F.lit(block))
        merged = part if merged is None else merged.unionByName(part)
    ranks = Window.partitionBy("block", "number").orderBy(F.col("score").desc(), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
