"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of the pivots nearest to it (largest inner product), cut
after ``prefix`` pivots.  The index deals all rows to shards of bounded size by a hash; a shard keeps
its vectors and, for each pivot, an inverted file of the rows that have it among their
nearest, with its place there.  A query walks the inverted files of its own pivots and adds up
for every row how far the two orders agree, which gives the footrule distance of the cut orders;
in each shard the rows of smallest distance (a share, and all rows as near as the last of them) are
ranked anew by their exact inner product.  Queries go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import in_arrow
from nearfield.session import materialize

PIVOTS = 256
PREFIX = 64
# Share of a shard's rows that are ranked anew, and how many over all shards at least.
SHARE = 0.1
LEAST = 400
SHARD_ROWS = 8192
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20

_INDEX = "ids array<bigint>, vectors array<double>, rows array<int>, places array<int>, starts array<int>"


def _usable(vector: Column) -> Column:
    """Not null, finite throughout and not zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    found = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return found.where(F.col("id").isNotNull() & _usable(F.col("vector")))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def choose_pivots(rows: DataFrame, count: int) -> np.ndarray:
    """Up to ``count`` different vectors: those of smallest hash."""
    sample = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(4 * count).collect()
    return np.array(list(dict.fromkeys(tuple(r["vector"]) for r in sample))[:count])


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the ``prefix`` nearest pivots of each vector, nearest first; equal ones by number."""
    near = -np.einsum("ij,kj->ik", vectors, pivots)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix]


def _build(pivots: np.ndarray, prefix: int, most: int):
    def shard(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        near = nearest_pivots(vectors, pivots, prefix)
        n, width = near.shape
        order = np.argsort(near.ravel(), kind="stable")
        starts = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1))
        made = {"ids": ids, "vectors": vectors.ravel(), "rows": (order // width).astype(np.int32), "places": (order % width).astype(np.int32), "starts": starts.astype(np.int32)}
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x, kind in zip(made.values(), kinds)], list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return shard(table.column("id").to_numpy(), matrix(table.column("vector"), pivots.shape[1]))

        for batch in batches:
            number = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
                while a < b:
                    # Rows come sorted by shard; one with far more rows than planned is cut.
                    if held and (number[a] != last or size >= most):
                        yield close()
                        held, size = [], 0
                    some = min(b - a, most - size)
                    held.append(batch.slice(a, some))
                    size, last, a = size + some, number[a], a + some
        if held:
            yield close()

    return run


def build(rows: DataFrame, dims: int, pivots: np.ndarray, prefix: int = PREFIX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written index of ``rows`` (id, vector of ``dims`` elements): one row per shard."""
    planned = max(1, min(shard_rows, SHARD_BYTES // (8 * dims)))
    shards = max(1, -(-rows.count() // planned))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards))).repartition("shard")
    dealt = dealt.sortWithinPartitions("shard", "id", "vector")
    return materialize(in_arrow(dealt, _build(pivots, min(prefix, len(pivots)), 2 * planned), _INDEX), "permutations")


def agreement(order: np.ndarray, postings, n_rows: int, prefix: int) -> np.ndarray:
    """For every row, how far its cut order agrees with the query's.

    A pivot at places a and b of the two orders adds ``prefix - max(a, b)``, one that either lacks
    nothing.  With a lacking pivot taken to stand at place ``prefix``, the footrule distance
    is ``prefix * (prefix + 1)`` less twice this sum.
    """
    total = np.zeros(n_rows, np.int32)
    for place, pivot in enumerate(order.tolist()):
        rows, weights = postings(pivot)
        total[rows] += np.minimum(weights, prefix - place)
    return total


def _search(asked: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int, k: int, share: float, least: float):
    orders = nearest_pivots(vectors, pivots, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [np.empty(0)] * len(asked)
        ids = [np.empty(0, np.int64)] * len(asked)
        for batch in batches:
            for i in range(batch.num_rows):
                own, flat, rows, places, starts = (batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("ids", "vectors", "rows", "places", "starts"))
                stored = flat.reshape(len(own), -1)
                # Equal vectors of one id are one candidate each; the query's own id is none.
                weights = (prefix - places).astype(np.int32)
                wanted = int(np.ceil(max(share * len(own), least)))

                def postings(pivot: int) -> tuple[np.ndarray, np.ndarray]:
                    return rows[starts[pivot] : starts[pivot + 1]], weights[starts[pivot] : starts[pivot + 1]]

                for q in range(len(asked)):
                    total = agreement(orders[q], postings, len(own), prefix)
                    total[own == asked[q]] = -1
                    cut = np.partition(total, len(total) - wanted)[len(total) - wanted] if wanted < len(total) else 0
                    near = np.flatnonzero(total >= max(cut, 0))
                    score = np.append(scores[q], (stored[near] * vectors[q]).sum(axis=1))
                    name = np.append(ids[q], own[near])
                    if len(score) > k:
                        some = score >= np.partition(score, len(score) - k)[len(score) - k]
                        score, name = score[some], name[some]
                    order = np.lexsort((name, -score))[:k]
                    scores[q], ids[q] = score[order], name[order]
        if any(map(len, ids)):
            sizes = np.array([len(x) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked, sizes)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"]
            )

    return run


def search(
    rows: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS,
    prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` rows of largest inner product of every query.

    Scores are exact, in double precision; equal ones rank by smaller id.  Vectors that are null,
    empty or zero or hold a null or non-finite element, and rows without an id, take no part, neither as
    queries nor as candidates.  A query's own id is no candidate; further rows of one id are
    candidates each, and a query row that repeats another's id and vector is the same query.  Vectors
    meet only those of their own length, each length with an index of its own.  Empty tables give no rows; other columns are ignored.
    """
    base, asked = materialize(vectors_of(rows, id_col, vector_col), "base"), vectors_of(queries, id_col, vector_col).distinct()
    result = rows.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    for dims, n in sorted(tuple(r) for r in asked.groupBy(F.size("vector")).count().collect()):
        alike = base.where(F.size("vector") == dims)
        chosen = choose_pivots(alike, pivots)
        if not len(chosen):
            continue
        width = min(prefix, len(chosen))
        index = build(alike, dims, chosen, prefix, shard_rows)
        shards = index.count()
        blocks = max(1, -(-n * 8 * (dims + width) // block_bytes))
        for block in range(blocks):
            some = asked.where(F.size("vector") == dims)
            if blocks > 1:
                some = some.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
            table = some.orderBy("id", "vector").toArrow()
            run = _search(table.column("id").to_numpy(), matrix(table.column("vector"), dims), chosen, width, k, share, least / shards)
            result = result.unionByName(in_arrow(index, run, result.schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
