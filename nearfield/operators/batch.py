"""User functions over vector batches, and sums of vectors per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from nearfield.functions.quantize import encode
from nearfield.operators.kernel import to_matrix
from nearfield.session import parallelism, ship_package


@dataclass
class VectorBatch:
    """A run of consecutive rows: float vectors, or int8 codes when asked for."""

    batch_id: int
    keys: np.ndarray
    vectors: np.ndarray | None
    byte_vectors: np.ndarray | None
    dimensions: int
    start_index: int

    def __len__(self) -> int:
        return len(self.keys)


def apply_to_batches(
    df: DataFrame, fn: Callable[[VectorBatch], Mapping[str, object]], schema: str, batch_size: int = 1024, as_bytes: bool = False
) -> DataFrame:
    """Run ``fn`` once per batch of ``batch_size`` row positions.

    ``df`` has ``row_id, vector``; ``fn`` returns the values of ``schema``.  The
    result has one row per batch, led by ``batch_id``; an exception in ``fn``
    fails the job.  A batch whose rows all lie in one partition is done there; only rows of batches
    that partitions share, or that do not fit into ``_HELD_BATCHES`` at a time, are exchanged.
    """
    met = local_batches(df, fn, schema, batch_size, as_bytes).repartition("batch_id").sortWithinPartitions("batch_id", "row_id")
    batches = _Batches(fn, StructType.fromDDL(schema), batch_size, as_bytes)
    return met.mapInArrow(batches.shared, batches.mixed).select("batch_id", "out.*")


def local_batches(df: DataFrame, fn: Callable[[VectorBatch], Mapping[str, object]], schema: str, batch_size: int, as_bytes: bool) -> DataFrame:
    """``batch_id, row_id, vector, out``: the result (``out``) of each batch that one partition holds, and the rows of the others."""
    ship_package(df.sparkSession)
    batches = _Batches(fn, StructType.fromDDL(schema), batch_size, as_bytes)
    numbered = df.select("row_id", F.col("vector").cast("array<float>").alias("vector")).withColumn(
        "batch_id", F.floor(F.col("row_id") / batch_size).cast("bigint")
    )
    return numbered.mapInArrow(batches.here, batches.mixed)


class _Batches:
    """The two steps of :func:`apply_to_batches` inside tasks."""

    def __init__(self, fn: Callable, value_type: StructType, batch_size: int, as_bytes: bool):
        self.fn, self.batch_size, self.as_bytes, self.held_most = fn, batch_size, as_bytes, _HELD_BATCHES
        self.mixed = StructType.fromDDL("batch_id bigint, row_id bigint, vector array<float>").add("out", value_type)
        self.out = pa.struct(list(to_arrow_schema(value_type)))

    def done(self, number: int, parts: list) -> pa.RecordBatch:
        ids, matrix = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        codes = encode(matrix, "i8").astype(np.int8) if self.as_bytes else None
        batch = VectorBatch(number, ids, None if self.as_bytes else matrix, codes, matrix.shape[1], number * self.batch_size)
        row = dict(self.fn(batch))
        columns = [pa.array([number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([{f.name: row[f.name] for f in self.out}], self.out)], names=self.mixed.names)

    def rest(self, number: int, parts: list) -> pa.RecordBatch:
        ids, matrix = (np.concatenate(x) for x in zip(*parts))
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * matrix.shape[1])
        vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), pa.float32()))
        columns = [pa.array(np.full(len(ids), number)), pa.array(ids), vectors, pa.nulls(len(ids), self.out)]
        return pa.RecordBatch.from_arrays(columns, names=self.mixed.names)

    def here(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for number, *rows in _groups(batch):
                held.setdefault(number, []).append(rows)
                if sum(len(x) for x, _ in held[number]) == self.batch_size:
                    yield self.done(number, held.pop(number))
                if len(held) > self.held_most:
                    # What of it still comes can no longer make it whole, so it is sent on as well.
                    first = next(iter(held))
                    yield self.rest(first, held.pop(first))
        for number, parts in held.items():
            yield self.rest(number, parts)

    def shared(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            finished = batch.filter(pc.is_valid(batch.column("out")))
            if finished.num_rows:
                yield finished
            for number, *rows in _groups(batch.filter(pc.is_null(batch.column("out")))):
                if current is not None and number != current:
                    yield self.done(current, parts)
                    parts = []
                current = number
                parts.append(rows)
        if current is not None:
            yield self.done(current, parts)


# Incomplete batches that a task keeps.
_HELD_BATCHES = 64


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(batch_id, ids, vectors) of the runs of rows of one batch."""
    if batch.num_rows == 0:
        return
    numbers, ids = batch.column("batch_id").to_numpy(), batch.column("row_id").to_numpy()
    vectors = to_matrix(batch.column("vector"))
    order = np.argsort(numbers, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(numbers[order]) != 0))
    for rows in np.split(order, starts[1:]):
        yield int(numbers[rows[0]]), ids[rows], vectors[rows]


def vector_means(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, n, mean``: each task adds up its rows, only the sums are shuffled."""
    ship_package(df.sparkSession)
    narrow = df.filter(F.col(column).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<float>").alias("vector")
    )
    narrow = narrow.coalesce(parallelism(df.sparkSession))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, owner = np.unique(batch.column("key").to_numpy(), return_inverse=True)
            vectors = to_matrix(batch.column("vector")).astype(np.float64)
            order = np.argsort(owner, kind="stable")
            starts = np.searchsorted(owner[order], np.arange(len(keys)))
            added = np.add.reduceat(vectors[order], starts, axis=0)
            sizes = np.bincount(owner)
            for i, value in enumerate(keys.tolist()):
                sums[value] = sums[value] + added[i] if value in sums else added[i]
                counts[value] = counts.get(value, 0) + int(sizes[i])
        for value, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([value], pa.int64()),
                    pa.array([counts[value]], pa.int64()),
                    pa.array([total.tolist()], pa.list_(pa.float64())),
                ],
                names=["key", "n", "total"],
            )

    partials = narrow.mapInArrow(partial, "key bigint, n bigint, total array<double>")
    cells = partials.select("key", "n", F.posexplode("total").alias("i", "x"))
    sums = cells.groupBy("key", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("mean"))))
    means = sums.groupBy("key").agg(F.max("n").alias("n"), ordered.alias("cells"))
    return means.select(F.col("key").alias(key), "n", F.col("cells.mean").alias("mean"))


def observe_hits(hits: DataFrame, name: str = "hits") -> tuple[DataFrame, Observation]:
    """Count hits and track the largest distance while the search runs, without a second job."""
    observation = Observation(name)
    watched = hits.observe(
        observation,
        F.count(F.lit(1)).alias("n_hits"),
        F.max("rank").alias("max_rank"),
        F.max("distance").alias("max_distance"),
    )
    return watched, observation
