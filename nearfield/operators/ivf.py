"""Inverted-file index: a table of vectors laid out by nearest centroid.

Only the centroids (``nlist`` rows, size-checked) reach the driver.  A cell that
holds a large part of the data is written by many tasks as many files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from nearfield.functions.distance import check_metric
from nearfield.functions.quantize import stored_at
from nearfield.operators.kernel import BlockTopK, to_matrix
from nearfield.operators.knn import rank_hits, search
from nearfield.operators.pairing import paired_lists
from nearfield.session import BROADCAST_LIMIT, materialize, ship_package, spread_by

# Metric for putting a vector into a cell and for choosing the cells of a query.
# Inner product: cells follow L2, queries go to the centroids of largest product.
_ASSIGN = {"l2": "l2", "ip": "l2", "cos": "cos"}
_PROBE = {"l2": "l2", "ip": "ip", "cos": "cos"}
_MAX_CELLS = 1 << 20


def train_centroids(
    vectors: DataFrame, nlist: int, sample_rate: float = 1.0, iterations: int = 10, seed: int = 42
) -> DataFrame:
    """K-means centroids ``(cell_id, centroid)`` from all vectors, or from a share of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = vectors.filter(F.col("vector").isNotNull())
    points = usable.select(F.col("vector").cast("array<double>").alias("vector"))
    if sample_rate < 1.0:
        points = points.sample(sample_rate, seed=seed)
        if points.isEmpty():
            raise ValueError(f"no vector is in the sample; raise the sample rate of {sample_rate}")
    points = points.select(array_to_vector("vector").alias("features"))
    model = KMeans(k=nlist, maxIter=iterations, seed=seed).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell_id bigint, centroid array<float>")


class _Cells:
    """Centroids as broadcast to the tasks."""

    def __init__(self, centroids: DataFrame):
        cell, centroid = F.col("cell_id").cast("bigint"), F.col("centroid").cast("array<float>")
        table = centroids.select(cell.alias("cell_id"), centroid.alias("centroid")).limit(_MAX_CELLS + 1).toArrow()
        if not 0 < table.num_rows <= _MAX_CELLS:
            raise ValueError(f"the number of centroids must be from 1 to {_MAX_CELLS}")
        self.ids = table.column("cell_id").to_numpy()
        self.vectors = to_matrix(table.column("centroid"))
        if self.vectors.nbytes > 4 * BROADCAST_LIMIT:
            raise ValueError(f"centroids take {self.vectors.nbytes} bytes, more than one broadcast may hold")


def nearest_cells(df: DataFrame, centroids: DataFrame, count: int, metric: str, output: str) -> DataFrame:
    """Add ``output``: the ids of the ``count`` nearest centroids of ``vector``, nearest first."""
    ship_package(df.sparkSession)
    cells = _Cells(centroids)
    count = min(count, len(cells.ids))
    shared = df.sparkSession.sparkContext.broadcast(cells)
    schema = StructType([*df.schema.fields, StructField(output, ArrayType(LongType()))])
    position = df.columns.index("vector")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = to_matrix(batch.column(position), known.vectors.shape[1])
            nearest = BlockTopK(vectors, count, metric)
            nearest.offer(known.ids, known.vectors)
            row, cell, _ = nearest.lists()
            sizes = np.bincount(row, minlength=batch.num_rows)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, output])

    return df.mapInArrow(assign, schema)


def assign_cells(base: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """Add ``cell_id``, the nearest centroid (ties to the smaller id).

    A row without a vector, or whose vector has no distance to any centroid (a zero
    vector under cosine), gets a NULL cell.
    """
    usable = base.filter(F.col("vector").isNotNull()).withColumn("vector", F.col("vector").cast("array<float>"))
    found = nearest_cells(usable, centroids, 1, _ASSIGN[check_metric(metric)], "cells")
    found = found.withColumn("cell_id", F.get("cells", F.lit(0))).drop("cells")
    cell = found.schema["cell_id"].dataType
    missing = base.filter(F.col("vector").isNull()).withColumns({"vector": F.col("vector").cast("array<float>"), "cell_id": F.lit(None).cast(cell)})
    return found.unionByName(missing)


def write_index(assigned: DataFrame, path: str) -> None:
    """Store assigned vectors by cell; see :func:`spread_by`."""
    spread = spread_by(assigned, "cell_id")
    spread.sortWithinPartitions("cell_id", "row_id").write.mode("overwrite").partitionBy("cell_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    index = spark.read.parquet(path)
    return index.withColumn("cell_id", F.col("cell_id").cast("bigint"))


def build_ivf(base: DataFrame, centroids: DataFrame, path: str, metric: str = "l2", precision: str = "f32") -> DataFrame:
    """Assign, write and reopen the index table; cells follow the full vectors, storage the precision."""
    assigned = assign_cells(base.filter(F.col("vector").isNotNull()), centroids, metric)
    write_index(assigned.withColumn("vector", stored_at(F.col("vector"), precision)), path)
    return read_index(base.sparkSession, path)


def index_cells(index: DataFrame) -> DataFrame:
    """Cell sizes and id ranges of an index."""
    return index.groupBy("cell_id").agg(
        F.count("*").alias("n_vectors"), F.min("row_id").alias("min_id"), F.max("row_id").alias("max_id")
    )


def search_ivf(
    index: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int = 10,
    nprobe: int = 8,
    metric: str = "l2",
    precision: str | Sequence[str] = "f32",
    exclude_self: bool = False,
    *,
    shard_col: str | None = None,
    num_shards: int = 1,
    local: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Approximate top-K: every query looks only at its ``nprobe`` nearest cells.

    The cells probed by a broadcast block become a filter on the partition column, so
    unprobed cells are never read.  Inside a task a cell's rows meet only the
    queries that probe it.  Larger query sets are joined to the cells they probe.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    return search(
        index,
        asked,
        k,
        metric,
        [precision] if isinstance(precision, str) else list(precision),
        exclude_self=exclude_self,
        shard_col=shard_col,
        num_shards=num_shards,
        local=local,
        block_rows=block_rows,
        cells=_probed(centroids, nprobe, metric),
    )


def _probed(centroids: DataFrame, nprobe: int, metric: str) -> Callable[[DataFrame], DataFrame]:
    probe_metric = _PROBE[check_metric(metric)]
    return lambda asked: nearest_cells(asked, centroids, nprobe, probe_metric, "cells")


def sweep_ivf(
    index: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int,
    nprobes: Sequence[int],
    metric: str = "l2",
    precision: str = "f32",
    exclude_self: bool = False,
) -> DataFrame:
    """Hits of :func:`search_ivf` for several probe counts (column ``nprobe``) from one scan of the index.

    A query's list of a cell is the same for every count that reaches the cell, so each list
    carries the cell's place among the query's cells and counts for all larger settings.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).filter(F.col("vector").isNotNull())
    asked = materialize(_probed(centroids, max(nprobes), metric)(asked), "queries")
    rows = index.select("row_id", "vector", "cell_id", F.lit(0).cast("bigint").alias("shard_id"))
    lists = paired_lists(rows, asked, k + 1 if exclude_self else k, metric, [precision])
    settings = F.filter(F.array(*[F.lit(n) for n in sorted(set(nprobes))]), lambda n: n > F.col("probe"))
    pairs = F.arrays_zip(F.col("neighbors").alias("neighbor_id"), F.col("distances").alias("distance"))
    hits = lists.select("query_id", "probe", F.inline(pairs)).select("query_id", F.explode(settings).alias("nprobe"), "neighbor_id", "distance")
    if exclude_self:
        hits = hits.filter(F.col("query_id") != F.col("neighbor_id"))
    return rank_hits(hits, k, ("query_id", "nprobe"))


def sharded_ivf(
    index: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    k: int,
    nprobe: int,
    num_shards: int,
    metric: str = "l2",
    shard_col: str = "shard_id",
    precision: str = "f32",
) -> DataFrame:
    """Scatter-gather index search: every shard answers from its own part of the probed cells."""
    hits = search_ivf(index, centroids, queries, k, nprobe, metric, precision, shard_col=shard_col, num_shards=num_shards)
    return hits.drop("shard_id")
