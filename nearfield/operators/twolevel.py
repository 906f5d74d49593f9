"""Inverted file with two levels of cells, for more cells than one broadcast holds.

Only the coarse centroids are broadcast.  A vector meets the fine centroids of its coarse cell in a
co-grouped join, cut into parts of bounded size where a coarse cell is large.  The index is one
table in the order of its cells, spread over files by ranges, so its number of cells is not
tied to folders; a small table tells which files hold a cell, and a search opens no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from nearfield.functions.distance import check_metric
from nearfield.functions.quantize import stored_at
from nearfield.operators.ivf import _ASSIGN, _PROBE, nearest_cells, train_centroids
from nearfield.operators.kernel import BlockTopK, to_matrix
from nearfield.operators.knn import merge_topk
from nearfield.operators.pairing import PART_ROWS, paired_lists
from nearfield.session import materialize, ship_package

_FINE = "coarse_id bigint, cell_id bigint, centroid array<float>"


def lloyd(points: np.ndarray, count: int, iterations: int) -> np.ndarray:
    """K-means of a small matrix from evenly spaced rows; cells that run empty are left out."""
    centres = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)].astype(np.float64)
    for _ in range(iterations):
        gaps = (centres**2).sum(axis=1)[None, :] - 2.0 * points @ centres.T
        owner = gaps.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        sizes = np.bincount(owner, minlength=len(centres))
        centres = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return centres


def train_two_level(
    vectors: DataFrame, coarse: int, fine: int, sample_rows: int = 4096, iterations: int = 10, metric: str = "l2", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(coarse centroids, fine centroids): up to ``fine`` cells in each of ``coarse``.

    Fine cells are trained on at most ``sample_rows`` vectors of each coarse cell, those of smallest hash.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    top = materialize(train_centroids(vectors, coarse, iterations=iterations, seed=seed), "coarse")
    rows = _with_coarse(vectors.filter(F.col("vector").isNotNull()).select("row_id", F.col("vector").cast("array<float>").alias("vector")), top, metric)
    order = Window.partitionBy("coarse_id").orderBy(F.xxhash64("row_id"), "row_id")
    sample = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_rows)

    def train(key: tuple, table: pa.Table) -> pa.Table:
        points = to_matrix(table.sort_by("place").column("vector")).astype(np.float64)
        centres = lloyd(points, fine, iterations).astype(np.float32)
        parent = key[0].as_py()
        return pa.table({
            "coarse_id": pa.array([parent] * len(centres), pa.int64()),
            "cell_id": pa.array([parent * fine + i for i in range(len(centres))], pa.int64()),
            "centroid": pa.array(list(centres), pa.list_(pa.float32())),
        })

    return top, materialize(sample.filter(F.col("coarse_id").isNotNull()).groupBy("coarse_id").applyInArrow(train, _FINE), "fine")


def _with_coarse(rows: DataFrame, coarse: DataFrame, metric: str) -> DataFrame:
    found = nearest_cells(rows, coarse, 1, _ASSIGN[check_metric(metric)], "_coarse")
    return found.withColumn("coarse_id", F.get("_coarse", F.lit(0))).drop("_coarse")


def assign_two_level(base: DataFrame, coarse: DataFrame, fine: DataFrame, metric: str = "l2", part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``coarse_id`` and ``cell_id``, the nearest fine cell of the nearest coarse cell; vectors move once.

    A row without a vector, or without a distance to any centroid, gets NULL cells.
    """
    ship_package(base.sparkSession)
    near = _ASSIGN[check_metric(metric)]
    rows = base.withColumn("vector", F.col("vector").cast("array<float>"))
    coarse_of = _with_coarse(rows.filter(F.col("vector").isNotNull()), coarse, metric)
    # Only the cells' sizes are needed to cut both sides alike.
    parts = materialize(
        coarse_of.groupBy("coarse_id").agg(F.ceil(F.count("*") / part_rows).alias("parts")).join(fine.select("coarse_id").distinct(), "coarse_id"), "parts"
    )
    cut = coarse_of.join(F.broadcast(parts), "coarse_id").withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts"))).drop("parts")
    lists = fine.join(F.broadcast(parts), "coarse_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = StructType([*rows.schema.fields, StructField("coarse_id", LongType()), StructField("cell_id", LongType())])
    names = [*rows.columns, "coarse_id"]

    def assign(table: pa.Table, cells: pa.Table) -> pa.Table:
        centres = to_matrix(cells.column("centroid")) if cells.num_rows else None
        found = np.full(table.num_rows, -1)
        if centres is not None and table.num_rows:
            best = BlockTopK(to_matrix(table.column("vector"), centres.shape[1]), 1, near)
            best.offer(cells.column("cell_id").to_numpy(), centres)
            row, cell, _ = best.lists()
            found[row] = cell
        return table.select(names).append_column("cell_id", pa.array(found, mask=found < 0))

    found = cut.groupBy("coarse_id", "part").cogroup(lists.groupBy("coarse_id", "part")).applyInArrow(assign, schema)
    empty = F.lit(None).cast("bigint")
    rest = coarse_of.filter(F.col("coarse_id").isNull()).unionByName(rows.filter(F.col("vector").isNull()).withColumn("coarse_id", empty))
    return found.unionByName(rest.withColumn("cell_id", empty))


def write_two_level(assigned: DataFrame, path: str) -> None:
    """Store rows in the order of their cells, and which files hold each cell."""
    ranged = assigned.filter(F.col("cell_id").isNotNull()).repartitionByRange("cell_id", "row_id").sortWithinPartitions("cell_id", "row_id")
    ranged.write.mode("overwrite").parquet(f"{path}/rows")
    stored = assigned.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    located = stored.groupBy("cell_id", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    located.write.mode("overwrite").parquet(f"{path}/cells")


def build_two_level(base: DataFrame, coarse: DataFrame, fine: DataFrame, path: str, metric: str = "l2", precision: str = "f32") -> str:
    """Assign and write the index; cells follow the full vectors, storage the precision."""
    assigned = assign_two_level(base.filter(F.col("vector").isNotNull()), coarse, fine, metric)
    write_two_level(assigned.withColumn("vector", stored_at(F.col("vector"), precision)), path)
    return path


def probed_cells(queries: DataFrame, coarse: DataFrame, fine: DataFrame, coarse_probe: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """Queries with ``cells``: the ``nprobe`` nearest fine cells of their ``coarse_probe`` nearest coarse ones."""
    near = _PROBE[check_metric(metric)]
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).filter(F.col("vector").isNotNull())
    asked = materialize(nearest_cells(asked, coarse, coarse_probe, near, "cells"), "queries")
    centres = fine.select(F.col("cell_id").alias("row_id"), F.col("centroid").alias("vector"), F.col("coarse_id").alias("cell_id"), F.lit(0).cast("bigint").alias("shard_id"))
    pairs = F.arrays_zip(F.col("neighbors").alias("neighbor_id"), F.col("distances").alias("distance"))
    hits = merge_topk(paired_lists(centres, asked, nprobe, near, ["f32"]).select("query_id", F.inline(pairs)), nprobe)
    cells = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbor_id"))), lambda x: x["neighbor_id"]).alias("cells"))
    return asked.drop("cells").join(cells, "query_id")


def rows_of_cells(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """The index rows in the files that hold any of ``cells`` (column ``cell_id``)."""
    located = spark.read.parquet(f"{path}/cells")
    files = [r["file"] for r in located.join(cells, "cell_id", "left_semi").select("file").distinct().collect()]
    whole = spark.read.parquet(f"{path}/rows")
    return spark.read.schema(whole.schema).parquet(*sorted(files)) if files else whole.limit(0)


def search_two_level(
    path: str,
    coarse: DataFrame,
    fine: DataFrame,
    queries: DataFrame,
    k: int = 10,
    coarse_probe: int = 4,
    nprobe: int = 16,
    metric: str = "l2",
    precision: str = "f32",
    exclude_self: bool = False,
) -> DataFrame:
    """Approximate top-K over the index at ``path``; queries stay a table, see :mod:`pairing`."""
    spark = queries.sparkSession
    asked = materialize(probed_cells(queries, coarse, fine, coarse_probe, nprobe, metric), "queries")
    index = rows_of_cells(spark, path, asked.select(F.explode("cells").alias("cell_id")).distinct())
    rows = index.select("row_id", "vector", "cell_id", F.lit(0).cast("bigint").alias("shard_id"))
    lists = paired_lists(rows, asked, k + 1 if exclude_self else k, metric, [precision])
    pairs = F.arrays_zip(F.col("neighbors").alias("neighbor_id"), F.col("distances").alias("distance"))
    hits = lists.select("query_id", F.inline(pairs))
    return merge_topk(hits.filter(F.col("query_id") != F.col("neighbor_id")) if exclude_self else hits, k)
