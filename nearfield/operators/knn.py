"""Top-K similarity search as Spark jobs.

Shape of a search: queries that fit into one bounded block are broadcast, base
partitions stream past them inside ``mapInArrow`` keeping a running top-K, and
only one K-long list per task and query is shuffled by query id and ranked with
``row_number``; the base table is not shuffled then.  A larger query set stays
a table and meets the base in groups of bounded size, see :mod:`pairing`; their many
lists are merged as Arrow arrays, so that no pair passes a sort of rows.

Hit lists: ``query_id, neighbor_id, distance, rank`` (1-based; ties to the
smaller id), plus ``precision`` / shard columns where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearfield.functions.distance import check_metric, distance
from nearfield.functions.quantize import check_precision, encode
from nearfield.operators.bitmap import only_listed
from nearfield.operators.kernel import BlockTopK, sorted_by, to_matrix
from nearfield.operators.pairing import BLOCK_ROWS, paired_lists
from nearfield.session import (
    BROADCAST_LIMIT,
    STATE_LIMIT,
    materialize,
    parallelism,
    ship_package,
)

_EMIT_ROWS = 1 << 16
# Pairs of lists that a task merges at a time.
_MERGED_PAIRS = 1 << 19
# Queries that are broadcast at most: every task keeps the lists of them all.
_BROADCAST_ROWS = 1 << 14
# From this share of the index rows that a query looks at on average, its lists come from parts of all cells.
_TOGETHER_SHARE = 1 / 8
# With more tasks than this the lists are merged in two steps.
_SALT_ABOVE = 1024


def rank_hits(hits: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Keep the K best rows per ``by`` and number them from 1."""
    window = Window.partitionBy(*by).orderBy("distance", "neighbor_id")
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def merge_topk(hits: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Global top-K of hit lists that were ranked apart (per shard, task or part)."""
    return rank_hits(hits.drop("rank"), k, by)


def merge_parts(parts: Iterable[DataFrame], k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Global top-K over separately stored hit lists."""
    merged = None
    for part in parts:
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("no hit lists to merge")
    return merge_topk(merged, k, by)


def truncate_at_k(hits: DataFrame, k: int) -> DataFrame:
    return hits.filter(F.col("rank") <= k)


def merged_lists(lists: DataFrame, k: int, by: Sequence[str], exclude_self: bool = False) -> DataFrame:
    """The K best pairs per ``by`` of ``query_id, ..., neighbors, distances``, one row each, numbered from 1.

    ``by`` starts with ``query_id``.  The lists are shuffled and sorted whole; a task merges those of some queries at a time.
    """
    ship_package(lists.sparkSession)
    names = [c for c in lists.columns if c not in ("neighbors", "distances")]
    schema = StructType([*(lists.schema[c] for c in names), *StructType.fromDDL("neighbor_id bigint, distance double, rank int").fields])

    def ranked(part: pa.RecordBatch) -> pa.RecordBatch:
        asked, listed = part.column("query_id").to_numpy(), part.column("neighbors")
        changes = np.zeros(part.num_rows, bool)
        for name in by:
            values = part.column(name).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
        owner = np.repeat(np.arange(part.num_rows), np.diff(listed.offsets.to_numpy()))
        ids, distances = listed.flatten().to_numpy(), part.column("distances").flatten().to_numpy()
        if exclude_self:
            others = np.flatnonzero(ids != asked[owner])
            owner, ids, distances = owner[others], ids[others], distances[others]
        group = np.cumsum(changes)
        order = sorted_by(group[owner], distances, ids, part.num_rows)
        sizes = np.bincount(group[owner], minlength=1)
        rank = np.arange(1, len(order) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order, rank = order[rank <= k], rank[rank <= k]
        rows = pa.array(owner[order])
        columns = [*(part.column(c).take(rows) for c in names), pa.array(ids[order]), pa.array(distances[order]), pa.array(rank.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                table = pa.Table.from_batches([*held, batch.slice(start, step)])
                (whole,) = table.combine_chunks().to_batches()
                asked = whole.column("query_id").to_numpy()
                # The last query may have more lists.
                last = int(np.searchsorted(asked, asked[-1]))
                if last:
                    yield ranked(whole.slice(0, last))
                held = [whole.slice(last)]
        if held:
            yield ranked(held[0])

    step = max(1, _MERGED_PAIRS // k)
    return lists.repartition("query_id").sortWithinPartitions(*by).mapInArrow(merge, schema)


class QueryBlock:
    """One bounded set of queries as it is broadcast to the tasks."""

    def __init__(self, table: pa.Table, precisions: Sequence[str]):
        coded = pa.types.is_integer(table.column("vector").type.value_type)
        self.ids = table.column("query_id").to_numpy()
        vectors = to_matrix(table.column("vector"))
        self.dims = vectors.shape[1]
        self.vectors = {p: vectors if coded else encode(vectors, p) for p in precisions}
        self.members: dict[int, np.ndarray] | None = None
        if "cells" in table.column_names:
            cells = table.column("cells").combine_chunks()
            owner = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten().to_numpy()
            order = np.argsort(flat, kind="stable")
            keys, starts = np.unique(flat[order], return_index=True)
            self.members = dict(zip(keys.tolist(), np.split(owner[order], starts[1:])))


def _block_rows(dims: int, k: int, states: int) -> int:
    by_vector = BROADCAST_LIMIT // max(1, 4 * dims)
    by_state = STATE_LIMIT // (32 * k * states)
    return max(1, min(by_vector, by_state, _BROADCAST_ROWS))


def _max_states(n_queries: int, k: int, precisions: int) -> int:
    """Running lists (one per precision and shard) a task may hold at a time."""
    return max(precisions, STATE_LIMIT // (32 * k * max(1, n_queries)))


def _one_block(
    queries: DataFrame, cells: Callable | None, k: int, states: int, block_rows: int | None
) -> pa.Table | None:
    """The query set as an Arrow table if it fits into one block."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    dims = size["dims"] or 0
    if size["n"] > (block_rows or _block_rows(dims, k, states)):
        return None
    table = (cells(queries) if cells else queries).toArrow()
    if len(np.unique(table.column("query_id").to_numpy())) < table.num_rows:
        raise ValueError("query ids must be unique")
    return table


def _search_block(
    base: DataFrame,
    block: QueryBlock,
    k: int,
    metric: str,
    precisions: Sequence[str],
    shard_col: str | None,
    num_shards: int,
) -> DataFrame:
    """Per-task top-K of one query block, one row with both lists per query and state."""
    spark = base.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(block)
    schema = "query_id bigint, precision string, shard_id bigint, neighbors array<bigint>, distances array<double>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        states: dict[tuple[str, int], BlockTopK] = {}
        most = _max_states(len(queries.ids), k, len(precisions))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("row_id").to_numpy()
            column = batch.column("vector")
            coded = pa.types.is_integer(column.type.value_type)
            vectors = to_matrix(column, queries.dims)
            shards = batch.column("shard_id").to_numpy() if shard_col else np.zeros(len(ids), dtype=np.int64)
            cells = batch.column("cell_id").to_numpy() if queries.members is not None else None
            for precision in precisions:
                encoded = vectors if coded else encode(vectors, precision)
                for shard in np.unique(shards).tolist():
                    key = (precision, shard)
                    if key not in states:
                        if len(states) >= most:
                            # Rows come sorted by shard then, so the oldest state is complete or nearly so.
                            oldest = next(iter(states))
                            yield from emit(oldest, states.pop(oldest))
                        states[key] = BlockTopK(queries.vectors[precision], k, metric, precision == "i8")
                    rows = np.flatnonzero(shards == shard) if shard_col else None
                    _offer(states[key], ids, encoded, rows, cells, queries.members)
        for key, state in states.items():
            yield from emit(key, state)

    def emit(key: tuple[str, int], state: BlockTopK) -> Iterator[pa.RecordBatch]:
        position, neighbors, distances = state.lists()
        asked, starts = np.unique(position, return_index=True)
        starts = np.append(starts, len(position))
        step = max(1, _EMIT_ROWS // k)
        for first in range(0, len(asked), step):
            last = min(first + step, len(asked))
            rows = slice(starts[first], starts[last])
            offsets = pa.array((starts[first : last + 1] - starts[first]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shared.value.ids[asked[first:last]]),
                    pa.array([key[0]] * (last - first), pa.string()),
                    pa.array(np.full(last - first, key[1], dtype=np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(neighbors[rows])),
                    pa.ListArray.from_arrays(offsets, pa.array(distances[rows])),
                ],
                names=["query_id", "precision", "shard_id", "neighbors", "distances"],
            )

    if shard_col and num_shards * len(precisions) > _max_states(len(block.ids), k, len(precisions)):
        base = base.sortWithinPartitions("shard_id")
    return base.mapInArrow(search, schema)


def _offer(state, ids, vectors, rows, cells, members) -> None:
    if rows is not None:
        ids, vectors = ids[rows], vectors[rows]
        cells = cells[rows] if cells is not None else None
    if cells is None:
        state.offer(ids, vectors)
        return
    order = np.argsort(cells, kind="stable")
    keys, starts = np.unique(cells[order], return_index=True)
    for cell, group in zip(keys.tolist(), np.split(order, starts[1:])):
        if cell in members:
            state.offer(ids[group], vectors[group], members[cell])


def search(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    precisions: Sequence[str] = ("f32",),
    *,
    exclude_self: bool = False,
    shard_col: str | None = None,
    num_shards: int = 1,
    local: bool = False,
    block_rows: int | None = None,
    cells: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Top-K of every query; see the module text for the plan.

    ``base``: ``row_id, vector`` (plus ``cell_id`` with ``cells``, plus ``shard_col``).
    ``queries``: ``query_id, vector``; ``cells`` adds to them the array ``cells`` of
    those that each query looks at, nearest first.
    Vectors of type ``array<tinyint>`` are int8 codes and need precision i8; all
    others are brought to the precision here.  ``local=True`` returns the K best per (query, shard) instead of merging.
    ``block_rows`` bounds the queries that are broadcast, or held against a part of the base at a time; by default memory does.
    Repeated query ids raise.
    """
    metric = check_metric(metric)
    precisions = [check_precision(p) for p in precisions]
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    spark = base.sparkSession
    wide = k + 1 if exclude_self else k
    narrow = [F.col("row_id").cast("bigint").alias("row_id"), _searchable(base, precisions)]
    if cells:
        narrow.append(F.col("cell_id").cast("bigint").alias("cell_id"))
    if shard_col:
        narrow.append(F.col(shard_col).cast("bigint").alias("shard_id"))
    slots = parallelism(spark)
    queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), _searchable(queries, precisions))
    queries = queries.filter(F.col("vector").isNotNull())
    by = ["query_id"] + (["precision"] if len(precisions) > 1 else []) + (["shard_id"] if local else [])

    def unpacked(lists: DataFrame) -> DataFrame:
        pairs = F.arrays_zip(F.col("neighbors").alias("neighbor_id"), F.col("distances").alias("distance"))
        hits = lists.select(*[c for c in lists.columns if c not in ("neighbors", "distances")], F.inline(pairs))
        return hits.filter(F.col("query_id") != F.col("neighbor_id")) if exclude_self else hits

    def ranked(lists: DataFrame) -> DataFrame:
        # The lists are shuffled whole and unpacked behind the exchange.
        if slots > _SALT_ABOVE:
            # Many tasks answer each query: thin the lists in groups of tasks first.
            salted = lists.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(slots))))
            hits = rank_hits(unpacked(salted.repartition("query_id", "salt")), k, [*by, "salt"]).drop("rank", "salt")
        else:
            hits = unpacked(lists.repartition("query_id"))
        return plain(rank_hits(hits, k, by))

    def plain(result: DataFrame) -> DataFrame:
        if shard_col is None:
            result = result.drop("shard_id")
        return result if len(precisions) > 1 else result.drop("precision")

    rows = base.select(*narrow).filter(F.col("vector").isNotNull())
    table = _one_block(queries, cells, wide, len(precisions), block_rows)
    if table is None:
        # One cell for all; not a literal, which would leave the join without a key.
        zero = lambda name: F.pmod(F.col(name), F.lit(1).cast("bigint"))
        asked = materialize(cells(queries) if cells else queries.withColumn("cells", F.array(zero("query_id"))), "queries")
        if not asked.groupBy("query_id").count().filter("count > 1").isEmpty():
            raise ValueError("query ids must be unique")
        missing = {name: zero("row_id") for name in ("cell_id", "shard_id") if name not in rows.columns}
        rows = rows.withColumns(missing)
        options = {"block_rows": min(BLOCK_ROWS, block_rows or BLOCK_ROWS), "cells_together": bool(cells) and _wide(rows, asked)}
        lists = paired_lists(rows, asked, wide, metric, precisions, **options).drop("probe")
        if slots > _SALT_ABOVE:
            return ranked(lists)
        return plain(merged_lists(lists, k, by, exclude_self))
    block = QueryBlock(table, precisions) if table.num_rows else _EmptyBlock(precisions)
    if not table.num_rows:
        rows = rows.limit(0)
    elif block.members is not None:
        # As text: tens of thousands of cells would be slow as separate literals.
        rows = rows.filter(F.expr(f"cell_id IN ({', '.join(map(str, sorted(block.members)))})"))
    # Few long tasks: fewer partial lists to merge.
    return ranked(_search_block(rows.coalesce(slots), block, wide, metric, precisions, shard_col, num_shards))


def _wide(rows: DataFrame, asked: DataFrame) -> bool:
    """Whether the queries want a good share of the index rows on average."""
    sizes = rows.groupBy("cell_id").agg(F.count("*").alias("n"))
    wanted = asked.select(F.explode("cells").alias("cell_id")).groupBy("cell_id").agg(F.count("*").alias("asked"))
    found = sizes.join(wanted, "cell_id", "left").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("asked")).alias("pairs")).first()
    return (found["pairs"] or 0.0) >= _TOGETHER_SHARE * (found["n"] or 0) * asked.count()


def _searchable(df: DataFrame, precisions: Sequence[str]) -> Column:
    codes = df.schema["vector"].dataType.simpleString() == "array<tinyint>"
    if codes and list(precisions) != ["i8"]:
        raise ValueError(f"int8 codes can only be searched at precision i8, not {', '.join(precisions)}")
    return F.col("vector") if codes else F.col("vector").cast("array<float>").alias("vector")


class _EmptyBlock(QueryBlock):
    def __init__(self, precisions: Sequence[str]):
        self.ids, self.dims, self.members = np.empty(0, np.int64), 0, None
        self.vectors = {p: np.empty((0, 0), np.float32) for p in precisions}


def exact_knn(
    base: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "l2",
    precision: str = "f32",
    exclude_self: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Exact top-K of every query over the whole base table."""
    return search(base, queries, k, metric, [precision], exclude_self=exclude_self, block_rows=block_rows)


def precision_knn(
    base: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "l2",
    precisions: Sequence[str] = ("f32", "f16", "bf16", "i8"),
    exclude_self: bool = False,
) -> DataFrame:
    """Exact top-K at several precisions from one scan of the base table."""
    hits = search(base, queries, k, metric, precisions, exclude_self=exclude_self)
    return hits if "precision" in hits.columns else hits.withColumn("precision", F.lit(precisions[0]))


def shard_local_topk(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    num_shards: int,
    metric: str = "l2",
    shard_col: str = "shard_id",
    precision: str = "f32",
) -> DataFrame:
    """Top-K of every query inside every shard, all queries in one job."""
    return search(base, queries, k, metric, [precision], shard_col=shard_col, num_shards=num_shards, local=True)


def sharded_knn(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    num_shards: int,
    metric: str = "l2",
    shard_col: str = "shard_id",
    precision: str = "f32",
) -> DataFrame:
    """Scatter-gather search: the lists of all shards merged by true distance."""
    return search(base, queries, k, metric, [precision], shard_col=shard_col, num_shards=num_shards).drop("shard_id")


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Re-score candidate pairs on full vectors and keep the K best.

    The base table is cut to the candidates in place; only what is left of it may be shuffled.
    """
    pairs = materialize(candidates.select("query_id", "neighbor_id"), "candidates")
    vectors = base.select(F.col("row_id").alias("neighbor_id"), F.col("vector").alias("neighbor_vector"))
    asked = queries.select("query_id", F.col("vector").alias("query_vector"))
    scored = (
        only_listed(vectors, "neighbor_id", pairs.select("neighbor_id"))
        .join(pairs, "neighbor_id")
        .join(asked, "query_id")
        .select(
            "query_id",
            "neighbor_id",
            distance(metric, F.col("query_vector"), F.col("neighbor_vector")).alias("distance"),
        )
    )
    return rank_hits(scored, k)


def quantized_knn(
    base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", oversample: int = 4, precision: str = "i8"
) -> DataFrame:
    """Candidates from the quantized vectors, final order from the full ones."""
    return rerank(search(base, queries, k * oversample, metric, [precision]), base, queries, k, metric)


def with_payload(hits: DataFrame, base: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fetch wide columns only for the rows that survived the top-K.

    The base table is cut to the hits in place; only what is left of it may be shuffled.
    """
    hits = materialize(hits, "hits")
    payload = base.select(F.col("row_id").alias("neighbor_id"), *columns)
    return hits.join(only_listed(payload, "neighbor_id", hits.select("neighbor_id")), "neighbor_id")


def map_external_ids(hits: DataFrame, id_map: DataFrame) -> DataFrame:
    """Positions to external ids, keeping the position where none is known.

    ``id_map`` may be as long as the base table; it is cut down to the
    positions that occur in the hits before it meets the hit list.
    """
    hits = materialize(hits, "hits")
    known = only_listed(id_map.select("row_id", "external_id"), "row_id", hits.select("neighbor_id"))
    known = known.select(F.col("row_id").alias("neighbor_id"), "external_id")
    return (
        hits.join(known, "neighbor_id", "left")
        .withColumn("neighbor_id", F.coalesce("external_id", "neighbor_id"))
        .drop("external_id")
    )


def checked_int_ids(hits: DataFrame) -> DataFrame:
    """Ids as INT; a value outside the int range raises (ANSI cast)."""
    top, bottom = 2**31 - 1, -(2**31)

    def narrow(name: str):
        ok = F.col(name).between(bottom, top)
        message = F.concat(F.lit(f"{name} out of int range: "), F.col(name).cast("string"))
        return F.when(ok, F.col(name).try_cast("int")).otherwise(F.raise_error(message).cast("int"))

    return hits.withColumn("query_id", narrow("query_id")).withColumn("neighbor_id", narrow("neighbor_id"))
