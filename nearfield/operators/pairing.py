"""Search where the base and the queries are both tables of any size.

Every query names the cells it wants to see (an index search: its nearest ones; an exact search:
the only cell there is).  Cells are cut into parts and the queries of a cell into rounds, both of bounded size;
part and round meet in one group of a co-grouped equi-join, where blocks of the round's queries are held
against the part one after the other.  A cell with a large part of the base or of the queries becomes many groups.
Each base row is read once and moves once per round of its cell; cells that no query names do not move.
Parts are as large as a task may hold and rounds as few as keep all slots at work, so rows move a fixed number of
times until rounds reach their bound.  No query passes through the driver.

Where queries name a good share of all cells (``cells_together``), the parts are cut from all cells at once and a
group looks up which of its queries want which cell: a query then gets one list per part, not one per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.quantize import encode
from nearfield.operators.kernel import BlockTopK, tiles, to_matrix
from nearfield.session import BROADCAST_LIMIT, STATE_LIMIT, materialize, ship_package, slots

# Base rows of a part where rows are only put into cells.
PART_ROWS = 1 << 14
# Queries of a round at most, and as many as are held against a part at a time.
ROUND_ROWS = 1 << 15
BLOCK_ROWS = 512
# Groups for each slot, so that they can be dealt evenly.
_GROUPS_A_SLOT = 3

LISTS = "query_id bigint, probe int, precision string, shard_id bigint, neighbors array<bigint>, distances array<double>"


def round_rows(dims: int, k: int) -> int:
    """Queries of a round whose vectors and lists fit into a task."""
    return max(1, min(ROUND_ROWS, BROADCAST_LIMIT // max(1, 4 * dims), STATE_LIMIT // (32 * k)))


def part_rows_of(dims: int) -> int:
    """Base rows of a part whose vectors fit into a task."""
    return max(1, BROADCAST_LIMIT // max(1, 4 * dims))


def grid(base: DataFrame, asked: DataFrame, part_rows: int, rounds_of: int) -> DataFrame:
    """(cell_id, shard_id, parts, rounds) of every cell that is asked for and holds rows.

    A cell gets as many rounds as its share of all pairs deserves of the groups that keep the slots at work.
    """
    cells = base.groupBy("cell_id", "shard_id").agg(F.count("*").alias("n"))
    wanted = asked.groupBy("cell_id").agg(F.count("*").alias("asked"))
    sizes = materialize(cells.join(wanted, "cell_id"), "cells")
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("asked"))).first()[0] or 1.0
    parts = F.ceil(F.col("n") / part_rows)
    share = F.col("n") * F.col("asked") / total * (_GROUPS_A_SLOT * slots(base.sparkSession)) / parts
    rounds = F.greatest(F.ceil(F.col("asked") / rounds_of), F.least(F.ceil(share), F.ceil(F.col("asked") / BLOCK_ROWS)))
    return sizes.select("cell_id", "shard_id", parts.alias("parts"), rounds.alias("rounds"))


def _members(cells: pa.ChunkedArray, wanted: np.ndarray) -> list[np.ndarray]:
    """The positions of the queries whose list holds each of the ``wanted`` (sorted) cells."""
    lists = cells.combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().to_numpy()
    place = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
    known = np.flatnonzero(wanted[place] == flat)
    known = known[np.argsort(place[known], kind="stable")]
    return np.split(owner[known], np.searchsorted(place[known], np.arange(1, len(wanted))))


def _answer(k: int, metric: str, precisions: Sequence[str], block_rows: int):
    names = ["query_id", "probe", "precision", "shard_id", "neighbors", "distances"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def answer(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if rows.num_rows and asked.num_rows:
            shard, together = rows.column("shard_id")[0].as_py(), "cells" in asked.column_names
            if together:
                rows = rows.sort_by("own_cell")
                wanted, starts = np.unique(rows.column("own_cell").to_numpy(), return_index=True)
            else:
                wanted, starts = None, np.zeros(1, np.int64)
            ends = np.append(starts[1:], rows.num_rows)
            ids, queries = rows.column("row_id").to_numpy(), to_matrix(asked.column("vector"))
            vectors = to_matrix(rows.column("vector"), queries.shape[1])
            coded = pa.types.is_integer(rows.schema.field("vector").type.value_type)
            coded_queries = pa.types.is_integer(asked.schema.field("vector").type.value_type)
            for precision in precisions:
                held = vectors if coded else encode(vectors, precision)
                cut = [list(tiles(ids[a:b], held[a:b])) for a, b in zip(starts, ends)]
                for first in range(0, asked.num_rows, block_rows):
                    some = asked.slice(first, block_rows)
                    block = queries[first : first + block_rows]
                    best = BlockTopK(block if coded_queries else encode(block, precision), k, metric, precision == "i8")
                    members = _members(some.column("cells"), wanted) if together else [None]
                    for own, cell in zip(members, cut):
                        for tile in cell if own is None or len(own) else ():
                            best.offer_tile(tile, own)
                    found.append(_listed(best, some, precision, shard))
        return pa.concat_tables(found) if found else pa.table([pa.array([], kind) for kind in kinds], names)

    def _listed(best: BlockTopK, asked: pa.Table, precision: str, shard: int) -> pa.Table:
        position, neighbors, distances = best.lists()
        some, starts = np.unique(position, return_index=True)
        offsets = pa.array(np.append(starts, len(position)).astype(np.int32))
        columns = [
            asked.column("query_id").take(pa.array(some)).combine_chunks(),
            asked.column("probe").take(pa.array(some)).combine_chunks(),
            pa.array([precision] * len(some), pa.string()),
            pa.array([shard] * len(some), pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(neighbors)),
            pa.ListArray.from_arrays(offsets, pa.array(distances)),
        ]
        return pa.Table.from_arrays(columns, names)

    return answer


def paired_lists(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    precisions: Sequence[str],
    part_rows: int | None = None,
    rounds_of: int | None = None,
    *,
    block_rows: int = BLOCK_ROWS,
    cells_together: bool = False,
) -> DataFrame:
    """One list of at most K per query, cell part and precision; ``probe`` is the cell's place among the query's cells.

    ``base``: ``row_id, vector, cell_id, shard_id``; ``queries``: ``query_id, vector, cells``.
    ``part_rows`` and ``rounds_of`` bound a group; by default memory does.  ``block_rows`` of a round's queries
    are held against a part at a time.  With ``cells_together`` a list is of all cells in a part, and ``probe`` is 0.
    """
    ship_package(base.sparkSession)
    if part_rows is None or rounds_of is None:
        dims = queries.agg(F.max(F.size("vector"))).first()[0] or 0
        part_rows, rounds_of = part_rows or part_rows_of(dims), rounds_of or round_rows(dims, k * len(precisions))
    own = []
    if cells_together:
        own = ["own_cell"]
        # One cell for all; not a literal, which would leave the join without a key.
        base = base.withColumn("own_cell", F.col("cell_id")).withColumn("cell_id", F.pmod("row_id", F.lit(1).cast("bigint")))
        asked = queries.select("query_id", "vector", F.lit(0).alias("probe"), F.pmod("query_id", F.lit(1).cast("bigint")).alias("cell_id"), "cells")
    else:
        asked = queries.select("query_id", "vector", F.posexplode("cells").alias("probe", "cell_id"))
    # A base of one cell and shard is still cut; both sides need only the sizes to agree on the groups.
    sizes = materialize(grid(base, asked, part_rows, rounds_of), "sizes")
    keys = ["cell_id", "shard_id", "part", "round"]
    rows = (
        base.join(sizes, ["cell_id", "shard_id"])
        .withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")))
        .select("row_id", "vector", *own, "cell_id", "shard_id", "part", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"))
    )
    asked = (
        asked.join(sizes, "cell_id")
        .withColumn("round", F.pmod(F.xxhash64("query_id"), F.col("rounds")))
        .select("query_id", "vector", *(["cells"] if own else []), "probe", *keys[:2], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "round")
    )
    # Groups are few and take long: each in a partition of its own, which adaptive execution does not join to others.
    groups = sizes.agg(F.sum(F.col("parts") * F.col("rounds"))).first()[0] or 1
    n = max(slots(base.sparkSession), min(4 * groups, 4 * _GROUPS_A_SLOT * slots(base.sparkSession)))
    grouped = rows.repartition(n, *keys).groupBy(*keys).cogroup(asked.repartition(n, *keys).groupBy(*keys))
    return grouped.applyInArrow(_answer(k, metric, precisions, block_rows), LISTS)
