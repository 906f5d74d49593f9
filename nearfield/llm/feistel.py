"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Row numbers 0 .. n-1 are mixed as pairs (left, right) of a grid of ``a * b``
cells, a the rounded-up root of n: alternating rounds add a keyed hash of
one half to the other, which is a bijection of the grid.  Numbers that fall outside
0 .. n-1 walk on along their cycle until they are inside.  Shard and slot are
remainder and quotient of the permuted number, so anyone can compute them from
(row number, n, seed) alone, and shard sizes are at most one apart.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from nearfield.session import materialize

ROUNDS = 6
STEPS = 4


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The place of row ``number`` (0 <= number < n) in a shuffle of n rows."""
    if n <= 1:
        return number
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def mix(half: Column, i: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), i, half), F.lit(size))

    def once(x: Column) -> Column:
        left = F.call_function("div", x, F.lit(b))
        start = F.struct(left.cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
        turn = lambda s, i: F.when(
            i % 2 == 0, F.struct(F.pmod(s["l"] + mix(s["r"], i, a), F.lit(a)).cast("bigint").alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + mix(s["l"], i, b), F.lit(b)).cast("bigint").alias("r")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])

    def walk(x: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))

    # A cycle holds at most a*b - n numbers outside, so that many steps always end inside;
    # the long walk is evaluated only for the few that four steps leave outside.
    y = walk(once(number), STEPS)
    outside = a * b - n
    return y if outside <= STEPS else F.when(y < n, y).otherwise(walk(y, outside))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` (bigint, gapless from 0 in the order given) and their count.

    Rows are dealt by ranges and sorted there; the position in the range and
    the sizes of the ranges before it make the number, so no task sorts them
    all.  Rows that agree in all of ``order`` may swap numbers.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed, "ranges").withColumn("_range", F.shiftright("_place", 33).cast("int"))
    sizes = placed.groupBy("_range").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    # One row per range: as many rows as the shuffle had partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_range").withColumn("row_number", F.col("_start") + inside).drop("_place", "_range", "_start"), total


def shards(docs: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of every row.

    Order of the row numbers: doc_id (null first), then size and hash of the text;
    rows equal in these are alike and may swap places.  A null text has no
    bytes: size 16, checksum 0.  An empty table gives no rows; extra columns
    are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
    )
    found, n = numbered(rows, ["doc_id", "size", "text_crc32", "_hash"])
    place = found.withColumn("_at", permuted(F.col("row_number"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32", "row_number", F.pmod("_at", F.lit(n_shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("_at"), F.lit(n_shards)).cast("bigint").alias("slot"),
    )
