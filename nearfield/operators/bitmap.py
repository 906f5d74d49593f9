"""Cutting a table to a list of ids where it is read, however long the list is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the bitmap: at most 64 MB of pairs (word, marks).
BITMAP_WORDS = 1 << 22


def with_listed(df: DataFrame, key: str, ids: DataFrame, output: str, words: int = BITMAP_WORDS) -> DataFrame:
    """Add the boolean ``output``: false only if ``key`` is surely not among ``ids`` (one column).

    Tasks mark the hash of every id in a bitmap of ``words`` 64-bit words; only words with a mark are
    kept and broadcast, so neither side is shuffled.  An unlisted key is taken for listed where its
    mark is set, about as often as the bitmap is full.
    """
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(words * 64))
    marks = ids.select(slot(F.col(ids.columns[0]).cast("bigint")).alias("place"))
    marks = marks.selectExpr("place div 64 AS word", "shiftleft(1L, int(place % 64)) AS mark")
    bitmap = F.broadcast(marks.groupBy("word").agg(F.bit_or("mark").alias("marks")))
    # The table's columns travel as one, whatever their names.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot(F.col(key).cast("bigint")).alias("place"))
    marked = rows.withColumn("word", F.expr("place div 64")).join(bitmap, "word", "left")
    listed: Column = F.expr("coalesce((shiftrightunsigned(marks, int(place % 64)) & 1) = 1, false)")
    return marked.select("row.*", listed.alias(output))


def only_listed(df: DataFrame, key: str, ids: DataFrame, words: int = BITMAP_WORDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``ids``: all that are, and few others; see :func:`with_listed`."""
    found = with_listed(df, key, ids, "__listed", words)
    return found.filter("__listed").drop("__listed")
