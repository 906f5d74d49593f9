"""What the corpus operators share: reading tables, Arrow helpers, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearfield.session import discard, materialize, ship_package

# Bytes of text that one Python step holds at a time (or one row); bounds the memory of a task.
SLICE_BYTES = 2 << 20
_BATCH, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
# Entries of a per-task word cache; it starts afresh beyond this.
CACHE_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string): nothing else of the input is looked at, a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def in_arrow(df: DataFrame, make: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors.

    Python workers live on after a task; each hands its freed memory back to the machine.
    Arrow batches are bounded by their bytes, as texts of any length come, unless the session sets its own bound.
    """
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == _DEFAULT_BATCH:
        conf.set(_BATCH, str(SLICE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``size`` bytes of text each (one row may be larger)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 8
    if start < batch.num_rows:
        yield batch.slice(start)


class WordHashes(dict):
    """XXH64 of words, kept while they recur."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, self.seed)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count values) for every pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Alternating star contraction: every round hangs the larger neighbours of a
    node, then its smaller ones, onto the smallest.  Minima are aggregated per
    task before they move and the joins are plain equi-joins, which adaptive
    execution splits at a hot node.  Each round is a written table, and the one before it goes.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    state = materialize(edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                state.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        seen = mark
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, state = state, materialize(hung.where("a != b").distinct(), "edges")
        discard(before, large)
