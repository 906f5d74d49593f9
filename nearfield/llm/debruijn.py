"""Repeated spans by a compacted De Bruijn graph of words.

The graph's edges are the windows of ``k`` = 20 consecutive words, its nodes the runs of 19 between
them; a window that occurs twice is an edge that two places share.

1. *Pieces.*  Neighbouring edges that share their minimizer (the 5-word run with the smallest
   hash inside the window) form one piece of a path, a super-k-mer.  Equal windows have equal
   minimizers, so only pieces whose minimizer occurs more than once take part; the others are
   dropped where they are read, by a bitmap.
2. *Graph.*  Equal pieces are one path: a grouped minimum finds its first source, and the pieces that
   come before and behind it at its sources are its neighbours.  A minimizer with different
   pieces is where paths branch, which a grouped minimum and maximum of the pieces tell.
3. *Compaction.*  Two repeated pieces whose node between them has one way in and one way out belong to one
   nonbranching path.  Joins on the neighbours make them so: each round every piece
   points as far again towards the head of its path, and learns its place there.
4. *Spans.*  The graph is joined back to the pieces.  Repeats of one path on one diagonal of
   a document are one span.  Pieces of branching minimizers are verified at their sources: their edges are
   read from the documents by coordinates and compared one by one by 128-bit hashes.
5. Spans are joined to the documents that have any, and cut.

A piece that is not the first of its kind has no first edge, and the earliest source of any edge lies in
a first piece, so steps 2 and 4 decide every edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WordHashes, in_arrow, mixed, ragged, raw, slices, texts_of
from nearfield.operators.bitmap import only_listed, with_listed
from nearfield.session import discard, materialize

WINDOW = 20
SEED_WORDS = 5
ROUNDS = 4
_BASES = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Spans:
    """Hashes of any runs of a word sequence, by sums of powers modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int):
        up, self.down = _powers(base, len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def pieces(hashes: np.ndarray, ends: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of several documents laid end to end: (document, start, edges, minimizer hash, hash).

    ``ends`` are the documents' ends in ``hashes``; starts count in the whole sequence.
    """
    none = np.empty(0, np.int64)
    n = len(hashes)
    if n < k:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    seeds = mixed(Spans(hashes, _BASES[1]).of(np.arange(n - m + 1), np.arange(m, n + 1)))
    least = np.lib.stride_tricks.sliding_window_view(seeds, k - m + 1).argmin(axis=1)
    starts = np.arange(n - k + 1)
    owner = np.searchsorted(ends, starts, side="right")
    valid = starts + k <= ends[owner]
    starts, owner, least = starts[valid], owner[valid], least[valid]
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = starts + least
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(starts)))
    begin, place, owner = starts[first], place[first], owner[first]
    words = Spans(hashes, _BASES[0]).of(begin, begin + count + k - 1)
    shape = (place - begin).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)
    return owner, begin, count, seeds[place], mixed(words ^ mixed(shape))


def _ids(part: pa.RecordBatch) -> np.ndarray:
    """doc_ids as integers; null sorts before all others."""
    return part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _columns(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in arrays]


_PIECE = ["minimizer", "words", "doc_id", "start", "edges", "before", "behind"]


def _pieces(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes(1)
        for batch in batches:
            for part in slices(batch):
                words = [x.split() for x in raw(part.column("text"))]
                ends = np.cumsum([len(x) for x in words])
                owner, begin, count, seed, whole = pieces(cache.of([w for x in words for w in x]), ends, k, m)
                start = begin - np.append(0, ends)[owner]
                # Half the hashes of the pieces on both sides in the same document; 0 where there is none.
                next_, half = owner[1:] == owner[:-1], whole.astype(np.uint32).view(np.int32)
                before, behind = np.zeros(len(whole), np.int32), np.zeros(len(whole), np.int32)
                before[1:], behind[:-1] = np.where(next_, half[:-1], 0), np.where(next_, half[1:], 0)
                doc = _ids(part)[owner]
                yield pa.RecordBatch.from_arrays(_columns(seed, whole, doc, start.astype(np.int32), count.astype(np.int8), before, behind), _PIECE)

    return run


_EDGE = ["low", "high", "doc_id", "start"]


def _edges(k: int):
    """128-bit hashes of the edges in the listed pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes(1)
        for batch in batches:
            for part in slices(batch):
                listed = part.column("branching")
                flat = listed.flatten()
                counts = np.diff(listed.offsets.to_numpy())
                words = [x.split() for x in raw(part.column("text"))]
                ends = np.cumsum([len(x) for x in words])
                before = np.append(0, ends)[:-1]
                hashes = cache.of([w for x in words for w in x])
                owner = np.repeat(np.arange(part.num_rows), counts)
                edges = flat.field("edges").to_numpy().astype(np.int64)
                start = ragged(flat.field("start").to_numpy().astype(np.int64), edges)
                owner = np.repeat(owner, edges)
                at = before[owner] + start
                fits = at + k <= ends[owner]
                owner, start, at = owner[fits], start[fits], at[fits]
                low, high = (Spans(hashes, base).of(at, at + k) for base in _BASES)
                yield pa.RecordBatch.from_arrays(_columns(low, high, _ids(part)[owner], start.astype(np.int32)), _EDGE)

    return run


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("repeats")
            offsets = listed.offsets.to_numpy()
            starts, edges = (listed.values.field(x).to_numpy().astype(np.int64) for x in ("start", "edges"))
            out: list[tuple] = []
            for i, text in enumerate(raw(batch.column("text"))):
                words = text.split()
                a, b = offsets[i], offsets[i + 1]
                if a == b or not words:
                    out.append((len(words), 0, [], b" ".join(words)))
                    continue
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, np.minimum(starts[a:b], len(words)), 1)
                np.add.at(change, np.minimum(starts[a:b] + edges[a:b] + k - 1, len(words)), -1)
                gone = np.cumsum(change[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
                kept = [words[j] for j in np.flatnonzero(~gone).tolist()]
                out.append((len(words), int(gone.sum()), [{"start": s, "stop": t} for s, t in turns.tolist()], b" ".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], _SPANS), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"],
            )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_NULL_ID = -(1 << 63)


def compacted(graph: DataFrame, rounds: int) -> DataFrame:
    """(minimizer, words, path, place): the head of each repeated piece's nonbranching path, and its first edge's place there.

    ``graph``: repeated pieces with ``edges`` and half the hash of their only neighbours (``before``, ``behind``; null if several).
    Two pieces are linked when each names the other.
    After ``rounds`` a path holds up to 2**rounds pieces; a longer one stays several.
    """
    half = F.shiftright(F.shiftleft("words", 32), 32).cast("int")
    behind = graph.where("behind IS NOT NULL").select(F.col("words").alias("from_"), half.alias("before"), F.col("behind").alias("own"), F.col("edges").alias("step"))
    linked = graph.withColumn("own", half).join(behind.hint("shuffle_hash"), ["before", "own"], "left")
    # A piece points at the one before it, or at itself where a path begins.
    state = linked.select("minimizer", "words", F.coalesce("from_", "words").alias("path"), F.coalesce("step", F.lit(0)).cast("int").alias("place"))
    state = materialize(state, "paths")
    for _ in range(rounds):
        ahead = state.where("path != words").select(F.col("words").alias("path"), F.col("path").alias("further"), F.col("place").alias("step"))
        longer = state.join(ahead.hint("shuffle_hash"), "path", "left").select("minimizer", "words", F.coalesce("further", "path").alias("path"), (F.col("place") + F.coalesce("step", F.lit(0))).alias("place"))
        before, state = state, materialize(longer, "paths")
        discard(before)
    return state


def cut_repeats(docs: DataFrame, k: int = WINDOW, seed_words: int = SEED_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256) of every row.

    Words are runs of non-blank characters.  ``spans`` are the removed word
    ranges [start, stop): all words of windows of ``k`` words that also start earlier
    (smaller doc_id, or earlier in the same document).  A null text has no
    words; a null doc_id is the smallest.  Rows that repeat a doc_id count as one
    document: a window is no repeat of one at the same place, and what is cut
    from one of them is cut from each.  Other columns are ignored.
    """
    rows = texts_of(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)))
    every = in_arrow(rows, _pieces(k, seed_words), "minimizer bigint, words bigint, doc_id bigint, start int, edges tinyint, before int, behind int")
    every = materialize(every, "pieces")
    shared = every.groupBy("minimizer").count().where("count > 1").select("minimizer")
    found = materialize(only_listed(every, "minimizer", shared), "shared")
    discard(every)

    here = F.struct("doc_id", "start")
    only = lambda x: F.when((F.min(x) == F.max(x)) & (F.min(x) != 0), F.min(x)).alias(x)
    kinds = found.groupBy("minimizer", "words").agg(
        F.min(here).alias("first"), (F.min(here) != F.max(here)).alias("repeated"), F.max("edges").alias("edges"), only("before"), only("behind")
    )
    kinds = materialize(kinds, "kinds")
    branching = kinds.groupBy("minimizer").agg((F.min("words") != F.max("words")).alias("branching"))
    paths = compacted(kinds.where("repeated").select("minimizer", "words", "edges", "before", "behind"), rounds)
    kinds = kinds.select("minimizer", "words", "first", "repeated").join(branching.hint("shuffle_hash"), "minimizer").where("repeated OR branching")
    kinds = kinds.join(paths.hint("shuffle_hash"), ["minimizer", "words"], "left").select("minimizer", "words", "first", "branching", "path", "place")
    decided = found.select("minimizer", "words", "doc_id", "start", "edges").join(kinds.hint("shuffle_hash"), ["minimizer", "words"])
    decided = decided.select("doc_id", "start", "edges", (here != F.col("first")).alias("repeat"), "branching", "path", "place")
    decided = materialize(decided.where("repeat OR branching"), "decided")
    discard(found)

    # Repeats of one path on one diagonal follow each other without a gap.
    spans = decided.where("repeat").groupBy("doc_id", "path", (F.col("start") - F.col("place")).alias("diagonal")).agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("edges")) - F.min("start")).alias("edges")
    )
    spans = materialize(spans.select("doc_id", "start", "edges"), "spans")
    piece = F.collect_list(F.struct("start", "edges"))
    branching = decided.where("branching AND NOT repeat").groupBy("doc_id").agg(piece.alias("branching"))
    looked_up = only_listed(rows, "doc_id", branching.select("doc_id")).join(branching, "doc_id").select("doc_id", "text", "branching")
    edges = in_arrow(looked_up, _edges(k), "low bigint, high bigint, doc_id bigint, start int")
    edges = materialize(edges, "edges")
    first = edges.groupBy("low", "high").agg(F.min(here).alias("first"), (F.min(here) != F.max(here)).alias("repeated")).where("repeated")
    edges = edges.join(first.drop("repeated").hint("shuffle_hash"), ["low", "high"]).where(here != F.col("first")).select("doc_id", "start", F.lit(1).alias("edges"))

    repeats = spans.union(edges).groupBy("doc_id").agg(piece.alias("repeats"))
    repeats = materialize(repeats, "repeats")
    marked = with_listed(rows, "doc_id", repeats.select("doc_id"), "listed")
    none = F.expr("cast(array() as array<struct<start:int,edges:int>>)")
    whole = marked.where("NOT listed").select("doc_id", "text", none.alias("repeats"))
    cut = marked.where("listed").join(repeats, "doc_id", "left").select("doc_id", "text", F.coalesce("repeats", none).alias("repeats"))
    out = in_arrow(whole.union(cut), _cut(k), "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,stop:int>>, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))
