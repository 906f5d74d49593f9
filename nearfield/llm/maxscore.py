"""Ranked lexical search by MaxScore with bounds for pairs of terms.

Documents are cut into shards of bounded size.  A shard keeps, by term, the rows that hold it,
the largest impact, and for chosen pairs of terms what their intersection
list gives: the largest joint impact of a row that holds both, and the k-th largest.

A query's terms are taken two by two.  No row gets more from a pair than the largest of its
joint maximum and the two single maxima, which is less than the two maxima together wherever no
single row has both.  Pairs are ordered by this bound; while the bounds of the first ones together stay
below the k-th best score so far, rows that hold only such terms are never looked at, and rows that
others found are dropped as soon as the bounds of what is left cannot lift them.  The k-th
largest joint impact of any pair in any shard starts the threshold.  The result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from nearfield.llm.common import in_arrow, raw, slices
from nearfield.session import materialize

# Runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII characters.
_TERMS = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b > 0x7F else 0x20 for b in range(256))
# Rows (at most 2**16) and postings of a shard, and bytes of queries that one broadcast holds.
SHARD_ROWS = 4096
SHARD_POSTINGS = 1 << 18
BLOCK_BYTES = 4 << 20

# A posting is a row of the shard (two bytes) and how often it holds the term (four).
_SHARD = "ids array<bigint>, lengths array<bigint>, terms array<int>, starts array<int>, rows binary, times binary"
_POSTED = f"{_SHARD}, n_docs bigint, n_terms bigint"
_INDEX = f"{_SHARD}, single array<bigint>, pairs array<int>, joint array<bigint>, kth array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


@dataclass
class Queries:
    """A block of queries: distinct terms by number, and each query's terms two by two."""

    ids: list
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]]) -> "Queries":
        texts: dict[object, set[bytes]] = {}
        for item, text in rows:
            texts.setdefault(item, set()).update(terms_of(text))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))}
        return cls(list(texts), vocabulary, [np.array(sorted(vocabulary[t] for t in x), np.int64) for x in texts.values()])

    def coupled(self, holders: np.ndarray, weights: np.ndarray) -> "Coupled":
        """Terms that score, the most frequent with the next; a last odd one stays alone."""
        pairs: dict[tuple[int, int], int] = {}
        units = []
        for terms in self.terms:
            terms = terms[weights[terms] > 0]
            terms = terms[np.lexsort((terms, -holders[terms]))]
            two = [(int(a), int(b)) for a, b in zip(terms[::2], terms[1::2])]
            one = [int(terms[-1])] if len(terms) % 2 else []
            units.append(([pairs.setdefault(x, len(pairs)) for x in two], one))
        return Coupled(weights, np.array(list(pairs), np.int64).reshape(-1, 2), units)


@dataclass
class Coupled:
    weights: np.ndarray
    pairs: np.ndarray
    # For each query the numbers of its pairs, and its odd term.
    units: list[tuple[list[int], list[int]]]


def _post(vocabulary: dict[bytes, int]):
    """Shards with the terms of the vocabulary posted, and all documents counted."""

    def shard(ids: list, lengths: list[np.ndarray], places: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        place, term = np.concatenate(places), np.concatenate(found)
        key, times = np.unique(term * SHARD_ROWS + place, return_counts=True)
        term, row = key // SHARD_ROWS, key % SHARD_ROWS
        terms, starts = np.unique(term, return_index=True)
        length = np.concatenate(lengths)
        made = {"ids": (ids, pa.int64()), "lengths": (length, pa.int64()), "terms": (terms.astype(np.int32), pa.int32()), "starts": (np.append(starts, len(key)).astype(np.int32), pa.int32())}
        lists = [pa.array([x], pa.list_(kind)) for x, kind in made.values()]
        postings = [pa.array([x.tobytes()], pa.binary()) for x in (row.astype(np.uint16), times.astype(np.uint32))]
        sums = [pa.array([int((length > 0).sum())], pa.int64()), pa.array([int(length.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays([*lists, *postings, *sums], [*made, "rows", "times", "n_docs", "n_terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, places, found, posted = [], [], [], [], 0
        for batch in batches:
            for part in slices(batch):
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    if ids and (len(ids) + some.num_rows > SHARD_ROWS or posted > SHARD_POSTINGS):
                        yield shard(ids, lengths, places, found)
                        ids, lengths, places, found, posted = [], [], [], [], 0
                    words = [terms_of(x) for x in raw(some.column("text"))]
                    length = np.fromiter(map(len, words), np.int64, len(words))
                    term = np.fromiter(map(vocabulary.get, (w for x in words for w in x), repeat(-1)), np.int64, int(length.sum()))
                    place = np.repeat(np.arange(len(ids), len(ids) + len(words)), length)[term >= 0]
                    ids += some.column("doc_id").to_pylist()
                    lengths.append(length)
                    places.append(place)
                    found.append(term[term >= 0])
                    posted += len(place)
        if ids:
            yield shard(ids, lengths, places, found)

    return run


class Shard:
    """The postings of one shard with their impacts."""

    def __init__(self, batch: pa.RecordBatch, i: int, weights: np.ndarray, n_docs: int, n_terms: int):
        self.lengths, self.terms, self.starts = (self.list(batch, i, x) for x in ("lengths", "terms", "starts"))
        self.rows = np.frombuffer(batch.column("rows")[i].as_py(), np.uint16).astype(np.int64)
        times = np.frombuffer(batch.column("times")[i].as_py(), np.uint32).astype(np.int64)
        m = 10 + (90 * self.lengths * n_docs) // n_terms if n_terms else self.lengths
        self.sizes = np.diff(self.starts)
        self.impacts = weights[np.repeat(self.terms, self.sizes)] * ((1_000_000_000 * times) // (1000 * times + 8 * m[self.rows]))
        # Where the postings of a term of the vocabulary are; -1 if the shard has none.
        self.place = np.full(len(weights), -1)
        self.place[self.terms] = np.arange(len(self.terms))

    @staticmethod
    def list(batch: pa.RecordBatch, i: int, name: str) -> np.ndarray:
        return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[t], self.starts[t + 1])
        return self.rows[at], self.impacts[at]


def joint_maxima(shard: Shard, pairs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the pairs with both terms in the shard, largest joint impact, k-th largest; 0 for none)."""
    here = np.flatnonzero((shard.place[pairs] >= 0).all(axis=1))
    both, sizes = shard.place[pairs[here]], shard.sizes
    # The longer list is spread out once for all pairs it is in.
    both = np.where((sizes[both[:, 0]] >= sizes[both[:, 1]])[:, None], both, both[:, ::-1])
    joint, kth = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
    wide, last = np.full(len(shard.lengths), -1), -1
    for j in np.argsort(both[:, 0], kind="stable").tolist():
        a, b = both[j]
        if a != last:
            wide[:] = -1
            rows, impacts = shard.postings(a)
            wide[rows] = impacts
            last = a
        rows, impacts = shard.postings(b)
        sums = (wide[rows] + impacts)[wide[rows] >= 0]
        if len(sums):
            joint[j] = sums.max()
            if len(sums) >= k:
                kth[j] = np.partition(sums, len(sums) - k)[len(sums) - k]
    return here, joint, kth


def _weigh(coupled: Coupled, n_docs: int, n_terms: int, k: int):
    """Shards with the largest impact of each term and the joint maxima of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, coupled.weights, n_docs, n_terms)
                here, joint, kth = joint_maxima(shard, coupled.pairs, k)
                single = np.maximum.reduceat(shard.impacts, shard.starts[:-1]) if len(shard.terms) else np.empty(0, np.int64)
                made = {"single": (single, pa.int64()), "pairs": (here.astype(np.int32), pa.int32()), "joint": (joint, pa.int64()), "kth": (kth, pa.int64())}
                kept = ["ids", "lengths", "terms", "starts", "rows", "times"]
                lists = [pa.array([x], pa.list_(kind)) for x, kind in made.values()]
                yield pa.RecordBatch.from_arrays([*[batch.column(x).slice(i, 1) for x in kept], *lists], [*kept, *made])

    return run


class Best:
    """The k best (score, id) so far; equal scores by smaller id, rows without id last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)
        self.scores, self.ids, self.absent = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        scores, ids, absent = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.absent, absent)
        if len(scores) > 4 * self.k:
            some = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, absent = scores[some], ids[some], absent[some]
        order = np.lexsort((ids, absent, -scores))[: self.k]
        self.scores, self.ids, self.absent = scores[order], ids[order], absent[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _candidates(units: list[tuple[int, list[int]]], postings, n_rows: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores) of all rows that may reach ``least``, and how many units were never opened.

    ``units``: (bound, places of its terms in the shard).
    """
    units = sorted(units)
    rest = np.cumsum([0, *(x for x, _ in units)])
    # A row with nothing but the terms of the first units stays below the threshold.
    skipped = int(np.searchsorted(rest[1:], least))
    total = np.zeros(n_rows, np.int64)
    for _, terms in units[skipped:]:
        for t in terms:
            rows, impacts = postings(t)
            total[rows] += impacts
    rows = np.flatnonzero(total + rest[skipped] >= least) if skipped < len(units) else np.empty(0, np.int64)
    rows = rows[total[rows] > 0]
    scores = total[rows]
    for i in range(skipped - 1, -1, -1):
        for t in units[i][1]:
            holders, impacts = postings(t)
            at = np.minimum(np.searchsorted(holders, rows), len(holders) - 1)
            scores = scores + np.where(holders[at] == rows, impacts[at], 0)
        keep = scores + rest[i] >= least
        rows, scores = rows[keep], scores[keep]
    return rows, scores, skipped


def _search(coupled: Coupled, n_docs: int, n_terms: int, least: list[int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in least]
        both = coupled.pairs.tolist()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch, i, coupled.weights, n_docs, n_terms)
                named = batch.column("ids")[i].values
                absent, ids = np.asarray(named.is_null()), named.fill_null(0).to_numpy(zero_copy_only=False)
                most = np.zeros(len(coupled.weights), np.int64)
                most[shard.terms] = shard.list(batch, i, "single")
                # A pair's bound: the best row with both terms, or with one of them.
                bound, pairs = most[coupled.pairs].max(axis=1), shard.list(batch, i, "pairs")
                bound[pairs] = np.maximum(bound[pairs], shard.list(batch, i, "joint"))
                place, most, bound = shard.place.tolist(), most.tolist(), bound.tolist()
                for state, (two, one) in zip(best, coupled.units):
                    units = [(bound[x], [place[t] for t in both[x] if place[t] >= 0]) for x in two] + [(most[t], [place[t]]) for t in one]
                    units = [x for x in units if x[0]]
                    if sum(x for x, _ in units) >= state.least:
                        found, scores, _ = _candidates(units, shard.postings, len(ids), state.least)
                        if len(found):
                            state.offer(scores, ids[found], absent[found])
        for query, state in enumerate(best):
            names = pa.array(state.ids, pa.int64(), mask=state.absent)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), query, np.int32)), names, pa.array(state.scores)], ["query", "doc_id", "score"])

    return run


def _block(rows: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(query, doc_id, score): the k best rows of every task for each query of the block."""
    posted = materialize(in_arrow(rows, _post(queries.vocabulary), _POSTED), "posted")
    n_docs, n_terms = (int(x or 0) for x in posted.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    times = F.expr("inline(arrays_zip(terms, transform(sequence(1, size(terms)), i -> starts[i] - starts[i - 1])))")
    holders = np.zeros(len(queries.vocabulary), np.int64)
    for term, n in posted.where("size(terms) > 0").select(times.alias("term", "n")).groupBy("term").agg(F.sum("n")).collect():
        holders[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) if n else 0 for n in holders], np.int64)
    coupled = queries.coupled(holders, weights)
    index = materialize(in_arrow(posted, _weigh(coupled, n_docs, n_terms, k), _INDEX), "bounds")
    start = dict(map(tuple, index.select(F.inline(F.arrays_zip("pairs", "kth"))).groupBy("pairs").agg(F.max("kth")).collect()))
    least = [max([start.get(x, 0) for x in two], default=0) for two, _ in coupled.units]
    return in_arrow(index, _search(coupled, n_docs, n_terms, least, k), "query int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, score above 0.

    Items go to the tasks in blocks of about ``block_bytes``; each block indexes its own terms in all
    documents.  Rows of one ``item_id``, a null one included, are one item with the terms
    of all of them.  A null or wordless text has no terms: as an item it finds nothing, as a document it is never
    found.  Repeated documents are ranked each for itself; a null ``doc_id`` comes after all others
    of its score.  Without documents or items there are no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", text).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    result = None
    for block in range(blocks):
        chosen = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        queries = Queries.of([(r["item_id"], r["text"].encode()) for r in chosen.collect()]) if size else Queries([], {}, [])
        names = spark.createDataFrame(list(enumerate(queries.ids)), StructType([StructField("query", LongType()), StructField("item_id", kind)]))
        found = _block(rows, queries, k).join(F.broadcast(names), "query").select("item_id", "doc_id", "score")
        result = found if result is None else result.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
