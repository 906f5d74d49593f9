"""Truncated SVD of sparse rows over a wide vocabulary, without any width x width matrix.

A random sketch S of the rows A (rows x (components + oversample)) spans nearly what their leading
singular vectors span.  As S is A times a matrix with a row per term, every task makes the sketch of
its rows anew and nothing as long as the rows is stored, but where that matrix is too large for a task: the
sketch is a table then.  One scan of the rows gives A'S, summed over a task's rows before it moves, and the triangular
factor of S by a tall-skinny QR: every task factors its own rows, and the small factors are stacked and factored again, eight
at a time, until one is left.  Only the triangular factors of S and of A'S are decomposed on the
driver.  The embeddings are then a small matrix applied to the sketch.  What is shuffled depends
on the tasks, the vocabulary and the components, not on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import BROADCAST_LIMIT, discard, hand_back, materialize, parallelism, ship_package, slots

_CHUNK = 256
# Bytes of a matrix with a row per term that a task holds; it may hold two.
_HELD_BYTES = 144 << 20
_FAN_IN = 8
# Rows, and entries (or one row), that are multiplied at a time.
_RUN_ROWS = 2048
_RUN_ENTRIES = 1 << 19
# Terms of at least this share of a run's rows are multiplied as dense columns, so many at most; the others entry by entry,
# so many matrix rows at a time.
_DENSE_SHARE = 0.04
_DENSE_TERMS = 1024
_GATHERED = 512


def signs(terms: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Row of the random matrix for each term: -1 and 1 by a hash of (seed, term, column)."""
    x = (terms.astype(np.uint64)[:, None] << np.uint64(20)) + np.arange(count, dtype=np.uint64)[None, :] + (np.uint64(seed) << np.uint64(52))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return np.where(x >> np.uint64(63), 1.0, -1.0)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, terms, dense) of runs of rows; ``dense`` holds the columns of ``terms`` only."""
    for start in range(0, batch.num_rows, _CHUNK):
        part = batch.slice(start, _CHUNK)
        listed = part.column("terms")
        sizes = np.nan_to_num(listed.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        owner = np.repeat(np.arange(part.num_rows), sizes)
        terms, place = np.unique(listed.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        dense = np.zeros((part.num_rows, len(terms)))
        dense[owner, place] = part.column("weights").flatten().to_numpy(zero_copy_only=False)
        yield start, part.num_rows, terms, dense


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sketch(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """``rows`` (doc_id, terms, weights) with ``sketch``, their products with ``count`` random columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, terms, dense in _chunks(batch):
                product = dense @ signs(terms, count, seed) if len(terms) else np.zeros((n, count))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, n).columns, _lists(product, pa.float64())], names=[*batch.schema.names, "sketch"])

    return rows.mapInArrow(run, "doc_id bigint, terms array<int>, weights array<double>, sketch array<double>")


def triangular_factor(rows: DataFrame, column: str, count: int) -> np.ndarray:
    """R (count x count) of the QR factorisation of the rows' matrix, up to the signs of its rows."""
    spark = rows.sparkSession

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def reduced() -> np.ndarray:
            return np.linalg.qr(np.concatenate(held), mode="r")

        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column("r")))
                n += batch.num_rows
            if n > 4 * count:
                held = [reduced()]
                n = len(held[0])
        if n:
            yield pa.RecordBatch.from_arrays([_lists(reduced(), pa.float64())], names=["r"])

    tasks = parallelism(spark)
    factors = materialize(rows.select(F.col(column).alias("r")).coalesce(tasks).mapInArrow(factor, "r array<double>"), "factors")
    while tasks > _FAN_IN:
        # Each step stacks some factors of at most count rows.
        tasks = -(-tasks // _FAN_IN)
        factors = materialize(factors.coalesce(tasks).mapInArrow(factor, "r array<double>"), "factors")
    found = _matrix(factors.toArrow().column("r").combine_chunks()) if not factors.isEmpty() else np.zeros((0, count))
    return np.linalg.qr(np.concatenate([found, np.zeros((count, count))]), mode="r")


class _Run:
    """Some sparse rows as a factor: their frequent terms as dense columns, all other entries by row and by term."""

    def __init__(self, part: pa.RecordBatch):
        n, listed = part.num_rows, part.column("terms")
        sizes = np.nan_to_num(listed.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        owner = np.repeat(np.arange(n), sizes)
        self.terms, place, times = np.unique(listed.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        weights = part.column("weights").flatten().to_numpy(zero_copy_only=False)
        often = np.argsort(-times, kind="stable")[:_DENSE_TERMS]
        often = often[times[often] >= _DENSE_SHARE * n]
        column = np.full(len(self.terms), -1)
        column[often] = np.arange(len(often))
        self.often, column = self.terms[often], column[place]
        dense, rare = column >= 0, np.flatnonzero(column < 0)
        cells = owner[dense] * len(often) + column[dense]
        self.dense = np.bincount(cells, weights[dense], n * len(often)).reshape(n, len(often))
        self.by_row = owner[rare], self.terms[place[rare]], weights[rare]
        order = rare[np.argsort(place[rare], kind="stable")]
        self.by_term = self.terms[place[order]], owner[order], weights[order]

    def times(self, table: np.ndarray) -> np.ndarray:
        """The rows times ``table``, which has a row per term."""
        product = self.dense @ table[self.often]
        _add_products(product, *self.by_row, table)
        return product

    def add_transposed(self, sketch: np.ndarray, total: np.ndarray) -> None:
        """Add the transposed rows times ``sketch`` to ``total``, which has a row per term."""
        total[self.often] += self.dense.T @ sketch
        _add_products(total, *self.by_term, sketch)


def _add_products(total: np.ndarray, into: np.ndarray, of: np.ndarray, weights: np.ndarray, table: np.ndarray) -> None:
    """Add ``weights[i] * table[of[i]]`` to ``total[into[i]]``; ``into`` is sorted."""
    known, starts = np.unique(into, return_index=True)
    ends = np.append(starts[1:], len(into)).tolist()
    space = np.empty((_GATHERED, table.shape[1]))
    for row, start, end in zip(known.tolist(), starts.tolist(), ends):
        for first in range(start, end, _GATHERED):
            last = min(first + _GATHERED, end)
            total[row] += weights[first:last] @ table.take(of[first:last], axis=0, out=space[: last - first], mode="clip")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.nan_to_num(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    before = np.append(0, np.cumsum(sizes))
    start = 0
    while start < batch.num_rows:
        fits = int(np.searchsorted(before, before[start] + _RUN_ENTRIES, side="right")) - 1
        end = min(max(start + 1, fits), start + _RUN_ROWS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


@dataclass
class _Size:
    """Different terms and entries of the rows; ``held``: a task, or the driver, may hold a matrix with a row per term."""

    width: int
    entries: int
    held: bool


# Given the columns of the sketch that are wanted: what makes them of a run.  Called once per task.
Sketcher = Callable[[slice], Callable[[pa.RecordBatch, _Run], np.ndarray]]


def _by_signs(width: int, count: int, seed: int) -> Sketcher:
    def start(columns: slice) -> Callable[[pa.RecordBatch, _Run], np.ndarray]:
        table = _signs_of_all(width, count, seed, columns)
        return lambda part, run: run.times(table)

    return start


def _signs_of_all(width: int, count: int, seed: int, columns: slice = slice(None)) -> np.ndarray:
    table = np.empty((width, len(range(count)[columns])))
    for first in range(0, width, 1024):
        some = np.arange(first, min(first + 1024, width))
        table[some] = signs(some, count, seed)[:, columns]
    return table


def _by_table(rows: DataFrame, table: np.ndarray) -> Sketcher:
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def start(columns: slice) -> Callable[[pa.RecordBatch, _Run], np.ndarray]:
        own = np.ascontiguousarray(shared.value[:, columns])
        return lambda part, run: run.times(own)

    return start


def _stored(columns: slice) -> Callable[[pa.RecordBatch, _Run], np.ndarray]:
    return lambda part, run: np.ascontiguousarray(_matrix(part.column("sketch"))[:, columns])


class _Factor:
    """Triangular factor of the rows seen so far."""

    def __init__(self, count: int):
        self.count, self.held, self.n = count, [], 0

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.n += len(rows)
        if self.n > 2 * self.count:
            self.reduce()

    def reduce(self) -> np.ndarray:
        self.held = [np.linalg.qr(np.concatenate(self.held), mode="r")] if self.held else []
        self.n = sum(map(len, self.held))
        return self.held[0] if self.held else np.zeros((0, self.count))


def _lines(terms: np.ndarray, first: int, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(terms), 1024):
        some = terms[start : start + 1024]
        columns = [pa.array(some, pa.int32()), pa.array(np.full(len(some), first, np.int32)), _lists(matrix[start : start + 1024], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "first", "z"])


def term_products(rows: DataFrame, sketcher: Sketcher, size: _Size, count: int, factor: bool = False) -> DataFrame:
    """(term, first, z): rows of A'S from the column ``first`` on, summed per task, then by term; stored.  With ``factor`` also, under
    terms below zero, the rows of factors whose stack has the triangular factor of S.

    Every task moves sums of all terms.  Rows are cut into as few blocks as keep that below the size of the rows; where this
    leaves slots idle, or sums do not fit into ``_HELD_BYTES``, tasks sum some columns of the sketch each.
    """
    spark, width, present = rows.sparkSession, size.width, rows.rdd.getNumPartitions()
    # At least two: a union of single partitions would be a single partition.
    blocks = max(2, min(slots(spark), 12 * size.entries // max(1, 8 * width * count)))
    panels = min(count, max(-(-slots(spark) // blocks), -(-8 * width * count // _HELD_BYTES)))
    blocks = max(2, min(blocks, slots(spark) // panels))
    cuts = np.linspace(0, count, panels + 1).astype(int).tolist()

    def partial(tasks: int, columns: slice, summed: bool, factored: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = None
            triangle = _Factor(count)
            for batch in batches:
                for part in _runs(batch):
                    if make is None:
                        make = sketcher(columns)
                        sums, seen = np.zeros((width, columns.stop - columns.start)) if summed else None, np.zeros(width, bool)
                    own = _Run(part)
                    product = make(part, own)
                    if factored:
                        triangle.add(product)
                    if summed:
                        own.add_transposed(product, sums)
                        seen[own.terms] = True
            if make is not None:
                found = np.flatnonzero(seen)
                for some in np.array_split(found, max(1, -(-len(found) // 1024))) if summed else ():
                    yield from _lines(some, columns.start, sums[some])
                if factored:
                    # The factors of some tasks meet under one number below zero.
                    r = triangle.reduce()
                    yield from _lines(np.full(len(r), -1 - TaskContext.get().partitionId() // _FAN_IN), 0, r)
            del make
            hand_back()

        return (rows.coalesce(tasks) if tasks < present else rows).mapInArrow(run, "term int, first int, z array<double>")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        triangles: dict[int, _Factor] = {}
        for batch in batches:
            if batch.num_rows:
                z = batch.column("z")
                flat, offsets = z.values.to_numpy(), z.offsets.to_numpy()
                for term, first, a, b in zip(batch.column("term").to_pylist(), batch.column("first").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if term < 0:
                        triangles.setdefault(term, _Factor(count)).add(flat[None, a:b].copy())
                    else:
                        sums.setdefault(term, np.zeros(count))[first : first + b - a] += flat[a:b]
        found = list(sums)
        for start in range(0, len(found), 1024):
            some = found[start : start + 1024]
            yield from _lines(np.array(some), 0, np.stack([sums[x] for x in some]))
        for term, triangle in triangles.items():
            r = triangle.reduce()
            yield from _lines(np.full(len(r), term), 0, r)

    # Where all columns of the sketch are in one task, its factor comes from the same scan.
    apart = factor and (panels > 1 or blocks < slots(spark))
    partials = partial(blocks, slice(cuts[0], cuts[1]), True, factor and not apart)
    for first, stop in zip(cuts[1:], cuts[2:]):
        partials = partials.unionByName(partial(blocks, slice(first, stop), True, False))
    if min(blocks, present) > 1 or panels > 1 and not size.held:
        # A partition holds the sums of its terms; few terms make few partitions.
        partials = partials.repartition(max(1, min(parallelism(spark), width)), "term").mapInArrow(add, "term int, first int, z array<double>")
    if apart:
        partials = partials.unionByName(partial(slots(spark), slice(0, count), False, True))
    return materialize(partials, "products")


def _triangle(products: DataFrame | np.ndarray, count: int) -> np.ndarray:
    """Triangular factor of products that are a table of whole rows (term, z) or a matrix."""
    if isinstance(products, DataFrame):
        return triangular_factor(products, "z", count)
    folded = _Factor(count)
    for start in range(0, len(products), 1024):
        folded.add(products[start : start + 1024])
    return np.linalg.qr(np.concatenate([folded.reduce(), np.zeros((count, count))]), mode="r")


def _orthonormal(triangle: np.ndarray, least: float) -> np.ndarray:
    """Matrix that makes the factored columns orthonormal; as many as singular values pass ``least`` times the largest."""
    _, values, right = np.linalg.svd(triangle)
    rank = int((values > max(values[0], 0.0) * least).sum()) if len(values) else 0
    return right[:rank].T / values[:rank]


def svd_embed_wide(rows: DataFrame, components: int = 512, oversample: int = 10, power: int = 1, seed: int = 1) -> DataFrame:
    """``doc_id, embedding`` of ``components`` entries: rows on their leading right singular vectors.

    Exact where the rank is at most ``components + oversample``; otherwise each of ``power`` rounds draws the
    sketch closer to the leading vectors.  Entries beyond the rank are zero, and the largest entry of every singular
    vector is made positive.  A round scans the rows, and so do the last products and the embedding.
    """
    ship_package(rows.sparkSession)
    count = components + oversample
    seen = rows.agg(F.max(F.array_max("terms")).alias("last"), F.sum(F.array_size("terms")).alias("entries")).first()
    width = (-1 if seen["last"] is None else seen["last"]) + 1
    size = _Size(width, seen["entries"] or 0, 8 * width * count <= _HELD_BYTES)
    sketched = rows if size.held else materialize(sketch(rows, count, seed), "sketch")
    sketcher, table = _by_signs(width, count, seed) if size.held else _stored, None
    for _ in range(power):
        stored = term_products(sketched, sketcher, size, count)
        products = _collected(stored, size, count) if size.held else stored
        # Directions lost in rounding do no harm here; the last factor tells the rank.
        mixing = _orthonormal(_triangle(products, count), 1e-14)
        count = mixing.shape[1]
        if not count:
            break
        if size.held:
            table = products @ mixing
            sketcher = _by_table(rows, table)
            discard(stored)
        else:
            mixed = materialize(_mixed(products, mixing), "mixed")
            sketched, old = materialize(_multiplied(rows, mixed, count), "sketch"), sketched
            discard(stored, mixed, old)
        del products
    result = np.zeros((count, components))
    if count:
        stored = term_products(sketched, sketcher, size, count, factor=True)
        mixing = _orthonormal(triangular_factor(stored.filter("term < 0"), "z", count), 1e-11)
        if mixing.shape[1]:
            products = _collected(stored, size, count) if size.held else stored.filter("term >= 0")
            # A'Q, with Q = S x mixing: as A'S = PR, its singular values are those of R x mixing.
            _, values, right = np.linalg.svd(_triangle(products, count) @ mixing, full_matrices=False)
            kept = min(components, mixing.shape[1])
            turn = mixing @ (right[:kept].T / np.maximum(values[:kept], np.finfo(float).tiny))
            result[:, :kept] = mixing @ (right[:kept].T * _signs(products, turn) * values[:kept])
            del products
        discard(stored)
    if size.held:
        if count and table is None:
            table = _signs_of_all(width, count, seed)
        projector, source = _by_table(rows, table @ result if count else np.zeros((width, components))), rows
    else:
        shared, source = rows.sparkSession.sparkContext.broadcast(result), sketched

        def projector(columns: slice) -> Callable[[pa.RecordBatch, _Run], np.ndarray]:
            return lambda part, run: _matrix(part.column("sketch"))[:, : len(shared.value)] @ shared.value

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        for batch in batches:
            for part in _runs(batch):
                make = make or projector(slice(0, components))
                embedded = make(part, _Run(part)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(embedded, pa.float32())], names=["doc_id", "embedding"])
        del make
        hand_back()

    return source.mapInArrow(project, "doc_id bigint, embedding array<float>")


def _mixed(products: DataFrame, mixing: np.ndarray) -> DataFrame:
    shared = products.sparkSession.sparkContext.broadcast(mixing)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([part.column("term"), _lists(_matrix(part.column("z")) @ shared.value, pa.float64())], names=["term", "z"])

    return products.mapInArrow(mix, "term int, z array<double>")


def _collected(stored: DataFrame, size: _Size, count: int) -> np.ndarray:
    """The products as one matrix with a row per term, taken in pieces."""
    table = np.zeros((size.width, count))
    pieces = max(1, -(-8 * size.width * count // BROADCAST_LIMIT))
    for piece in range(pieces):
        some = stored.filter((F.col("term") >= 0) & (F.pmod("term", F.lit(pieces)) == piece)).toArrow()
        for part in some.to_batches():
            firsts = part.column("first").to_numpy()
            for first in np.unique(firsts).tolist():
                mine = part.filter(pa.array(firsts == first))
                z = _matrix(mine.column("z"))
                table[mine.column("term").to_numpy(), first : first + z.shape[1]] = z
    return table


def _signs(products: DataFrame | np.ndarray, turn: np.ndarray) -> np.ndarray:
    """For each singular vector (a column of z x ``turn``) the sign of its largest entry; of equal ones that of the smaller term."""
    schema = ["component", "size", "sign", "term"]

    def largest(z: np.ndarray, terms: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
        entries = z @ turn
        at = np.abs(entries).argmax(axis=0)
        top = entries[at, np.arange(entries.shape[1])]
        columns = [np.arange(len(top), dtype=np.int32), np.round(np.abs(top), 9), np.sign(top), terms[at].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=schema)

    signs = np.ones(turn.shape[1])
    if isinstance(products, DataFrame):
        shared = products.sparkSession.sparkContext.broadcast(turn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield largest(_matrix(batch.column("z")), batch.column("term").to_numpy(), shared.value)

        found = products.mapInArrow(run, "component int, size double, sign double, term int")
        found = found.groupBy("component").agg(F.max_by("sign", F.struct("size", -F.col("term"))).alias("sign"))
        for r in found.collect():
            signs[r["component"]] = r["sign"] or 1.0
        return signs
    best = np.full(len(signs), -1.0)
    for start in range(0, len(products), 1024):
        found = largest(products[start : start + 1024], np.arange(start, min(start + 1024, len(products))), turn)
        more = found.column("size").to_numpy() > best
        best[more], signs[more] = found.column("size").to_numpy()[more], found.column("sign").to_numpy()[more]
    return np.where(signs == 0, 1.0, signs)


def _multiplied(rows: DataFrame, products: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``sketch`` = A z, the products by term taken in pieces that one broadcast holds."""
    n = products.count()
    pieces = max(1, -(-n * count * 8 // min(_HELD_BYTES, BROADCAST_LIMIT)))
    result = rows.withColumn("sketch", F.array_repeat(F.lit(0.0), count))
    for piece in range(pieces):
        some = products.filter(F.pmod("term", F.lit(pieces)) == piece).orderBy("term").toArrow()
        terms, z = some.column("term").to_numpy(), _matrix(some.column("z").combine_chunks())
        result = _added(result, terms, z)
    return result


def _added(rows: DataFrame, known: np.ndarray, z: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((known, z))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table = shared.value
        for batch in batches:
            for start, n, terms, dense in _chunks(batch):
                part = batch.slice(start, n)
                place = np.minimum(np.searchsorted(ids, terms), max(0, len(ids) - 1))
                here = ids[place] == terms if len(ids) else np.zeros(len(terms), bool)
                total = _matrix(part.column("sketch")) + (dense[:, here] @ table[place[here]] if here.any() else 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("doc_id", "terms", "weights")), _lists(total, pa.float64())], names=["doc_id", "terms", "weights", "sketch"])

    return rows.mapInArrow(run, "doc_id bigint, terms array<int>, weights array<double>, sketch array<double>")
