"""Products of every row with the one of the next number, without moving the rows.

Rows that are stored in the order of their numbers stand beside their successors.  Tasks multiply neighbours as they
stream by; only rows at the ends of such a run, whose successor may be in another task, meet it in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.bitmap import only_listed
from nearfield.session import materialize, ship_package

# Rows of dense vectors that are multiplied at a time.
_STEP = 1024
# Descents a row from which rows count as out of order.
_DESCENTS = 0.01
_FOUND = "doc_id bigint, own double, other double, size double, first boolean, terms array<int>, weights array<double>"


def numbered(documents: DataFrame) -> bool:
    """Whether every row has a number of its own."""
    return documents.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()


def in_order(documents: DataFrame) -> DataFrame:
    """``documents`` in the order of ``doc_id``: as they are where their tasks read them so, dealt out by ranges otherwise."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("doc_id").drop_null().to_numpy()
                ids = ids if last is None else np.append(last, ids)
                last = ids[-1:]
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([int((ids[1:] < ids[:-1]).sum())])], names=["n", "descents"])

    found = documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(count, "n bigint, descents bigint")
    seen = found.agg(F.sum("n").alias("n"), F.sum("descents").alias("descents")).first()
    ordered = (seen["descents"] or 0) <= _DESCENTS * (seen["n"] or 0)
    return documents if ordered else documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")


class _Line:
    """Rows as they stream by: what is known of a row goes out once its successor cannot be the next one."""

    def __init__(self) -> None:
        self.before: int | None = None

    def batch(self, ids: np.ndarray, own: np.ndarray, beside: np.ndarray, out: int, lists) -> pa.RecordBatch:
        """The first ``out`` of the rows; ``beside``: the products of each of them with the next, as far as there is one."""
        follows = np.append(ids[1:] == ids[:-1] + 1, False)[:out]
        place = np.minimum(np.arange(out) + 1, len(ids) - 1)
        first = np.append(ids[:1] - 1 != self.before if self.before is not None else [True], ids[1:] != ids[:-1] + 1)[:out]
        self.before = int(ids[out - 1])
        ends = first | ~follows
        terms, weights = lists(ends)
        other = pa.array(np.append(beside, np.zeros(len(ids)))[:out], mask=~follows)
        columns = [pa.array(ids[:out]), pa.array(own[:out]), other, pa.array(own[place], mask=~follows), pa.array(first), pa.array(terms, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "own", "other", "size", "first", "terms", "weights"])


def dense_products(rows: DataFrame) -> DataFrame:
    """``doc_id, own, other, size`` of ``doc_id, embedding``: products of a row with itself, with its successor, of that with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, ids, held = _Line(), np.empty(0, np.int64), None

        def found(out: int) -> pa.RecordBatch:
            lists = lambda ends: ([None] * out, [held[i] if end else None for i, end in enumerate(ends)])
            return line.batch(ids, np.einsum("ij,ij->i", held, held), np.einsum("ij,ij->i", held[:-1], held[1:]), out, lists)

        for batch in batches:
            for start in range(0, batch.num_rows, _STEP):
                part = batch.slice(start, _STEP)
                vectors = part.column("embedding").flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64)
                ids, held = np.append(ids, part.column("doc_id").to_numpy()), vectors if held is None else np.concatenate([held, vectors])
                if len(ids) > 1:
                    yield found(len(ids) - 1)
                ids, held = ids[-1:], held[-1:]
        if len(ids):
            yield found(1)

    return _joined(rows, run)


def sparse_products(rows: DataFrame) -> DataFrame:
    """As :func:`dense_products` of ``doc_id, term_id, weight``, where the entries of a row come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, entries = _Line(), [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

        def found(kept: int) -> Iterator[pa.RecordBatch]:
            """All rows but the last ``kept``, whose entries stay."""
            ids, terms, weights = entries
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
            out = len(starts) - kept
            if out < 1:
                return
            ends = np.append(starts[1:], len(ids))
            owner = np.repeat(np.arange(len(starts)), ends - starts)
            width = int(terms.max()) + 1
            order = np.argsort(owner * width + terms, kind="stable")
            key, weight = (owner * width + terms)[order], weights[order]
            place = np.minimum(np.searchsorted(key, key - width), len(key) - 1)
            both = np.flatnonzero(key[place] == key - width)
            beside = np.bincount(key[both] // width - 1, weight[place[both]] * weight[both], len(starts))
            own = np.bincount(owner, weights * weights, len(starts))
            cut = lambda values, open_: [values[a:b] if end else None for a, b, end in zip(starts, ends, open_)]
            yield line.batch(ids[starts], own, beside, out, lambda open_: (cut(terms, open_), cut(weights, open_)))
            entries[:] = [x[ends[out - 1] :] for x in entries]

        for batch in batches:
            new = (batch.column(x).to_numpy() for x in ("doc_id", "term_id", "weight"))
            entries[:] = [np.concatenate([a, b]) for a, b in zip(entries, new)]
            # More entries of the last row may come, and the one before is not multiplied with all of them yet.
            yield from found(2)
        yield from found(0)

    return _joined(rows, run)


def _product(a: dict, b: dict) -> float:
    if a["terms"] is None:
        return float(np.dot(a["weights"], b["weights"]))
    known = dict(zip(a["terms"], a["weights"]))
    return float(sum(known.get(term, 0.0) * weight for term, weight in zip(b["terms"], b["weights"])))


def _joined(rows: DataFrame, run) -> DataFrame:
    ship_package(rows.sparkSession)
    found = materialize(rows.mapInArrow(run, _FOUND), "successors")
    row = F.struct("terms", "weights")
    ends = found.filter(F.col("other").isNull()).select("doc_id", row.alias("row"))
    firsts = found.filter("first").select((F.col("doc_id") - 1).alias("doc_id"), row.alias("next"), F.col("own").alias("size"))
    met = only_listed(ends, "doc_id", firsts.select("doc_id")).join(only_listed(firsts, "doc_id", ends.select("doc_id")), "doc_id")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _STEP):
                part = batch.slice(start, _STEP)
                pairs = zip(part.column("row").to_pylist(), part.column("next").to_pylist())
                columns = [part.column("doc_id"), pa.array([_product(a, b) for a, b in pairs], pa.float64()), part.column("size")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "met", "met_size"])

    met = met.select("doc_id", "row", "next", "size").mapInArrow(multiply, "doc_id bigint, met double, met_size double")
    return found.join(met, "doc_id", "left").select("doc_id", "own", F.coalesce("other", "met").alias("other"), F.coalesce("size", "met_size").alias("size"))
