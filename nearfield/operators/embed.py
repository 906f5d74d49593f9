"""Text to vectors: TF-IDF over a bounded vocabulary, reduced by SVD."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearfield.operators.widesvd import svd_embed_wide
from nearfield.session import discard, hand_back, materialize, parallelism, ship_package

# Bytes of text, or entries of word lists, that one Python step holds at a time (or one row): a word is an
# object of its own there, many times the size of its letters.
SLICE_BYTES = 2 << 20
SLICE_ENTRIES = 1 << 18


def _runs(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` whose ``sizes`` add up to ``most`` at most, or one row."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 8
    if start < batch.num_rows:
        yield batch.slice(start)



def term_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, terms, times``: the different words of every document and how often it has each.

    Words are runs between ASCII white space, in lower case.  Texts are split once, row by
    row, and nothing is shuffled; store the result where it is used more than once.
    """
    ship_package(documents.sparkSession)
    listed = documents.select("doc_id", F.lower("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch, pc.binary_length(batch.column("text")), SLICE_BYTES):
                counted = [Counter((x or b"").split()) for x in part.column("text").cast(pa.binary()).to_pylist()]
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in counted])).astype(np.int32))
                terms = pa.array([t for x in counted for t in x], pa.binary()).cast(pa.string())
                times = pa.array([n for x in counted for n in x.values()], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (terms, times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "terms", "times"])
        hand_back()

    schema = StructType([listed.schema["doc_id"], *StructType.fromDDL("terms array<string>, times array<int>").fields])
    return listed.mapInArrow(count, schema)


def _counted(documents: DataFrame) -> DataFrame:
    return term_counts(documents) if "text" in documents.columns else documents


def vocabulary(documents: DataFrame, max_features: int = 1024, min_df: int = 2) -> DataFrame:
    """``term, term_id, df, total, idf`` of the most frequent terms (ties by term).

    ``documents``: the texts, or their :func:`term_counts`.
    """
    counts = _counted(documents)
    both = counts.select(F.inline(F.arrays_zip("terms", "times")).alias("term", "times"))
    counted = both.groupBy("term").agg(F.count("*").alias("df"), F.sum("times").alias("total"))
    n_documents = documents.select(F.count("*")).scalar()
    kept = counted.filter(F.col("df") >= min_df).orderBy(F.col("total").desc(), "term").limit(max_features)
    # At most max_features rows from here on.
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("order"), "term", "df")))
    rows = kept.agg(ordered.alias("terms")).select(F.posexplode("terms").alias("term_id", "t"))
    idf = F.log((n_documents + 1) / (F.col("t.df") + 1))
    return rows.select(
        F.col("t.term").alias("term"), "term_id", F.col("t.df").alias("df"), (-F.col("t.order")).alias("total"), idf.alias("idf")
    )


def tfidf(documents: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, term_id, tf, weight`` of every row of ``documents`` (texts or :func:`term_counts`); no shuffle.

    ``vocab`` holds at most the vocabulary size of rows, so it is broadcast.
    """
    tokens = _counted(documents).select("doc_id", F.inline(F.arrays_zip("terms", "times")).alias("term", "times"))
    known = tokens.join(F.broadcast(vocab.select("term", "term_id", "idf")), "term")
    return known.select("doc_id", "term_id", F.col("times").cast("bigint").alias("tf"), (F.col("times") * F.col("idf")).alias("weight"))


def sparse_rows(documents: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, terms, weights`` by term number, one row per document, also those without any vocabulary word."""
    counts = _counted(documents)
    # At most the vocabulary size of rows.
    found = vocab.select("term", "term_id", "idf").collect()
    shared = counts.sparkSession.sparkContext.broadcast(({r["term"].encode(): r["term_id"] for r in found}, np.array([r["idf"] for r in sorted(found, key=lambda r: r["term_id"])])))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, idf = shared.value
        for batch in batches:
            for part in _runs(batch, batch.column("terms").value_lengths(), SLICE_ENTRIES):
                listed = part.column("terms")
                sizes = np.diff(listed.offsets.to_numpy())
                flat = listed.flatten().cast(pa.binary()).to_pylist()
                place = np.fromiter((numbers.get(x, -1) for x in flat), np.int64, len(flat))
                times = part.column("times").flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), sizes)
                known = np.flatnonzero(place >= 0)
                known = known[np.lexsort((place[known], owner[known]))]
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner[known], minlength=part.num_rows))).astype(np.int32))
                terms, weights = place[known].astype(np.int32), times[known] * idf[place[known]] if len(idf) else np.empty(0)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (terms, weights)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "terms", "weights"])
        hand_back()

    schema = StructType([counts.schema["doc_id"], *StructType.fromDDL("terms array<int>, weights array<double>").fields])
    return counts.mapInArrow(weigh, schema)


def _dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    matrix = np.zeros((batch.num_rows, width))
    terms, weights = batch.column("terms"), batch.column("weights")
    sizes = np.nan_to_num(terms.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    owner = np.repeat(np.arange(batch.num_rows), sizes)
    matrix[owner, terms.flatten().to_numpy(zero_copy_only=False)] = weights.flatten().to_numpy(zero_copy_only=False)
    return matrix


def gram_matrix(rows: DataFrame, width: int) -> np.ndarray:
    """``X'X`` (width x width): partial products per task, summed on the executors."""
    ship_package(rows.sparkSession)
    slots = parallelism(rows.sparkSession)
    schema = "i int, cells array<double>"

    def emit(numbers: list[int], cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(numbers), 256):
            part = slice(start, start + 256)
            values = pa.ListArray.from_arrays(np.arange(len(cells[part]) + 1, dtype=np.int32) * width, np.concatenate(cells[part]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[part], pa.int32()), values], names=["i", "cells"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                dense = _dense(batch.slice(start, 2048), width)
                product = dense.T @ dense
                total = product if total is None else total + product
        if total is not None:
            yield from emit(list(range(width)), list(total))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column("cells").flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, row in zip(batch.column("i").to_pylist(), cells):
                sums[i] = sums[i] + row if i in sums else row.copy()
        yield from emit(list(sums), list(sums.values()))

    partials = rows.select("terms", "weights").coalesce(slots).mapInArrow(partial, schema)
    summed = partials.repartition(min(slots, width), "i").mapInArrow(add, schema)
    result = np.zeros((width, width))
    for row in summed.toLocalIterator():
        result[row["i"]] = row["cells"]
    return result


def svd_embed(rows: DataFrame, width: int, components: int = 512) -> DataFrame:
    """``doc_id, embedding``: rows projected on the leading right singular vectors.

    The width x width Gram matrix is decomposed on the driver; its size is set
    by the vocabulary, not by the data.  The largest entry of every singular
    vector is made positive.  Components beyond the rank of the matrix are zero, so
    that embeddings always have ``components`` entries.
    """
    values, vectors = np.linalg.eigh(gram_matrix(rows, width))
    order = np.argsort(-values, kind="stable")
    rank = int((values > max(values.max(), 0.0) * 1e-10).sum())
    order = order[: min(components, rank)]
    basis = np.zeros((width, components))
    basis[:, : len(order)] = vectors[:, order]
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(components)])
    shared = rows.sparkSession.sparkContext.broadcast(basis * np.where(signs == 0, 1.0, signs))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                vectors = (_dense(part, width) @ shared.value).astype(np.float32)
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * vectors.shape[1]
                embedding = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), embedding], names=["doc_id", "embedding"])
        hand_back()

    return rows.mapInArrow(project, "doc_id bigint, embedding array<float>")


def tfidf_svd_wide(
    documents: DataFrame, max_features: int = 16384, components: int = 512, min_df: int = 2, oversample: int = 10, power: int = 1
) -> DataFrame:
    """:func:`tfidf_svd` for wide vocabularies, see :mod:`widesvd`."""
    counts = materialize(term_counts(documents), "counts")
    rows = materialize(sparse_rows(counts, vocabulary(counts, max_features, min_df)), "tfidf")
    discard(counts)
    return svd_embed_wide(rows, components, oversample, power)


def tfidf_svd(documents: DataFrame, max_features: int = 1024, components: int = 512, min_df: int = 2) -> DataFrame:
    """``doc_id, embedding`` of every document.

    Word counts and sparse rows are each read twice, so they are written to the shared folder once.
    """
    counts = materialize(term_counts(documents), "counts")
    rows = materialize(sparse_rows(counts, vocabulary(counts, max_features, min_df)), "tfidf")
    return svd_embed(rows, max_features, components)
