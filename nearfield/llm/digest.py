"""Document fingerprints by quartile buckets.

A triplet starts at every byte of a text (from the end it goes on at the beginning); triplets are
hashed into 512 buckets and counted.  The quartiles of the counts turn each bucket into two bits (how many
quartiles its count exceeds); a logarithmic length code and the ratios of the quartiles
stand before them.  Two digests differ by the sum of their bucket differences, a full three counting
six, plus the header's differences; likeness is one minus that score over its bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import in_arrow, raw, texts_of
from nearfield.session import ship_package

BUCKETS = 512
# Places of a triplet's second and third byte.  Bytes that far apart hardly depend on each other, so the counts
# tell documents of one language apart; neighbouring bytes mostly tell the language.
SPREAD = (6, 13)
# Mean difference per bucket of two unrelated texts; the score is cut there.
BOUND = 1.4


def digest(text: bytes) -> str:
    """Hexadecimal digest of the whole text: length code, quartile ratios, two bits per bucket."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    triplets = (data << np.uint32(16)) | (np.roll(data, -SPREAD[0]) << np.uint32(8)) | np.roll(data, -SPREAD[1])
    hashed = triplets * np.uint32(0x9E3779B1)
    hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(hashed, minlength=BUCKETS)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, int(10 * np.log(len(text) + 1)))
    low, mid, high = (int(x) for x in quartiles)
    ratios = (15 * low // high if high else 0) << 4 | (15 * mid // high if high else 0)
    return bytes([length, ratios]).hex() + packed.tobytes().hex()


_COST = np.array([0, 1, 2, 6])


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at the bound of the difference score."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    score = abs(int(x[0]) - int(y[0])) / 2
    score += sum(abs(int(x[1] >> s & 15) - int(y[1] >> s & 15)) for s in (0, 4)) / 2
    for shift in (0, 2, 4, 6):
        apart = np.abs((x[2:] >> shift & 3).astype(np.int64) - (y[2:] >> shift & 3))
        score += int(_COST[apart].sum())
    return 1.0 - min(1.0, score / (BOUND * BUCKETS))


def _row(doc_id, text: bytes, mark: str, following: bytes, next_mark: str) -> tuple:
    whole, nxt = text.decode("utf-8", "replace"), following
    cut = len(whole) // 4
    # As many code points of the next text; a code point has at most four bytes.
    head = nxt[: 4 * cut + 4].decode("utf-8", "ignore")[:cut]
    edited = (whole[: len(whole) - cut] + head).encode("utf-8")
    edited_mark = mark if edited == text else digest(edited)
    return doc_id, len(whole), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in ranges, each in order and followed by the first row of the next range (``ahead``)."""
    held = None
    for batch in batches:
        rows: list[tuple] = []
        for number, doc_id, ahead, text in zip(
            batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ahead").to_pylist(), raw(batch.column("text"))
        ):
            mark = digest(text)
            if held and held[0] == number:
                rows.append(_row(*held[1:], text, mark))
            held = None if ahead else (number, doc_id, text, mark)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, _TYPES)], _NAMES)


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_FIRST = -(1 << 63)


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text ends in the beginning of the next document by doc_id (null
    first, rows of one doc_id by text hash; after the last comes the first).  A
    null text is empty; an only row is its own successor; extra columns are ignored.

    Texts move once, into ranges of doc_id (four for each shuffle partition); a range also gets
    the first row of the next one, so that no task needs another's rows.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs).withColumn("id", F.coalesce("doc_id", F.lit(_FIRST)))
    cuts = rows.select(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    ship_package(spark)
    rows = rows.withColumns({"range": place("id"), "hash": F.xxhash64("text"), "ahead": F.lit(False)})
    # One row for each range, so at most n.
    heads = rows.groupBy("range").agg(F.min(F.struct("id", "hash")).alias("head")).collect()
    heads = sorted((r["range"], r["head"]["id"], r["head"]["hash"]) for r in heads)
    names = ["range", "id", "hash", "ahead", "doc_id", "text"]
    dealt = rows.select(names)
    if heads:
        # The first row of a range also goes to the range before it; that of the first range to the last.
        copies = spark.createDataFrame([(heads[i - 1][0], a, b) for i, (_, a, b) in enumerate(heads)], "to int, id bigint, hash bigint")
        ahead = rows.join(F.broadcast(copies), ["id", "hash"]).withColumns({"range": F.col("to"), "ahead": F.lit(True)})
        dealt = dealt.union(ahead.select(names))
    dealt = dealt.repartition("range").sortWithinPartitions("range", "ahead", "id", "hash")
    return in_arrow(dealt.select("range", "doc_id", "ahead", "text"), _compared, _RESULT)
