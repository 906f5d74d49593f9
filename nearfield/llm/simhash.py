"""Near duplicates by SimHash: an index of positional bytes with count filtering.

A fingerprint has eight bytes.  Two that differ in at most three bits share at
least five of them at their places.  The places fall into fourteen blocks of
four whose numbers have the exclusive-or zero; any three places lie within one such
block and its complement is one too, so two linked fingerprints agree on all
four bytes of some block.  The index posts every distinct fingerprint under the
bytes of each block.  Within a posting the shared positional bytes of a pair
are tallied, pairs with five or more stay, and their differing bits are
counted.  A posting gives the links that join its members, not all pairs.

Postings above ``scan_limit`` members are posted anew under a fifth shared
byte, and those still above it under six of the remaining 24 bits (one of the
four groups of six is equal when three bits differ); then at most 2**18
different fingerprints can meet, so no task holds an unbounded group and
nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import components, in_arrow, raw, slices, texts_of
from nearfield.session import materialize

SEED = 42
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
OTHERS = [[p for p in range(8) if p not in block] for block in BLOCKS]


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority of the bits of the hashes of all ``width``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    w = min(width, len(words))
    counts, n = np.zeros(64, np.int64), len(words) - w + 1
    for at in range(0, n, 16384):
        to = min(n, at + 16384)
        spans = map(slice, starts[at:to].tolist(), ends[at + w - 1 : to + w - 1].tolist())
        digests = b"".join(map(xxhash.xxh64_digest, map(line.__getitem__, spans), repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = np.array([fingerprint(x, width) for x in raw(part.column("text"))], np.uint64).view(np.int64)
                kept = [x for x in part.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(prints)], [*kept, "print"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, print bigint) of every whole text; a null or wordless text has print 0."""
    return in_arrow(texts_of(docs), _fingerprints(width), "doc_id bigint, print bigint")


def links(members: np.ndarray, most: int, least_bytes: int) -> list[tuple[int, int]]:
    """Links that join the members (distinct fingerprints) as all their pairs would.

    Breadth first: a member is compared with those not reached yet, so a dense
    group takes few comparisons and gives one link per member.
    """
    rest, found = members, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            parent = np.zeros(len(rest), np.uint64)
            step = max(1, 1 << 18 >> (len(rest).bit_length()))
            for at in range(0, len(front), step):
                open_ = np.flatnonzero(~reached)
                if not len(open_):
                    break
                some = front[at : at + step]
                differing = some[:, None] ^ rest[open_][None, :]
                tally = (differing.view(np.uint8).reshape(len(some), len(open_), 8) == 0).sum(axis=2, dtype=np.uint8)
                i, j = np.nonzero(tally >= least_bytes)
                near = np.bitwise_count(differing[i, j]) <= most
                parent[open_[j[near]]] = some[i[near]]
                reached[open_[j[near]]] = True
            found += zip(parent[reached].tolist(), rest[reached].tolist())
            front, rest = rest[reached], rest[~reached]
    return found


def _links(most: int, least_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            values = lists.values.to_numpy().view(np.uint64)
            offsets = lists.offsets.to_numpy()
            pairs = [p for a, b in zip(offsets[:-1], offsets[1:]) for p in links(values[a:b], most, least_bytes)]
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return run


def _byte(place: str) -> str:
    return f"(shiftrightunsigned(print, 8 * ({place})) & 255L)"


def _literal(lists: list[list[int]]) -> str:
    return "array(" + ", ".join("array(" + ", ".join(map(str, x)) + ")" for x in lists) + ")"


def _block_keys() -> Column:
    keys = [" | ".join([f"({n}L << 32)", *(f"({_byte(str(p))} << {8 * i})" for i, p in enumerate(block))]) for n, block in enumerate(BLOCKS)]
    return F.expr(f"explode(array({', '.join(keys)}))")


def similar_pairs(prints: DataFrame, most: int = 3, scan_limit: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``print``) with up to three differing bits.

    The links have the same connected components as all such pairs.
    """
    if not 0 <= most <= 3:
        raise ValueError("the index guarantees shared blocks for 0 to 3 differing bits")
    posted = prints.select("print", _block_keys().alias("k1")).withColumn("k2", F.lit(0)).withColumn("k3", F.lit(0))
    keys = ["k1", "k2", "k3"]
    rest = [[*(p for p in others if p != q)] if q in others else [0, 0, 0] for others in OTHERS for q in range(8)]
    finer = [
        ("k2", f"explode(transform(element_at({_literal(OTHERS)}, int(shiftright(k1, 32)) + 1), p -> 1 + 256 * p + int({_byte('p')})))"),
        ("k3", f"explode(transform(sequence(0, 3), i -> 1 + 64 * i + int(shiftright(aggregate(element_at({_literal(rest)}, int(shiftright(k1, 32) * 8 + ((k2 - 1) div 256)) + 1), 0L, (v, p) -> (v << 8) | {_byte('p')}), 6 * i) & 63)))"),
    ]
    parts = []
    for level in range(3):
        small = posted
        if level < 2:
            hot = materialize(posted.groupBy(*keys).count().where(F.col("count") > scan_limit).select(*keys), "hot")
            if not hot.isEmpty():
                small = posted.join(hot, keys, "left_anti")
                name, refined = finer[level]
                posted = posted.join(hot, keys, "left_semi").withColumn(name, F.expr(refined))
            else:
                posted = None
        groups = small.groupBy(*keys).agg(F.collect_list("print").alias("members")).where(F.size("members") > 1)
        parts.append(in_arrow(groups.select("members"), _links(most, 8 - most), "a bigint, b bigint"))
        if posted is None:
            break
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.union(more)
    return pairs


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, scan_limit: int = 4096) -> DataFrame:
    """(doc_id, print, component_id): one row per document.

    ``component_id`` is the smallest doc_id that links of up to ``most``
    differing bits reach.  Wordless and null texts share print 0 and are linked
    like any others; rows with equal texts have equal prints; a null doc_id
    never names a component unless it is alone.  Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    found = components(similar_pairs(firsts.select("print"), most, scan_limit)).withColumnRenamed("node", "print")
    groups = found.join(firsts, "print")
    lowest = groups.groupBy("root").agg(F.min("first").alias("lowest"))
    named = groups.join(lowest, "root").select("print", "lowest")
    # A written table, so that the join below has plain shuffles on both sides and a print that
    # a large group of copies shares can be split.
    labels = firsts.join(named, "print", "left").select("print", F.coalesce("lowest", "first").alias("component_id"))
    return prints.join(materialize(labels, "groups"), "print").select("doc_id", "print", "component_id")


def keep_first(docs: DataFrame, width: int = 3, most: int = 3, scan_limit: int = 4096) -> DataFrame:
    """``docs`` without near duplicates: of each group exactly one row stays, whatever its doc_id.

    It is the row with the smallest doc_id (null after all others), then with the smallest hash
    of its text; of rows equal in both one stays.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = in_arrow(texts_of(docs).withColumn("mark", mark), _fingerprints(width), "doc_id bigint, mark bigint, print bigint")
    prints = materialize(marked, "prints")
    # A null doc_id is ranked by its own field, as a null is the smallest value of a struct.
    firsts = prints.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    firsts = materialize(firsts, "firsts")
    found = components(similar_pairs(firsts.select("print"), most, scan_limit)).withColumnRenamed("node", "print")
    groups = firsts.join(found, "print", "left").groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("first").alias("first"))
    chosen = groups.select(F.col("first.doc_id").alias("_kept_id"), F.col("first.mark").alias("_kept_mark"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_kept_id")) & (F.col("_mark") == F.col("_kept_mark"))
    kept = docs.withColumn("_mark", mark).join(materialize(chosen, "chosen"), same, "left_semi")
    return kept.dropDuplicates(["doc_id", "_mark"]).drop("_mark")
