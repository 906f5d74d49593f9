"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts whose SimHash fingerprints the index of :mod:`simhash` links are candidates.  Those 64 bits hold too little of
a similarity of 0.8, where some ten of them differ, so the byte-position index also runs over a second fingerprint
of 64 bytes, each the last byte of the least of a text's shingle hashes under one of 64 scramblings.  Two texts
agree at a place as often as their shingle sets do.  Every different text is posted under sixteen blocks
of four positional bytes; the shared positional bytes of two members of a posting are tallied, and
pairs below ``LEAST_BYTES`` of 64 are dropped.  At a similarity of 0.8, two
texts meet in some posting with probability 0.9998 and fall below the tally with less than 1e-6.

The pairs that stay join texts to candidate groups.  A group is cut into blocks of bounded size, any
two blocks meet in one task, and pairs not joined yet that pass the tally or that SimHash links are verified on
their whole shingle sets; only links that join something are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import simhash
from nearfield.llm.common import components, in_arrow, mixed, raw, slices
from nearfield.operators.bitmap import only_listed, with_listed
from nearfield.session import materialize

WIDTH, SIMILARITY = 5, 0.8
PLACES, BLOCK = 64, 4
LEAST_BYTES = 36
# Differing bits of two linked SimHash fingerprints.
MOST_BITS = 3
# Members of a posting that one task compares; texts and bytes of texts of a block.
SCAN_LIMIT = 4096
BLOCK_ROWS = 512
BLOCK_BYTES = 8 << 20

_SEEDS = mixed(np.arange(1, PLACES + 1, dtype=np.uint64))


def line_of(text: bytes) -> bytes:
    """Lower-cased words, joined by one space."""
    return b" ".join(text.lower().split())


def shingles(line: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted different hashes of all runs of ``width`` words; of fewer words, the whole line."""
    if not line:
        return np.empty(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(line))
    w = min(width, len(starts))
    spans = map(slice, starts[: len(starts) - w + 1].tolist(), ends[w - 1 :].tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, spans), repeat(0)), np.uint64, len(starts) - w + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """A byte for each place."""
    least = np.full(PLACES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, mixed(hashes[at : at + 2048, None] ^ _SEEDS[None, :]).min(axis=0))
    return least.astype(np.uint8)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of different hashes; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lines = [line_of(x) for x in raw(part.column("text"))]
                ids = [xxhash.xxh128_digest(x) for x in lines]
                prints = [signature(shingles(x, width)).tobytes() for x in lines]
                bits = np.array([simhash.fingerprint(x) for x in lines], np.uint64).view(np.int64)
                columns = [part.column("doc_id"), part.column("mark"), pa.array(ids, pa.binary()), pa.array(prints, pa.binary()), pa.array(bits), pa.array(map(len, lines), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "id", "print", "bits", "bytes"])

    return run


def _tally(members: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many positional bytes each member shares with each of the others."""
    total = np.zeros((len(members), len(others)), np.uint8)
    for place in range(PLACES):
        total += members[:, place, None] == others[None, :, place]
    return total


def tree(members: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs of places that join the members as all pairs of ``least`` shared bytes would."""
    rest, found = np.arange(1, len(members)), []
    front = np.zeros(1, np.int64)
    while True:
        reached = np.zeros(len(rest), bool)
        step = max(1, (1 << 22) // max(1, len(rest)))
        for at in range(0, len(front), step):
            open_ = np.flatnonzero(~reached)
            if not len(open_):
                break
            some = front[at : at + step]
            near = _tally(members[some], members[rest[open_]]) >= least
            hit = near.any(axis=0)
            found += zip(some[near[:, hit].argmax(axis=0)].tolist(), rest[open_[hit]].tolist())
            reached[open_[hit]] = True
        front, rest = rest[reached], rest[~reached]
        if not len(rest):
            return found
        if not len(front):
            front, rest = rest[:1], rest[1:]


def _join_postings(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat, offsets = lists.values, lists.offsets.to_numpy()
            ids = flat.field("id").to_pylist()
            prints = np.frombuffer(b"".join(flat.field("print").to_pylist()), np.uint8).reshape(-1, PLACES)
            pairs = [(ids[a + i], ids[a + j]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for i, j in tree(prints[a:b], least)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([x for _, x in pairs], pa.binary())], ["a", "b"])

    return run


def candidate_links(texts: DataFrame, scan_limit: int = SCAN_LIMIT, least: int = LEAST_BYTES) -> DataFrame:
    """(a, b): links between different texts (``id, print``) that share a posting and enough positional bytes.

    A posting above ``scan_limit`` is posted anew under one more block, and again under a third; members of
    one that is still larger agree in twelve bytes and are joined without a tally.
    """
    n = PLACES // BLOCK
    block = lambda i: f"substring(print, {BLOCK} * ({i}) + 1, {BLOCK})"
    posted = texts.select("id", "print", F.expr(f"explode(transform(sequence(0, {n - 1}), i -> concat(cast(char(i) AS binary), {block('i')})))").alias("key"))
    # The blocks of a key are in order, so a text is posted once under each set of blocks.
    finer = (
        f"explode(transform(filter(sequence(0, {n - 1}), i -> i != ascii(cast(substring(key, 1, 1) AS string))), "
        f"i -> if(i > ascii(cast(substring(key, 1, 1) AS string)), concat(key, cast(char(i) AS binary), {block('i')}), concat(cast(char(i) AS binary), {block('i')}, key))))"
    )
    found = None
    for level in range(3):
        sizes = posted.groupBy("key").agg(F.count("*").alias("n"))
        hot = materialize(sizes.where(F.col("n") > scan_limit).select("key"), "hot")
        some = not hot.isEmpty()
        small = posted.join(hot, "key", "left_anti") if some else posted
        groups = small.groupBy("key").agg(F.collect_list(F.struct("id", "print")).alias("members")).where(F.size("members") > 1)
        links = in_arrow(groups.select("members"), _join_postings(least), "a binary, b binary")
        found = links if found is None else found.union(links)
        if not some:
            return found
        posted = posted.join(hot, "key", "left_semi")
        if level < 2:
            posted = posted.withColumn("key", F.expr(finer))
    first = posted.groupBy("key").agg(F.min("id").alias("a"))
    return found.union(posted.join(first, "key").where("a != id").select("a", F.col("id").alias("b")))


def fingerprint_links(texts: DataFrame, scan_limit: int = SCAN_LIMIT, most: int = MOST_BITS) -> DataFrame:
    """(a, b): links between different texts (``id, bits``) that join them as all pairs of up to ``most`` differing bits would."""
    firsts = materialize(texts.groupBy("bits").agg(F.min("id").alias("first")), "firsts")
    near = simhash.similar_pairs(firsts.select(F.col("bits").alias("print")), most, scan_limit)
    for end in ("a", "b"):
        near = near.join(firsts.select(F.col("bits").alias(end), F.col("first").alias(f"first_{end}")), end)
    same = texts.join(firsts, "bits").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).union(same)


def _verify(width: int, similarity: float, least: int):
    def verify(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        prints = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint8).reshape(-1, PLACES)
        bits = table.column("bits").to_numpy()
        sets = [shingles(line_of(x), width) for x in raw(table.column("text"))]
        sizes = np.array([len(x) for x in sets])
        ids = table.column("id").to_pylist()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        group, whole = np.arange(len(ids)), table.column("blocks")[0].as_py() == 1
        pairs = []
        for i in left.tolist():
            others = right[right > i] if low == high else right
            shared = _tally(prints[i : i + 1], prints[others])[0]
            near = (shared >= least) | (np.bitwise_count((bits[i] ^ bits[others]).view(np.uint64)) <= MOST_BITS)
            fit = near & (np.minimum(sizes[i], sizes[others]) >= similarity * np.maximum(sizes[i], sizes[others]))
            others = others[fit]
            # The likeliest first; what is joined already needs no second look.
            for j in others[np.argsort(-shared[fit].astype(np.int64), kind="stable")].tolist():
                if group[i] != group[j] and jaccard(sets[i], sets[j]) >= similarity:
                    group[group == group[j]] = group[i]
                    pairs.append((ids[i], ids[j]))
        if whole:
            # Nothing outside this task can join these texts: name each by the least of its group.
            first: dict[int, bytes] = {}
            for g, x in sorted(zip(group.tolist(), ids)):
                first.setdefault(g, x)
            pairs = [(first[g], x) for g, x in zip(group.tolist(), ids) if (group == g).sum() > 1]
        columns = pa.array([x for x, _ in pairs], pa.binary()), pa.array([x for _, x in pairs], pa.binary()), pa.array([whole] * len(pairs), pa.bool_())
        return pa.table(dict(zip(("a", "b", "whole"), columns)))

    return verify


def verified_links(members: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, least: int = LEAST_BYTES, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, whole): links of at least ``similarity`` that join the texts of each candidate group as all its pairs would.

    Where ``whole`` is true, ``a`` is the least of all texts that links reach from ``b``, itself included.
    ``members``: ``root`` (the group), ``id``, ``print``, ``bits``, ``text``, ``bytes``.  A group with more rows or bytes
    than a block may hold is cut into blocks by hash, and every two of them meet in one task.
    """
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("int").alias("blocks"))
    cut = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "blocks", "id", "print", "bits", "text")
    return met.groupBy("root", "low", "high").applyInArrow(_verify(width, similarity, least), "a binary, b binary, whole boolean")


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, scan_limit: int = SCAN_LIMIT, block_rows: int = BLOCK_ROWS, least: int = LEAST_BYTES) -> DataFrame:
    """``docs`` without near copies: of each group exactly one row stays, whatever its doc_id.

    A group are the texts that links of at least ``similarity`` reach, with all their copies; it keeps the row with
    the smallest doc_id (null after all others), then the smallest hash of its text; of rows equal
    in both one stays.  Words are lower-cased (A-Z) and parted by ASCII white space; texts with equal words are
    copies, null and wordless ones are copies of each other.  All columns stay as they are; an empty table stays empty.
    """
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), mark.alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = materialize(in_arrow(rows, _sign(width), "doc_id bigint, mark bigint, id binary, print binary, bits bigint, bytes bigint"), "signed")
    # A null doc_id is ranked by its own field, as a null is the smallest value of a struct.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    texts = materialize(signed.groupBy("id").agg(first, F.first("print").alias("print"), F.first("bits").alias("bits"), F.first("bytes").alias("bytes")), "texts")

    candidates = candidate_links(texts.select("id", "print"), scan_limit, least).union(fingerprint_links(texts.select("id", "bits"), scan_limit))
    groups = components(candidates).withColumnRenamed("node", "id")
    members = materialize(groups.join(texts, "id").select("id", "root", "print", "bits", "bytes", "first.doc_id", "first.mark"), "members")
    # Texts are fetched for candidates only; of equal rows any one will do.
    wanted = only_listed(rows, "mark", members.select("mark")).withColumnRenamed("doc_id", "own")
    found = members.join(wanted.withColumnRenamed("mark", "own_mark"), F.expr("doc_id <=> own AND mark = own_mark")).dropDuplicates(["id"])
    links = materialize(verified_links(found.select("root", "id", "print", "bits", "text", "bytes"), width, similarity, least, block_rows), "links")
    linked = components(links.where("NOT whole").select("a", "b")).union(links.where("whole").select("b", "a"))

    kept = texts.join(linked.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.doc_id").alias("__kept_id"), F.col("first.mark").alias("__kept_mark")), "kept")
    # Rows that go, and rows equal to one that stays, are few: only what may be one of them is shuffled.
    same = signed.groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
    same = same.join(kept, F.expr("doc_id <=> __kept_id AND mark = __kept_mark"), "left")
    doubtful = materialize(same.where("__kept_mark IS NULL OR times > 1").select("mark"), "doubtful")
    marked = with_listed(docs.withColumn("__mark", mark), "__mark", doubtful, "__listed")
    sure = marked.where("NOT __listed").drop("__mark", "__listed")
    chosen = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__kept_id")) & (F.col("__mark") == F.col("__kept_mark"))
    rest = marked.where("__listed").join(kept, chosen, "left_semi").dropDuplicates(["doc_id", "__mark"])
    return sure.unionByName(rest.drop("__mark", "__listed"))
