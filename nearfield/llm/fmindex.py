"""Benchmark decontamination by full-text (FM) indexes of training shards.

Each slice of documents that a task holds is a shard with an index of its own: suffix order of
its words, Burrows-Wheeler transform, a wavelet matrix for ranks, and text positions
sampled along the text.  The benchmark's word windows are searched backwards, all at
once; the occurrences are located by walking to a sampled position, mapped to
documents, and merged to spans.

Words that no benchmark item holds cannot be part of a match: a run of them is one separator
in the shard's text, and so is a run of benchmark words shorter than the
shortest window.  The benchmark is a stated query set: it is sent to the tasks in blocks of
at most ``block_bytes`` of text, each block one more pass of the same rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import in_arrow, ragged, raw, slices

WINDOW = 10
BLOCK_BYTES = 16 << 20
SAMPLE = 16
# Digits, letters (A-Z become a-z) and all bytes of non-ASCII characters are word bytes.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Bits:
    """A bit vector with ranks in constant time: 64-bit blocks and counts before them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        low = self.blocks[block] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet matrix of a sequence of small integers."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level) & 1 == 1
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its position."""
        low, i = np.zeros_like(i), i
        for level, bits, zeros in self.levels:
            one = (symbols >> level) & 1 == 1
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def at(self, i: np.ndarray) -> np.ndarray:
        found = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one, ones = bits.at(i), bits.rank(i)
            found |= one.astype(np.int64) << level
            i = np.where(one, zeros + ones, i - ones)
        return found


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; each separator (0) is smaller than all words and unlike the others."""
    n = len(text)
    gaps = np.flatnonzero(text == 0)
    rank = text + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    step = 1
    while True:
        key = rank * np.int64(n + len(gaps) + int(text.max(initial=0)) + 2)
        key[: max(0, n - step)] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        change = np.append(0, np.cumsum(np.diff(key[order]) != 0)) if n else order
        rank = np.empty(n, np.int64)
        rank[order] = change
        if not n or change[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of a word-id sequence whose runs end with the separator 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_order(text)
        before = text[order - 1]
        top = int(text.max(initial=0))
        self.wavelet = Wavelet(before, max(1, top.bit_length()))
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))
        # Run starts are sampled too, so that no walk crosses a separator.
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.places, self.top, self.n = Bits(kept), order[kept], top, len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of the suffixes that begin with each phrase (rows of word ids)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        high[(phrases > self.top).any(axis=1)] = 0
        for word in phrases.T[::-1]:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = word[live]
            low[live], high[live] = (self.first[c] + self.wavelet.rank(c, x[live]) for x in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows that begin with a word."""
        found, open_, row = np.empty_like(rows), np.arange(len(rows)), rows
        steps = 0
        while len(open_):
            there = self.kept.at(row)
            found[open_[there]] = self.places[self.kept.rank(row[there])] + steps
            open_, row = open_[~there], row[~there]
            c = self.wavelet.at(row)
            row = self.first[c] + self.wavelet.rank(c, row)
            steps += 1
        return found


@dataclass
class Phrases:
    """Windows of the benchmark: word ids by length, and the items that hold each."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    owners: list[tuple[np.ndarray, np.ndarray]]
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], size: int) -> "Phrases":
        vocabulary: dict[bytes, int] = {}
        items = sorted({x for x, _ in rows})
        number = {x: i for i, x in enumerate(items)}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(number[item])
        windows, owners = [], []
        for n in sorted(found):
            windows.append(np.array(list(found[n]), np.int64).reshape(-1, n))
            lists = [sorted(x) for x in found[n].values()]
            ends = np.append(0, np.cumsum([len(x) for x in lists]))
            owners.append((ends, np.array([x for one in lists for x in one], np.int64)))
        return cls(vocabulary, windows, owners, items)


def occurrences(ids: np.ndarray, ends: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item) pairs (as document * items + item), and start and stop of all occurrences.

    ``ids``: word ids of documents laid end to end (0: not in the benchmark).
    """
    none = np.empty(0, np.int64)
    if not phrases.windows or not len(ids):
        return none, none, none
    owner_start = np.zeros(len(ids) + 1, bool)
    owner_start[ends] = True
    known = ids > 0
    run_start = known.copy()
    run_start[1:] &= ~known[:-1] | owner_start[1:-1]
    heads = np.flatnonzero(run_start)
    run = np.cumsum(run_start) - 1
    lengths = np.bincount(run[known], minlength=len(heads)) if len(heads) else none
    long = lengths >= phrases.windows[0].shape[1]
    heads, lengths = heads[long], lengths[long]
    if not len(heads):
        return none, none, none
    where = ragged(heads, lengths + 1)
    gaps = np.cumsum(lengths + 1) - 1
    text = np.zeros(len(where), np.int64)
    text[:] = ids[np.minimum(where, len(ids) - 1)]
    text[gaps] = 0
    index = FMIndex(text)
    pairs, starts, stops = [], [], []
    for windows, (at, items) in zip(phrases.windows, phrases.owners):
        low, high = index.search(windows)
        hit = np.flatnonzero(low < high)
        counts = (high - low)[hit]
        place = where[index.locate(ragged(low[hit], counts))]
        starts.append(place)
        stops.append(place + windows.shape[1])
        window = np.repeat(hit, counts)
        document = np.searchsorted(ends, place, side="right")
        # Each (document, window) once, then the items of the window.
        seen = np.unique(document * len(windows) + window)
        document, window = seen // len(windows), seen % len(windows)
        each = at[window + 1] - at[window]
        pairs.append(np.unique(np.repeat(document, each) * len(phrases.items) + items[ragged(at[window], each)]))
    return np.unique(np.concatenate(pairs)), np.concatenate(starts), np.concatenate(stops)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _search(shared, size: int, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases.of(shared, size)
        for batch in batches:
            for part in slices(batch):
                texts = raw(part.column("text"))
                words = [words_of(x) for x in texts]
                ends = np.cumsum([len(x) for x in words], dtype=np.int64)
                begins = np.append(0, ends)[:-1]
                n = int(ends[-1]) if len(ends) else 0
                ids = np.fromiter(map(phrases.vocabulary.get, (w for x in words for w in x), repeat(0)), np.int64, n)
                pairs, starts, stops = occurrences(ids, ends, phrases)
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, stops, -1)
                for i, (old, at, to) in enumerate(zip(part.column("spans").to_pylist(), begins.tolist(), ends.tolist())):
                    for x in old:
                        change[at + x["start"]] += 1
                        change[at + x["stop"]] -= 1
                hit = np.cumsum(change[:-1]) > 0
                fresh = hit.copy()
                inner = begins[(begins > 0) & (begins < n)]
                fresh[1:] &= ~hit[:-1]
                fresh[inner] = hit[inner]
                first = np.flatnonzero(fresh)
                last = hit.copy()
                last[:-1] &= ~hit[1:]
                last[inner - 1] = hit[inner - 1]
                stop = np.flatnonzero(last) + 1
                owner = np.searchsorted(ends, first, side="right")
                spans: list[list[dict]] = [[] for _ in words]
                for o, a, b in zip(owner.tolist(), first.tolist(), stop.tolist()):
                    spans[o].append({"start": a - int(begins[o]), "stop": b - int(begins[o])})
                items = [set(x) for x in part.column("items").to_pylist()]
                for pair in pairs.tolist():
                    items[pair // len(phrases.items)].add(phrases.items[pair % len(phrases.items)])
                new = {
                    "n_words": pa.array([len(x) for x in words], pa.int64()), "spans": pa.array(spans, _SPAN),
                    "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                }
                if cut:
                    new["text"] = pa.array([_removed(x, s) if s else x for x, s in zip(texts, spans)], pa.binary()).cast(pa.string())
                names = part.schema.names
                yield pa.RecordBatch.from_arrays([new[x] if x in new else part.column(x) for x in names], names)

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, carried: str | None = None, cut: bool = False
) -> DataFrame:
    """(doc_id, text, n_words, spans, items): where windows of benchmark items occur in each row.

    Words are runs of ASCII letters and digits (lower-cased) and non-ASCII characters.
    ``spans`` are merged word ranges [start, stop); ``items`` the sorted ids,
    as strings, of items with occurring windows.  An item of fewer than
    ``size`` words is one window; one without words, without text or without id has
    none.  A null text comes back empty and has no words; repeated rows and items are
    judged each for itself; other columns are ignored, but for the one named as ``carried``.
    With ``cut`` the texts come back without their spans.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([carried] if carried else []))
    rows = rows.withColumns({
        "n_words": F.lit(0).cast("bigint"), "spans": F.expr("cast(array() as array<struct<start:int,stop:int>>)"),
        "items": F.expr("cast(array() as array<string>)"),
    })
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size_of = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size_of) // block_bytes))
    for block in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        shared = [(r["item"], r["text"].encode()) for r in chosen.collect()]
        rows = in_arrow(rows, _search(shared, size, cut and block == blocks - 1), rows.schema)
    return rows


def _removed(text: bytes, spans: list[dict]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    plain = text.translate(_WORD_BYTES)
    marks = np.concatenate(([False], np.frombuffer(plain, np.uint8) != 0x20, [False]))
    edges = np.flatnonzero(marks[1:] != marks[:-1]).reshape(-1, 2)
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : edges[span["start"], 0]])
        at = int(edges[span["stop"] - 1, 1])
    return b"".join([*kept, text[at:]])


def digests(found: DataFrame) -> DataFrame:
    """Counts and a hash of the item list per document of :func:`contamination`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the words of benchmark windows cut from ``text``; all rows and columns stay.

    What stands between two cut words goes with them.
    """
    # The other columns travel as one; the text only once.
    held = F.struct(F.lit(0).alias("_"), *[F.col(f"`{x}`") for x in docs.columns if x != "text"])
    rows = contamination(docs.select(F.col("doc_id"), F.col("text"), held.alias("_row")), benchmark, size, block_bytes, "_row", cut=True)
    return rows.select(*[F.col("text") if x == "text" else F.col(f"_row.`{x}`").alias(x) for x in docs.columns])
