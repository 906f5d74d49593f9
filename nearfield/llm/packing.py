"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, pieces of documents, and attention cost
(the sum of squared piece lengths).  A piece's demand on all three follows
from its length, so the packing needs only the *histogram* of lengths: at most
``capacity`` numbers, whatever the size of the corpus.  Lengths are placed in
descending order; all equal pieces go into all equal bins at once, each time into
the bins with the best score (weighted dot-product of demand and residual, or smallest norm of
the residual left) among those where every capacity holds.  The plan that results is a
short list of (length, ranks of pieces) -> (sequences, offset); each piece finds its line by its
rank among the pieces of its length, which tasks count and Spark adds up.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import CACHE_WORDS, in_arrow, ragged, raw, slices, texts_of
from nearfield.session import materialize

CAPACITY = 2048
END = 0


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence.  The defaults for pieces and cost are what the token capacity implies."""

    tokens: int = CAPACITY
    pieces: int = CAPACITY
    cost: int = CAPACITY * CAPACITY
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> np.ndarray:
    """Lines (length, first rank, first sequence, sequences, pieces in each, first offset), by length and rank.

    In a line, piece ``first rank + i`` goes to sequence ``first sequence + i // pieces in each``.
    """
    caps = np.array([limits.tokens, limits.pieces, limits.cost], np.float64)
    weights = np.array(limits.weights)
    # Open bins that agree in all residuals: (tokens, pieces, cost) -> runs of sequence numbers.
    open_: dict[tuple[int, int, int], list[list[int]]] = {}
    residual = np.empty((0, 3), np.int64)
    stale = True
    lines: list[tuple[int, ...]] = []
    fresh = 0

    def put(state: tuple[int, int, int], first: int, count: int) -> None:
        nonlocal stale
        if min(state) > 0:
            if state not in open_:
                open_[state] = []
                stale = True
            open_[state].append([first, count])

    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {limits}")
        left, rank = histogram[length], 0
        while left:
            if stale:
                residual, stale = np.array(list(open_), np.int64).reshape(-1, 3), False
            fits = (residual >= need).all(axis=1)
            if fits.any():
                could = residual[fits]
                if limits.rule == "dot":
                    score = -((could / caps) @ (weights * need / caps))
                else:
                    score = ((((could - need) / caps) ** 2) * weights).sum(axis=1)
                state = tuple(could[np.lexsort((*could.T, score))[0]].tolist())
                runs = open_[state]
                first, count = runs[-1]
            else:
                state, runs, first, count = (limits.tokens, limits.pieces, limits.cost), None, fresh, left
            most = int(min(s // n for s, n in zip(state, need.tolist())))
            each = min(most, left)
            used = min(count, left // each)
            after = tuple(int(s - each * n) for s, n in zip(state, need.tolist()))
            lines.append((length, rank, first, used, each, limits.tokens - state[0]))
            if runs is None:
                fresh += used
            elif used < count:
                runs[-1] = [first + used, count - used]
            else:
                runs.pop()
                if not runs:
                    del open_[state]
                    stale = True
            put(after, first, used)
            rank, left = rank + used * each, left - used * each
    found = np.array(lines, np.int64).reshape(-1, 6)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


# A word of Latin letters with stops and the like behind it: two pieces to every splitter of the kind used here.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Tokens(dict):
    """Token ids of texts under a tokenizer that never looks across white space.

    Texts are cut at blanks; each distinct chunk is tokenised once while it recurs, and
    the ids of a slice are gathered in one step.  Plain chunks skip the general
    normaliser and splitter, and their pieces (the word in lower case, what follows it)
    go to the tokenizer's model directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = str.maketrans(_byte_letters())
        self.model = self.tokenizer.model
        self.pieces: dict[str, array] = {}
        # Tokens that are found before the text is normalised or split, in any letter case.
        added = [re.escape(t.content.lower().encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added)) if added else None
        self.forget()
        probe = "The caf\u00e9's \u00c9t\u00e9, 12.5% 'Re; \u6f22\u5b57\n\tx_y"
        if self.of([probe.encode()])[0].tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} does not lower-case, or looks across white space")

    def forget(self) -> None:
        self.clear()
        self.starts, self.ids = array("q", [0]), array("I")
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()

    def piece(self, text: str) -> array:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        found = self.pieces[text] = array("I", [x.id for x in self.model.tokenize(shown)])
        return found

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8")
        plain = _PLAIN.fullmatch(text)
        if plain:
            body, rest = plain.groups()
            body = body.lower()
            self.ids += self.pieces.get(body) or self.piece(body)
            if rest:
                self.ids += self.pieces.get(rest) or self.piece(rest)
        else:
            self.ids.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.starts.append(len(self.ids))
        self[word] = at = len(self)
        return at

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text."""
        if len(self) > CACHE_WORDS:
            self.forget()
        counts, which = [], []
        for text in texts:
            low = text.lower()
            if self.added and self.added.search(low):
                # As a whole, as only the tokenizer knows what such a token takes with it.
                words = [text]
            else:
                # Lower case at once, unless an accent follows that would first join a capital.
                words = (text if b"\xcc" in text or b"\xcd" in text else low).split()
            counts.append(len(words))
            which.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        flat = np.concatenate(which) if which else np.empty(0, np.int64)
        starts, known = np.array(self.starts, np.int64), np.array(self.ids, np.uint32)
        sizes = (starts[1:] - starts[:-1])[flat]
        ids = known[ragged(starts[flat], sizes)]
        sums = np.append(0, np.cumsum(sizes))
        return ids, np.diff(sums[np.append(0, np.cumsum(counts, dtype=np.int64))])


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = Tokens(path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids, counts = tokens.of(raw(part.column("text")))
                owner, number, start, length, crc = [], [], [], [], []
                at = 0
                for i, n in enumerate(counts.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(END)).astype("<u4")
                    at += n
                    for j, begin in enumerate(range(0, n + 1, capacity)):
                        piece = whole[begin : begin + capacity]
                        owner.append(i)
                        number.append(j)
                        start.append(begin)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                lengths = np.array(length, np.int64)
                # Rank among the pieces of its length in this task.
                by = np.argsort(lengths, kind="stable")
                ordered = lengths[by]
                heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(by) else by
                sizes = np.diff(np.append(heads, len(by)))
                rank = np.empty(len(by), np.int64)
                rank[by] = np.arange(len(by)) - np.repeat(heads, sizes) + ranks[ordered]
                ranks[ordered[heads]] += sizes
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(len(by), task, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return run


def _placed(lines: np.ndarray):
    keys = (lines[:, 0] << 44) | lines[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            line = lines[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if batch.num_rows else lines[:0]
            inside = rank - line[:, 1]
            sequence, turn = line[:, 2] + inside // line[:, 4], inside % line[:, 4]
            columns = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(line[:, 5] + turn * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A document is its token ids and one id 0; a null or empty text is that id alone.
    Only documents above the token capacity are cut.  Repeated rows are packed
    each for itself; an empty table gives no rows; other columns are ignored.
    ``tokenizer`` is a file whose normaliser lower-cases and whose splitter acts between blanks; another
    one raises.  Special tokens in a text are what the tokenizer makes of them.
    """
    pieces = in_arrow(
        texts_of(docs), _pieces(tokenizer, limits.tokens),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint",
    )
    pieces = materialize(pieces, "tokens")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = materialize(counts, "lengths")
    # At most one row per length, so at most ``limits.tokens`` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("_before"))
    return in_arrow(
        ranked.drop("_before"), _placed(plan(histogram, limits)),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
