"""Audit of sources: how far the words of each (lang, source) group are from those of its peers.

Every group gives every kept term a smoothed share p, also a term that it never uses (its
baseline).  A pair's value sums floor((p - q)^2 / q) over all kept terms of the language.

The terms are kept term-major: one row per term with its postings (group, p, baseline).  As in
Gustavson's row-wise matrix product, each group walks its own terms through the postings of a
slice of that index and scatters what it meets into one dense accumulator with a place per
peer.  No pair of postings is ever a row.  The accumulators hold what terms of both groups add;
what a term of one group alone or of none adds depends on counts and baselines only, and comes
from the group's histogram of shares (the zero baselines).  All sums are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import CACHE_WORDS, in_arrow, ragged, raw, slices
from nearfield.session import materialize

# Runs of ASCII letters (lower-cased) and non-ASCII characters; all other bytes part them.
_TERMS = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b > 0x7F else 0x20 for b in range(256))
# Postings that one slice of the index holds.
SLICE_POSTINGS = 1 << 20
_SHARE = "1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({total} + kept AS DECIMAL(20, 0))"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _flush(counts: dict[tuple, tuple[Counter, Counter]]) -> pa.RecordBatch:
    lang, source, term, n, docs = [], [], [], [], []
    for (l, s), (times, holders) in counts.items():
        lang += [l] * len(times)
        source += [s] * len(times)
        term += times
        n += times.values()
        docs += map(holders.__getitem__, times)
    counts.clear()
    text = pa.array(term, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(source, pa.string()), text, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
        ["lang", "source", "term", "n", "docs"],
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    for batch in batches:
        for part in slices(batch):
            for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), raw(part.column("text"))):
                times, holders = counts.setdefault((lang, source), (Counter(), Counter()))
                words = terms_of(text)
                times.update(words)
                holders.update(set(words))
            if sum(len(x) for x, _ in counts.values()) > CACHE_WORDS:
                yield _flush(counts)
    yield _flush(counts)


def term_index(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, term, total, postings of (source, n)): the terms in at least ``least_docs`` documents of the language."""
    empty = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")]
    # Counted per task first; one exchange by term then serves both sums.
    counts = in_arrow(docs.select(*empty), _count, "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    found = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings")
    )
    return found.where(F.col("docs") >= least_docs).select("lang", "term", "total", "postings")


def _corrections(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, peers, sums) of the terms of one language: what terms that both use add beyond the baselines."""
    lists = table.column("postings").combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    group, p, low = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("sid", "p", "low"))
    starts, sizes = offsets[:-1].astype(np.int64) - int(offsets[0]), np.diff(offsets).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    peers, place = np.unique(group, return_inverse=True)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(len(peers) + 1))
    for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        own = order[a:b]
        met = ragged(starts[owner[own]], sizes[owner[own]])
        mine, base = np.repeat(p[own], sizes[owner[own]]), low[own[0]]
        theirs, floor = p[met], low[met]
        more = (mine - theirs) ** 2 // theirs - (mine - floor) ** 2 // floor - (base - theirs) ** 2 // theirs + (base - floor) ** 2 // floor
        sums = np.zeros(len(peers), np.int64)
        np.add.at(sums, place[met], more)
        sums[g] = 0
        yield int(peers[g]), peers, sums


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column("lang")).to_pylist():
            for group, peers, sums in _corrections(table.filter(pc.equal(table.column("lang"), lang))):
                some = np.flatnonzero(sums)
                columns = [pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), group)), pa.array(peers[some]), pa.array(sums[some])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "sid", "peer", "value"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("postings").flatten())
        if size >= SLICE_POSTINGS:
            yield from emit(held)
            held, size = [], 0
    if held:
        yield from emit(held)


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    Part ``pair``: each other source of the language with its divergence, all ranks.  Part
    ``term``: the terms that the group uses more than its language does, up to rank ``ranks``.
    Equal values rank by item.  A null text, lang or source is the empty string, and an empty
    string is a group like any other; a group without any term still has its pairs (0 where the
    language keeps no term); repeated rows count as often as they stand there; an empty table
    gives no rows; other columns are ignored.
    """
    index = materialize(term_index(docs, least_docs), "terms")
    postings = index.select("lang", "term", "total", F.inline("postings"))
    langs = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    names = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("lang", "source")]
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    groups = docs.select(*names).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "used", "kept", "lang_total"])
    groups = groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    # Without a kept term there is nothing to share out; the baseline is never used then.
    groups = materialize(groups.withColumn("low", F.when(F.col("kept") > 0, F.expr(_SHARE.format(n="0L", total="total"))).otherwise(1)), "groups")
    entries = postings.withColumnRenamed("total", "term_total").join(groups, ["lang", "source"]).select(
        "lang", "sid", "source", "term", "low",
        F.expr(_SHARE.format(n="n", total="total")).alias("p"), F.expr(_SHARE.format(n="term_total", total="lang_total")).alias("q"),
    )
    entries = materialize(entries, "entries")

    own = groups.select("lang", "sid", "low", (F.col("kept") - F.col("used")).alias("unused"))
    peers = groups.select("lang", F.col("sid").alias("peer"), F.col("low").alias("peer_low"))
    shares = entries.groupBy("lang", "sid", "low", "p").agg(F.count("*").alias("n"))
    met = shares.join(peers, "lang").where("sid != peer").groupBy("lang", "sid", "peer").agg(
        F.sum(F.expr(f"n * ({_gap('p', 'peer_low')})")).alias("mine"),
        F.sum(F.expr(f"n * (({_gap('peer_low', 'p')}) - ({_gap('peer_low', 'low')}))")).alias("theirs"),
    )
    met = materialize(met, "shares")
    rows = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "low")).alias("postings"))
    both = in_arrow(rows.select("lang", "postings"), _accumulate, "lang string, sid bigint, peer bigint, value bigint")
    value = (
        own.join(peers, "lang").where("sid != peer").select("lang", "sid", "peer", F.expr(f"unused * ({_gap('low', 'peer_low')})").alias("value"))
        .unionByName(met.select("lang", "sid", "peer", F.col("mine").alias("value")))
        .unionByName(met.select("lang", F.col("peer").alias("sid"), F.col("sid").alias("peer"), F.col("theirs").alias("value")))
        .unionByName(both)
        .groupBy("lang", "sid", "peer").agg(F.sum("value").alias("value"))
    )
    name = groups.select("lang", "sid", "source")
    item = name.select("lang", F.col("sid").alias("peer"), F.col("source").alias("item"))
    pairs = value.join(name, ["lang", "sid"]).join(item, ["lang", "peer"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    words = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", best).unionByName(words.select("*", best).where(F.col("rank") <= ranks))
