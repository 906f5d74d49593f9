"""Personal data by weak supervision, in DataFrame functions only.

Patterns find candidates: the four base kinds, base matches that fail
their check, and looser spellings (bracketed "at" and "dot", national phone numbers).  Three labelers vote
on each, for, against or not at all: the patterns with their checks, a
gazetteer (domain endings, dialling codes, issuer digits, address ranges), and the words before.
Expectation-maximisation estimates how reliable each labeler is for each kind and outcome, from the counts
of all vote patterns in the corpus; its posteriors train a logistic span
classifier on votes and form.  Both work on a histogram of at most 864 lines.  Spans
of the base kinds stay whatever the classifier says; it adds others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialize

KINDS = ["email", "ip", "card", "phone"]
# Possessive forms of the base patterns: the same matches, found in linear time without recursion.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?: ?\[dot\] ?| ?\(dot\) ?|\.)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
# A text without these cannot hold the kind; they only spare the search.
_NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_NEEDED_LOOSE = {"email": r"[\[(]at[\])]", "phone": "[0-9]{3}[ .-][0-9]{4}"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Gazetteers and cue words.
_ENDINGS = r"(?i)[.](?:com|org|net|edu|gov|info|biz|io|co|eu|uk|us|ca|de|fr|es|it|nl|at|ch|pl|br|mx|ar|in|jp|cn|ru|au)$"
_DIALS = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_ISSUERS = "^(?:3[47][0-9]{13}|4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|6[0-9]{15})$"
_CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|kontakt|courriel)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip|address|host|server|adresse|dirección|from)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|payment|credit|karte|carte|tarjeta|account)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|telefon|téléphone|teléfono)\W*(?:\w+\W+)?$",
}
_AGAINST = r"(?i)(?:version|build|order|invoice|isbn|page|section|\bno|id)\W*$"
AGAINST, ABSTAIN, FOR = 0, 1, 2
_SPAN = "struct<start:int,stop:int,kind:int,base:boolean,code:int>"


def luhn(digits: Column) -> Column:
    """The check-digit test of card numbers."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    if kind == "phone":
        return size.between(9, 15)
    return F.when(size.between(12, 19), luhn(digits)).otherwise(False)


def _gazetteer(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return {
        "email": F.regexp_replace(match, r"(?i) ?[\[(]dot[\])] ?", ".").rlike(_ENDINGS), "ip": match.rlike("^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]"),
        "card": digits.rlike(_ISSUERS), "phone": F.when(match.startswith("+"), digits.rlike(_DIALS)).otherwise(digits.rlike("^[2-9]")),
    }[kind]


def _in_blocks(items: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of(block, number)`` of the blocks of about the square root of the array's size that it falls into; none of an empty array."""
    n = F.size(items)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _width(n)).cast("int")), lambda b: F.slice(items, b * _width(n) + 1, _width(n)))
    # A block is a variable of the outer step, so that it is cut out once.
    return F.when(n > 0, F.transform(blocks, of))


def _width(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))


def _running(items: Column, blocks: Column, join: Callable[[Column, Column], Column], start: Column) -> Column:
    """What ``join`` makes of the items up to each one; ``blocks`` holds it for each block.

    A block's list grows item by item, and begins with what the blocks before it make; copying it
    and walking those makes work grow with the array's size to the power 1.5.
    """
    none = F.array().cast("array<int>")

    def inside(block: Column, b: Column) -> Column:
        before = F.aggregate(F.slice(blocks, 1, b), start, join)

        def step(state: Column, x: Column) -> Column:
            at = join(state["at"], x)
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

        return F.aggregate(block, F.struct(before.alias("at"), none.alias("out")), step, lambda s: s["out"])

    return F.coalesce(F.flatten(_in_blocks(items, inside)), none)


def _running_columns(df: DataFrame, items: Column, join: Callable[[Column, Column], Column], start: Column, output: str) -> DataFrame:
    """Add ``output``, the running values of an int array; in columns of their own, so that each is worked out once."""
    kept = df.withColumn("_items", items)
    kept = kept.withColumn("_blocks", _in_blocks(F.col("_items"), lambda block, _: F.aggregate(block, start, join)))
    return kept.withColumn(output, _running(F.col("_items"), F.col("_blocks"), join, start)).drop("_items", "_blocks")


def _candidates(kind: str, strict: bool, matches: str, between: str, ends: str) -> Column:
    """Spans of one pattern with votes and form packed into ``code``.

    ``ends`` are the matches' ends in code points.
    """
    pieces = F.col(between)

    def span(match: Column, i: Column) -> Column:
        before, stop = F.get(pieces, i), F.get(F.col(ends), i)
        passes = _passes(kind, match) if strict else F.lit(False)
        near = F.right(before, F.lit(30))
        votes = [
            F.when(passes, FOR).otherwise(AGAINST) if strict else F.lit(ABSTAIN),
            F.when(_gazetteer(kind, match), FOR).otherwise(AGAINST),
            F.when(near.rlike(_CUES[kind]), FOR).when(near.rlike(_AGAINST), AGAINST).otherwise(ABSTAIN),
        ]
        form = [F.length(match) > 12, match.rlike("[ ()-]"), F.left(F.get(pieces, i + 1), F.lit(1)).rlike("[A-Za-z0-9_]")]
        code = F.lit(KINDS.index(kind))
        for vote in votes:
            code = code * 3 + vote
        for bit in form:
            code = code * 2 + F.when(bit, 1).otherwise(0)
        return F.struct(
            (stop - F.length(match)).alias("start"), stop.alias("stop"), F.lit(KINDS.index(kind)).alias("kind"), passes.alias("base"), code.cast("int").alias("code")
        )

    spans = F.transform(F.col(matches), span)
    # Lone numbers that are far too short for a card are no candidates at all.
    return F.filter(spans, lambda s: s["base"] | (s["stop"] - s["start"] >= 12)) if kind == "card" else spans


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_spans``, the candidates of each whole text (null: none) by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    searches = [(k, True, p, _NEEDED[k]) for k, p in PATTERNS.items()] + [(k, False, p, _NEEDED_LOOSE[k]) for k, p in LOOSE.items()]
    empty = F.expr("cast(array() as array<string>)")
    found = docs.withColumns({f"_has{n}": text.rlike(needed) for n, (_, _, _, needed) in enumerate(searches)})
    found = found.withColumns({f"_m{n}": F.when(F.col(f"_has{n}"), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(empty) for n, (_, _, p, _) in enumerate(searches)})
    found = found.withColumns({f"_p{n}": F.when(F.size(f"_m{n}") > 0, F.split(text, p, -1)).otherwise(empty) for n, (_, _, p, _) in enumerate(searches)})
    for n in range(len(searches)):
        pieces = F.col(f"_p{n}")
        sizes = F.transform(F.col(f"_m{n}"), lambda match, i: F.length(F.get(pieces, i)) + F.length(match))  # noqa: B023
        found = _running_columns(found, sizes, lambda a, b: a + b, F.lit(0), f"_e{n}")
    spans = F.concat(*[_candidates(k, strict, f"_m{n}", f"_p{n}", f"_e{n}") for n, (k, strict, _, _) in enumerate(searches)])
    return found.select(*[F.col(f"`{x}`") for x in docs.columns], F.array_sort(spans).alias("_spans"))


def _split_code(code: int) -> tuple[int, tuple[int, int, int], tuple[int, int, int]]:
    form = (code >> 2 & 1, code >> 1 & 1, code & 1)
    code >>= 3
    return code // 27, (code // 9 % 3, code // 3 % 3, code % 3), form


def reliabilities(counts: dict[tuple[int, tuple[int, int, int]], float], rounds: int = 50) -> tuple[dict, dict]:
    """EM over vote patterns (kind, votes): posterior of each pattern, and P(vote | truth) per kind and labeler."""
    posterior, tables = {}, {}
    for kind in sorted({k for k, _ in counts}):
        own = {v: n for (k, v), n in counts.items() if k == kind}
        # Start from the majority of the votes cast.
        q = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(x - 1 for x in v))) for v in own}
        for _ in range(rounds):
            total = sum(own.values())
            share = (sum(n * q[v] for v, n in own.items()) + 1) / (total + 2)
            table = np.ones((2, 3, 3))
            for v, n in own.items():
                for labeler, vote in enumerate(v):
                    table[1, labeler, vote] += n * q[v]
                    table[0, labeler, vote] += n * (1 - q[v])
            table /= table.sum(axis=2, keepdims=True)
            for v in own:
                yes, no = share, 1 - share
                for labeler, vote in enumerate(v):
                    yes, no = yes * table[1, labeler, vote], no * table[0, labeler, vote]
                q[v] = yes / (yes + no)
        tables[kind] = table
        posterior |= {(kind, v): x for v, x in q.items()}
    return posterior, tables


def _features(code: int) -> np.ndarray:
    kind, votes, form = _split_code(code)
    x = np.zeros(4 + 9 + 3)
    x[kind] = 1
    for labeler, vote in enumerate(votes):
        x[4 + 3 * labeler + vote] = 1
    x[13:] = form
    return x


def fit(histogram: dict[int, int], rounds: int = 300) -> set[int]:
    """Codes that the trained classifier takes for personal data (probability 0.5 or more)."""
    if not histogram:
        return set()
    codes = sorted(histogram)
    n = np.array([histogram[c] for c in codes], np.float64)
    counts: dict = {}
    for c in codes:
        key = _split_code(c)[:2]
        counts[key] = counts.get(key, 0) + histogram[c]
    posterior, _ = reliabilities(counts)
    y = np.array([posterior[_split_code(c)[:2]] for c in codes])
    x = np.stack([_features(c) for c in codes])
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-4 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {c for c, chance in zip(codes, p) if chance >= 0.5}


def found(docs: DataFrame) -> DataFrame:
    """``docs`` (without their text, if it is not among its columns) with ``_base`` and ``_all`` spans.

    Spans are structs (start, stop, kind, ...) in code points, stop exclusive, by
    start, then kind.  Added spans overlap no base span.
    """
    marked = materialize(docs, "candidates")
    histogram = marked.select(F.explode("_spans.code").alias("code")).groupBy("code").count()
    # At most 4 kinds x 27 votes x 8 forms.
    accepted = fit({r["code"]: r["count"] for r in histogram.collect()})
    taken = F.array(*[F.lit(c) for c in sorted(accepted)]) if accepted else F.expr("cast(array() as array<int>)")
    base = F.filter("_spans", lambda s: s["base"])
    with_base = marked.withColumn("_base", base)
    # Base spans in blocks, so that a span is only held against those around it.
    block = lambda some, _: F.struct(F.get(some, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(some, lambda s: s["stop"])).alias("hi"), some.alias("held"))
    with_base = with_base.withColumn("_near", _in_blocks(F.col("_base"), block))
    meet = lambda lo, hi, s: (lo < s["stop"]) & (s["start"] < hi)
    added = F.filter(
        "_spans",
        lambda s: ~s["base"] & F.array_contains(taken, s["code"])
        & ~F.coalesce(F.exists("_near", lambda b: meet(b["lo"], b["hi"], s) & F.exists(b["held"], lambda x: meet(x["start"], x["stop"], s))), F.lit(False)),
    )
    return with_base.withColumn("_all", F.array_sort(F.concat("_base", added))).drop("_spans", "_near")


def _named(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts and hash are those of the base spans; ``spans`` holds all.  A null
    or empty text has none; repeated rows are judged alike; extra columns are ignored.
    """
    marked = candidates(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))).select("doc_id", "_spans")
    return found(marked).select(
        "doc_id", *[_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_named("_base"), 256).alias("base_sha256"), _named("_all").alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``<kind>``; all rows and columns stay.

    Spans that overlap are masked as one, named by the first.
    """
    held = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    marked = found(candidates(held))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    stops = F.transform("_all", lambda s: s["stop"])
    marked = _running_columns(marked, stops, lambda a, b: F.greatest(a, b), F.lit(0), "_stops")
    # A part of a long text is cut out of a short piece of it, as finding a place means walking up to it.
    width = F.greatest(F.lit(1024), F.ceil(F.sqrt(F.length("text"))).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / F.col("_width")).cast("int")), lambda i: F.substring(F.col("text"), i * F.col("_width") + 1, F.col("_width")))
    marked = marked.withColumn("_width", width).withColumn("_pieces", F.when(F.size("_all") > 0, cut))

    def part(start: Column, stop: Column) -> Column:
        width, piece = F.col("_width"), lambda i: F.get("_pieces", i)
        first, last = F.floor(start / width).cast("int"), F.floor((stop - 1) / width).cast("int")
        head = F.substring(piece(first), start - first * width + 1, F.least(width, stop - start))
        whole = F.array_join(F.slice("_pieces", first + 2, F.greatest(F.lit(0), last - first - 1)), "")
        longer = F.concat(head, whole, F.substring(piece(last), F.lit(1), stop - last * width))
        return F.when(stop <= start, "").when(first == last, head).otherwise(longer)

    def masked_span(s: Column, i: Column) -> Column:
        # Where the spans before it end; one that starts earlier is masked with them.
        at = F.when(i > 0, F.get("_stops", i - 1)).otherwise(0)
        return F.when(s["start"] >= at, F.concat(part(at, s["start"]), F.get(names, s["kind"]))).otherwise("")

    end = F.get("_stops", F.size("_stops") - 1)
    whole = F.concat(F.array_join(F.transform("_all", masked_span), ""), part(end, F.length("text")))
    text = F.when(F.size("_all") > 0, whole).otherwise(F.col("text"))
    return marked.select(*[text.alias(x) if x == "text" else F.col(f"_row.`{x}`").alias(x) for x in docs.columns])
