"""Language identification by words first, character n-grams second.

Training counts words per language over all training documents, and character n-grams of
one to five letters, word ends included, over all words.  Both tables are kept whole, as written tables of
log frequencies per language; the most frequent entries of each are broadcast as well.  A text's words add up their scores;
a word that was never seen takes the mean score of its n-grams of the greatest length of which any was.
Words beyond the broadcast ones are looked up by equi-joins in the whole tables; all scores are doubles
either way, so what is broadcast changes no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from nearfield.llm.common import CACHE_WORDS, in_arrow, raw, slices
from nearfield.session import discard, materialize, parallelism

LONGEST = 5
ALPHA = 0.5
# So many words are full evidence; longer texts do not grow surer than that.
EVIDENCE = 40
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word with its ends marked."""
    marked = f"\t{word}\n" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _flush(counts: dict[str, Counter], name: str) -> pa.RecordBatch:
    rows = [(lang, x, n) for lang, counter in counts.items() for x, n in counter.items()]
    counts.clear()
    lang, found, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["lang", name, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), raw(part.column("text"))):
                counts.setdefault(lang, Counter()).update(letter_words(text.decode("utf-8", "replace")))
            if sum(map(len, counts.values())) > CACHE_WORDS:
                yield _flush(counts, "word")
    yield _flush(counts, "word")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, times in zip(*(batch.column(x).to_pylist() for x in ("lang", "word", "n"))):
            counter = counts.setdefault(lang, Counter())
            for n in range(1, LONGEST + 1):
                for gram in grams(word, n):
                    counter[gram] += times
            if len(counter) > CACHE_WORDS:
                yield _flush(counts, "gram")
    yield _flush(counts, "gram")


@dataclass
class Model:
    """Rows of the two score tables (one column per language) by word and by n-gram.

    Where these hold only the most frequent entries, ``all_words`` and ``all_grams`` are the
    whole tables: (word or gram, scores).
    """

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    all_words: DataFrame | None = None
    all_grams: DataFrame | None = None

    def known_grams(self, word: str) -> list[int]:
        """The word's n-grams of the greatest length of which any is known."""
        marked, known = f"\t{word}\n", self.grams.get
        for n in range(LONGEST, 1, -1):
            found = [x for x in map(known, [marked[i : i + n] for i in range(len(marked) - n + 1)]) if x is not None]
            if found:
                return found
        return [x for x in map(known, word) if x is not None]


class Scorer:
    """Predictions with a bounded cache of the scores of unseen words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place = dict(self.model.words)
        self.scores = self.model.word_scores
        self.letters = np.ones(len(self.scores), bool)

    def learn(self, words: list[str]) -> None:
        """Scores of unseen words by n-grams; what holds no letter counts nothing."""
        flat, counts, letters = [], [], []
        for word in words:
            spelled = word.isalpha() or has_letter(word)
            found = self.model.known_grams(word) if spelled else []
            flat += found
            counts.append(len(found))
            letters.append(spelled)
        sizes = np.array(counts, np.int64)
        fresh = np.zeros((len(words), len(self.model.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            sums = np.add.reduceat(self.model.gram_scores[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
            fresh[some] = sums / sizes[some, None]
        self.place.update(zip(words, range(len(self.scores), len(self.scores) + len(words))))
        self.scores, self.letters = np.concatenate((self.scores, fresh)), np.concatenate((self.letters, np.array(letters, bool)))

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.place) > len(self.model.words) + CACHE_WORDS // 2:
            self.forget()
        words = [letter_words(x) for x in texts]
        self.learn(list({w for x in words for w in x} - self.place.keys()))
        return [self._predict(x) for x in words]

    def scan_all(self, texts: list[str]) -> list[tuple[int, list[float], list[dict]]]:
        """Of each text: how many words count, the sum of the scores of those in the model, and the others with their numbers."""
        found = []
        for words in map(letter_words, texts):
            counts = Counter(words)
            place = self.model.words
            known = [x for x in counts if x in place]
            others = [{"word": x, "times": n} for x, n in counts.items() if x not in place and (x.isalpha() or has_letter(x))]
            scores = self.model.word_scores[[place[x] for x in known]]
            total = np.array([counts[x] for x in known], np.float64) @ scores
            found.append((sum(counts[x] for x in known) + sum(x["times"] for x in others), total.tolist(), others))
        return found

    def _predict(self, words: list[str]) -> tuple[str, float]:
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        n = int(self.letters[at].sum())
        if not n or not self.model.languages:
            return UNKNOWN, 0.0
        total = self.scores[at[self.letters[at]]].sum(axis=0) * (min(n, EVIDENCE) / n)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


def _tables(counts: DataFrame, name: str, most: int, languages: list[str]) -> tuple[dict[str, int], np.ndarray, DataFrame, bool]:
    """Log frequencies of the most frequent entries, at most ``most`` of them, the table of all, and whether that has more.

    Entries as frequent as the first one that finds no place stay out of the former together.  How
    many entries have which frequency is aggregated, so only the most frequent ones reach the driver.
    """
    total = counts.groupBy(name).agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)])
    total = materialize(total, "totals")
    columns = [f"n{i}" for i in range(len(languages))]
    # Each length of n-gram is a distribution of its own.
    size = F.length(name) if name == "gram" else F.lit(1)
    sums = np.ones((LONGEST, len(languages)))
    for r in total.groupBy(size.alias("size")).agg(F.count("*").alias("entries"), *[F.sum(x).alias(x) for x in columns]).collect():
        sums[r["size"] - 1] = [r[x] + ALPHA * r["entries"] for x in columns]
    # Powers of two up, sixteen steps each: a few hundred classes of frequency.
    step = F.floor(F.log2("all") * 16)
    kept, lowest, cut = 0, None, False
    for r in sorted(total.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        kept += r["count"]
        if cut := kept > most:
            break
        lowest = r["step"]
    rows = total.where(step >= lowest if lowest is not None else F.lit(False)).toPandas().sort_values(name, ignore_index=True)
    n = rows[columns].to_numpy(np.float64).reshape(len(rows), len(languages))
    sizes = rows[name].str.len().to_numpy(int) if name == "gram" and len(rows) else np.ones(len(rows), int)
    logs = np.log((n + ALPHA) / sums[sizes - 1])
    scores = [F.log((F.col(x) + ALPHA) / F.element_at(F.lit(sums[:, i].tolist()), size.cast("int"))) for i, x in enumerate(columns)]
    return {x: i for i, x in enumerate(rows[name])}, logs, total.select(name, F.array(*scores).alias("scores")), cut


def train(docs: DataFrame, max_words: int = 200_000, max_grams: int = 100_000) -> Model:
    """Model of all rows of ``docs`` (text, lang) with a language.

    Every word and n-gram of every row is kept; the two parameters bound only what
    is broadcast.  Languages are as many as ``lang`` has values.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = in_arrow(rows, _count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    # The table of words is small next to the work it makes.
    spread = words.repartition(parallelism(docs.sparkSession), "word")
    counted = in_arrow(spread, _count_grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    *known, all_words, cut_words = _tables(words, "word", max_words, languages)
    *parts, all_grams, cut_grams = _tables(counted, "gram", max_grams, languages)
    discard(words)
    return Model(languages, *known, *parts, *((all_words, all_grams) if cut_words or cut_grams else ()))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for part in slices(batch):
                found = scorer.predict_all([x.decode("utf-8", "replace") for x in raw(part.column("text"))])
                new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "lang_pred", "score"])

    return run


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for part in slices(batch):
                found = scorer.scan_all([x.decode("utf-8", "replace") for x in raw(part.column("text"))])
                n, known, others = zip(*found) if found else ((), (), ())
                new = [pa.array(n, pa.int64()), pa.array(known, pa.list_(pa.float64())), pa.array(others, _OTHERS)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "_n", "_known", "_others"])

    return run


_OTHERS = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))


def _looked_up(words: DataFrame, model: Model) -> DataFrame:
    """(word, scores) of distinct words by the whole tables; words without any known n-gram are left out."""
    found = materialize(words.join(model.all_words, "word", "left"), "words")
    parts, rest = found.where("scores IS NOT NULL"), found.where("scores IS NULL").select("word")
    for n in range(LONGEST, 0, -1):
        if rest.isEmpty():
            break
        marked = rest.withColumn("marked", F.concat(F.lit("\t"), "word", F.lit("\n")) if n > 1 else F.col("word")).where(F.length("marked") >= n)
        own = marked.select("word", F.explode(F.expr(f"transform(sequence(1, length(marked) - {n - 1}), i -> substring(marked, i, {n}))")).alias("gram"))
        means = F.array(*[F.avg(F.col("scores")[i]) for i in range(len(model.languages))])
        hits = materialize(own.join(model.all_grams, "gram").groupBy("word").agg(means.alias("scores")), "hits")
        parts, rest = parts.union(hits), materialize(rest.join(hits, "word", "left_anti"), "rest")
    return parts


def predict(docs: DataFrame, model: Model, carried: str | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, text, lang_pred, score) of every row; ``carried`` names one more column to keep, ``text`` may be left out.

    ``und`` with score 0 where the text is null or empty, has no letter, or
    nothing was learned.  Repeated rows are judged alike, each for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, all_words=None, all_grams=None))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([carried] if carried else []))
    kept = [x for x in rows.columns if with_text or x != "text"]
    if model.all_words is None:
        schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        return in_arrow(rows, _predict(shared), schema).select(*kept, "lang_pred", "score")
    # Written once, so that the row numbers stay.
    new = StructType.fromDDL("_n bigint, _known array<double>, _others array<struct<word:string,times:bigint>>")
    scanned = in_arrow(rows, _scan(shared), StructType([*rows.schema.fields, *new.fields])).select(*kept, "_n", "_known", "_others")
    scanned = materialize(scanned.withColumn("_at", F.monotonically_increasing_id()), "scanned")
    others = scanned.select("_at", F.explode("_others").alias("other")).select("_at", "other.word", "other.times")
    scores = _looked_up(others.select("word").distinct(), model)
    sums = [F.sum(F.col("times") * F.col("scores")[i]) for i in range(len(model.languages))]
    added = others.join(scores, "word").groupBy("_at").agg(F.array(*sums).alias("_added"))
    total = F.expr("transform(_known, (x, i) -> (x + coalesce(_added[i], 0D)) * least(_n, " + str(EVIDENCE) + ") / greatest(_n, 1))")
    found = scanned.drop("_others").join(added, "_at", "left").withColumn("_total", total).withColumn("_most", F.array_max("_total"))
    best = F.element_at(F.lit(model.languages), F.array_position("_total", F.col("_most")).cast("int"))
    share = F.expr("1 / aggregate(_total, 0D, (sum, x) -> sum + exp(x - _most))")
    return found.select(*kept, F.when(F.col("_n") > 0, best).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("_n") > 0, share).otherwise(0.0).alias("score"))


def held_out(doc_id, of: int, remainder: int):
    """True where crc32 of the id as text leaves this remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == remainder
