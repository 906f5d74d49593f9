"""The training-data pipeline: five stages over ``documents``, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import fmindex, langid, nearcopies, packing, pii
from nearfield.llm.common import table
from nearfield.llm.registered import tokenizer_path
from nearfield.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without any letter go, and no others.

    ``und`` for want of a letter is the one prediction that rejects a row.  Every predicted language stays
    at any score, as a clean text may be in a language that ``lang`` lists little of or not at all;
    where ``lang`` is null throughout, nothing is learned and every row with a letter stays.
    """
    # The other columns travel as one; a null text has no letter, so no kept row had one.
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{x}`") for x in docs.columns if x != "text"])
    model = langid.train(docs)
    found = langid.predict(docs.select("doc_id", "text", row.alias("_row")), model, "_row")
    # A model without languages says ``und`` of every text.
    found = found.where(F.col("lang_pred") != langid.UNKNOWN if model.languages else F.col("text").rlike(r"\p{L}"))
    return found.select(*[F.col("text") if x == "text" else F.col(f"_row.`{x}`").alias(x) for x in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Candidates come from the index of SimHash fingerprints and from one of least hashes; they are linked at a
    Jaccard similarity of 0.8 or more of their sets of five-word shingles.
    """
    return nearcopies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of benchmark windows."""
    return fmindex.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; the last stage returns their pieces."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

# Hashes, tokenizers and trained models are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
