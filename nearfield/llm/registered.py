"""The corpus operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import debruijn, digest, divergence, feistel, fmindex, langid, maxscore, mil, packing, permutation, pii, simhash, urls
from nearfield.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
RULES = [
    urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    scored = mil.score(docs, mil.train(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel.shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digests(fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 5, 0)
    found = langid.predict(docs, langid.train(docs.where(~held)), with_text=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compared(table(spark, sf_dir, "documents"))


def op8_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES)


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op11_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return permutation.search(rows, rows.where(F.col("vec_id") % 20 == 0))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_attention_quality, op2_simhash_components, op3_feistel_shards, op4_fm_decontamination, op5_vector_packing,
            op6_word_backoff_language, op7_quartile_digest, op8_debruijn_repeats, op9_path_templates, op10_weak_supervision_pii,
            op11_pair_maxscore, op12_permutation_index, op13_source_divergence,
        )
    }
