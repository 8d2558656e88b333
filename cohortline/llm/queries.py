"""The registered corpus queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import conversations, exact_dedup, importance, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sql, substring_dedup, suffix_dedup, toxicity, warc
from cohortline.llm.text import table
from cohortline.session import materialize, new_folder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WEIGHTS = {"domain": {"crawl": 4, "reference": 4, "community": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}
MAX_EPOCHS, SEED = 3, 17


def domain() -> Column:
    """The table names no domains: they are groups of sources by number."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    return F.when(number == 0, "crawl").when(number < 10, "reference").otherwise("community")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain(), WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "take_tokens")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = exact_dedup.with_duplicates(table(spark, sf_dir, "documents"))
    return flagged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.with_classes(table(spark, sf_dir, "documents")).drop("digest")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no addresses: a source is a host and its sections by language are its paths."""
    path = F.concat_ws("/", "source", "lang")
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "archives")
    warc.write_captures(table(spark, sf_dir, "pages"), folder)
    captures = warc.assemble(materialize(warc.read_records(spark, folder), "records"))
    return captures.select(
        F.col("metadata.fields")["pageid"].cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("original")["pageid"].cast("long").alias("refers_to"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_paragraphs", "n_removed", substring_dedup.spans_text(F.col("spans")).alias("removed"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digest_columns(pii.find_personal_data(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair(damaged, absent=F.col("absent"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


CORPUS_QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_packing,
        op3_exact_dedup,
        op4_toxicity,
        op5_near_dedup,
        op6_quality_rules,
        op7_quality_classifier,
        op8_warc,
        op9_substring_dedup,
        op10_pii,
        op11_suffix_dedup,
        op12_conversations,
        op13_importance,
    )
}
CORPUS_SQL = {
    "op1_mixing": sql.mixing(mixing.LEVELS, WEIGHTS, MAX_EPOCHS, SEED),
    "op3_exact_dedup": sql.EXACT_DEDUP,
    "op6_quality_rules": sql.QUALITY_RULES,
    "op8_warc": sql.WARC,
    "op11_suffix_dedup": sql.SUFFIX_DEDUP,
    "op12_conversations": sql.CONVERSATIONS,
    "op13_importance": sql.IMPORTANCE,
}
