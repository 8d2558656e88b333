"""Keys above 2^53 beside a null key, and added columns with inner names, through every operator and pipeline stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortline.llm import exact_dedup, importance, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup, suffix_dedup, toxicity
from cohortline.llm.queries import VOCABULARY, WEIGHTS, domain

KEYS = [2**53 + 1, None, 2**63 - 1, -(2**63), 7]
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix strong potions for every brave knight of"


def documents(frame, clash=()):
    rows = [(k, f"{WORDS} town {i} and its {i * 7} neighbours.", "en", f"site{i % 3}", 5) for i, k in enumerate(KEYS)]
    df = frame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({name: F.lit(name) for name in clash})


def labels(frame):
    return frame([(k, i % 2, i % 2) for i, k in enumerate(KEYS)], "doc_id bigint, quality int, toxic int")


def all_results(frame, clash=()):
    docs, marks = documents(frame, clash), labels(frame)
    yield "mixing", mixing.mix(docs, domain(), WEIGHTS)
    yield "packing", packing.pack(docs, VOCABULARY)
    yield "exact", exact_dedup.with_duplicates(docs)
    yield "toxicity", toxicity.grade_documents(docs, marks)
    yield "near", near_dedup.with_classes(docs)
    yield "rules", quality_rules.judge(docs)
    yield "quality", quality_classifier.score_documents(docs, marks, F.col("source"), F.col("lang"))
    yield "substring", substring_dedup.repeated_spans(docs)
    yield "pii", pii.find_personal_data(docs)
    yield "suffix", suffix_dedup.repeated_spans(docs)
    yield "importance", importance.resample(docs, docs.select("text"))


def test_keys_stay_as_they_are(frame):
    for name, out in all_results(frame):
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(KEYS), name


def test_added_columns_with_inner_names(frame):
    names = ["key", "mark", "marks", "body", "digest", "bands", "row", "place", "grade", "spans", "host", "path", "piece", "start", "owner", "found", "quality", "__key", "__doc"]
    for name, out in all_results(frame, names):
        assert out.select("doc_id").count() >= len(KEYS), name


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "packing"], ids=lambda s: s[0])
def test_stages_keep_wide_keys_and_all_columns(spark, frame, stage):
    docs = documents(frame, ["key", "digest", "marks", "row"])
    out = stage[1](spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(KEYS)


def test_near_duplicates_lose_no_row_beside_a_null_key(frame):
    docs = documents(frame)
    assert near_dedup.drop_near_duplicates(docs).count() == len(KEYS)
    kept = near_dedup.drop_near_duplicates(docs.unionByName(docs.withColumn("doc_id", F.lit(2**53 + 2)))).collect()
    assert len(kept) == len(KEYS)


def test_a_million_digits_take_no_time(frame):
    texts = ["1" * 1_000_000, "1." * 300_000, "1" * 500_000 + ".2.3.4", "+1" + "(" * 300_000, "9-" * 300_000, "a@" * 200_000]
    found = pii.find_personal_data(frame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    assert len(found) == len(texts)
