"""The shape features of the quality classifier read whole texts."""

from __future__ import annotations

import pytest

from cohortline.llm import quality_classifier


def test_variety_of_the_whole_text(spark):
    clean = [f"word{i}" for i in range(200)]
    texts = [clean, clean + ["again"] * 800, ["again"] * 800 + clean, clean + clean[:50] * 2, clean[:3] + clean[:1], []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(len(texts), None)], "doc_id long, text string")
    rows = quality_classifier.add_shape(df).orderBy("doc_id").collect()
    size = quality_classifier.BLOCK_WORDS
    for row, words in zip(rows, [*texts, []]):
        parts = [words[i : i + size] for i in range(0, len(words), size)]
        assert row["s_variety"] == pytest.approx(sum(len(set(p)) for p in parts) / max(len(words), 1))
    assert rows[0]["s_variety"] == 1 and rows[1]["s_variety"] < 0.25
