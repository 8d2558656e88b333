"""Near-duplicate work holds bounded bytes of text in a task, however long the rows; its results do not depend on the bound."""

from __future__ import annotations

import tracemalloc

import numpy as np

import corpus_pipeline
from cohortline.llm import near_dedup, packing, shingles as sh, text

BANDS = 22


def long_texts(n, words):
    draw = np.random.default_rng(3)
    return [" ".join(f"w{x}" for x in draw.integers(0, 5000, words)) for _ in range(n)]


def test_signatures_take_bounded_memory():
    texts = long_texts(60, 15_000)
    assert sum(map(len, texts)) > 4_000_000
    sh._tables = sh._tables[0][:1], sh._tables[1][:1]
    tracemalloc.start()
    near_dedup.signatures(texts, BANDS, near_dedup.ROWS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48_000_000 and 2 * len(sh._tables[0]) * 8 <= 16_000_000


def test_grouping_changes_no_signature(monkeypatch):
    texts = ["", "one", *long_texts(40, 700), "a b c d e " * 30, "word " * 200_000]
    small = near_dedup.signatures(texts, BANDS, near_dedup.ROWS), near_dedup.describe(texts)
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", 50_000_000)
    large = near_dedup.signatures(texts, BANDS, near_dedup.ROWS), near_dedup.describe(texts)
    assert all(np.array_equal(a, b) for a, b in zip(small[0], large[0], strict=True))
    assert all(np.array_equal(a, c) and np.array_equal(b, d) for (a, b), (c, d) in zip(small[1], large[1], strict=True))


def largest_batch(spark, monkeypatch, module, stage, docs):
    """The most bytes that ``stage`` got in one Arrow batch through ``module.map_rows``; the batches tell by an accumulator."""
    seen, plain = spark.sparkContext.accumulator(0), text.map_rows
    most = 5_000_000

    def watched(df, keep, work, added):
        def measured(columns):
            if sum(c.nbytes for c in columns.values()) > most:
                seen.add(1)
            yield from work(columns)

        return plain(df, keep, measured, added)

    monkeypatch.setattr(module, "map_rows", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    n = stage(spark, docs, "").count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    return seen.value, n


def test_stages_get_small_batches(spark, frame, monkeypatch):
    rows = [(i, t) for i, t in enumerate(long_texts(300, 6000))]
    docs = frame(rows, "doc_id long, text string").coalesce(1)
    assert sum(len(t) for _, t in rows) > 9_000_000
    assert largest_batch(spark, monkeypatch, near_dedup, corpus_pipeline.near_stage, docs) == (0, 300)
    assert largest_batch(spark, monkeypatch, packing, corpus_pipeline.packing_stage, docs)[0] == 0
