"""Texts alike by their distinct shingles share a band although one of them repeats many."""

from __future__ import annotations

import numpy as np

from cohortline.llm import near_dedup, shingles as sh


def pair(i, repeats=25):
    """Two texts of plain Jaccard similarity just over 0.8, the second of which repeats a block."""
    shared = [f"s{i}_{j}" for j in range(420)]
    first = [f"a{i}_{j}" for j in range(45)] + shared
    second = shared + [f"b{i}_{j}" for j in range(40)]
    return " ".join(first), " ".join(second + shared[:110] * repeats)


def test_pairs_alike_but_for_a_repeated_block_meet():
    bands = sh.tune_bands(near_dedup.SIMILARITY, near_dedup.RECALL, near_dedup.ROWS)
    texts = [t for i in range(400) for t in pair(i)]
    keys = near_dedup.signatures(texts, bands, near_dedup.ROWS)
    known = near_dedup.describe(texts)
    weighted = [sh.probability_jaccard(*known[i], *known[i + 1]) for i in range(0, len(texts), 2)]
    assert all(sh.set_jaccard(known[i][0], known[i + 1][0]) >= 0.8 for i in range(0, len(texts), 2)) and max(weighted) < 0.7
    assert all(np.intersect1d(keys[i], keys[i + 1]).size for i in range(0, len(texts), 2))


def test_text_without_words_or_repeats():
    none, plain, repeated = near_dedup.signatures(["", "a b c d e f g", "a b c d e " * 3], 5, 4)
    assert (len(none), len(plain), len(repeated)) == (0, 5, 10)


def test_repeated_block_is_linked(spark):
    docs = spark.createDataFrame([(2 * i + k, t) for i in range(60) for k, t in enumerate(pair(i))], "doc_id long, text string")
    got = near_dedup.with_classes(docs).collect()
    assert len(got) == 120 and all(r["class_id"] == r["doc_id"] // 2 * 2 and r["class_size"] == 2 for r in got)
