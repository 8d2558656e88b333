"""Importance resampling against plain formulas, and on edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import importance as im
from cohortline.llm.queries import op13_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(crc32(r.encode()) % 10_000 for r in runs)


def expected(docs, benchmark):
    """(n_features, weight, score, rank) of each row, by the formulas of the contract."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in benchmark:
        t.update(grams(text)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole_s + 10_000) / ((s[b] + 1) * (whole_t + 10_000)))) for b in range(10_000)]
    out, open_ = [], []
    for key, text in docs:
        n_words, found = grams(text)
        weight = sum(gain[b] * n for b, n in found.items())
        h = int(sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, sum(found.values()), weight, score, None])
        if n_words >= 20:
            open_.append(out[-1])
    open_.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(open_[: 5 * len(open_) // 100], 1):
        row[4] = rank
    return Counter(tuple(r) for r in out)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    benchmark = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in op13_importance(spark, folder).collect()) == expected(docs, benchmark)


def test_odd_texts_ties_and_wide_keys(frame):
    pick = random.Random(4)
    words = ["a", "B", "c1", "é", "ÀB", "x\x00y", "ß", "漢字", "don't", " z"]
    seps = [" ", "\n", "--", "\x00", "\x7f", "`", "{", "/"]
    def text():
        return pick.choice(seps) * pick.randrange(2) + pick.choice(seps).join(pick.choice(words) for _ in range(pick.randrange(70)))

    docs = [(i, text()) for i in range(300)] + [(2**53 + 1, "w " * 30), (2**63 - 1, "w " * 30), (None, "w " * 30), (None, None), (7, None), (8, ""), (9, "one")]
    docs += docs[:5]
    benchmark = [text() for _ in range(20)] + [None]
    ranked = im.resample(frame(docs, "doc_id bigint, text string").repartition(4), frame([(b,) for b in benchmark], "text string"))
    assert Counter(tuple(r) for r in ranked.drop("mark").collect()) == expected(docs, benchmark)


def test_drawn_documents(frame):
    docs = frame([(i % 50, f"{'alpha beta ' * 15} {i % 50}", i) for i in range(200)], "doc_id bigint, text string, rank int")
    ranked = im.resample(docs, frame([("alpha",)], "text string"), share=(1, 4))
    drawn = im.drawn_documents(docs, ranked).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 51)) and set(drawn[0].asDict()) == {"doc_id", "text", "rank"}
    at = {r["rank"]: r["doc_id"] for r in ranked.filter("rank IS NOT NULL").collect()}
    assert all(at[r["rank"]] == r["doc_id"] for r in drawn)


def test_packed_counts_round_trip():
    pick = np.random.default_rng(1)
    for size in (0, 1, 5, 3000):
        numbers = pick.integers(0, 10_000, size)
        assert im.unpack_counts(im.pack_counts(numbers)).tolist() == sorted(numbers.tolist())


@pytest.mark.parametrize("name", ["key", "mark", "n_words", "features", "weight", "open", "row", "down", "shut", "none", "__bucket", "place"])
def test_columns_that_clash(frame, name):
    docs = frame([(1, "a " * 25), (2, None)], "doc_id bigint, text string").withColumn(name, F.lit("x"))
    assert im.resample(docs, frame([("a",)], "text string")).count() == 2


def test_empty_tables_and_long_text(frame):
    empty, some = frame([], "doc_id bigint, text string"), frame([(1, "word " * 300_000)], "doc_id bigint, text string")
    target = frame([], "text string")
    assert im.resample(empty, target).collect() == []
    row = im.resample(some, target).collect()[0]
    assert row["n_features"] == 899_997 and row["rank"] is None
