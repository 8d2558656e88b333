"""Repeated byte strings against a brute-force count of all windows, and on edge cases."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cohortline.llm import suffix_dedup as sd
from cohortline.llm.queries import op11_suffix_dedup

SCHEMA = "doc_id bigint, text string"


def expected(rows, window):
    """A row per document, from a table of all windows."""
    texts = [(key, (text or "").encode()) for key, text in rows]
    seen = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for key, t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                covered[i : i + window] = b"\x01" * window
        kept = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((key, len(t), sum(covered), spans, sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def planted(seed, documents=250, alphabet="abcdefgh é\n", passage=90):
    """Documents of unlike letters that share passages, whole or cut short, besides copies of whole documents and runs of one letter."""
    pick = random.Random(seed)

    def letters(n):
        return "".join(pick.choice(alphabet) for _ in range(n))

    passages = [letters(pick.randrange(20, 2 * passage)) for _ in range(12)]
    common, rows = letters(passage), []
    for i in range(documents):
        text = letters(pick.randrange(120))
        for _ in range(pick.randrange(3)):
            p = pick.choice(passages)
            text += p[pick.randrange(len(p) // 2) :] + letters(pick.randrange(60))
        if i % 3 == 0:
            text += common + letters(pick.randrange(50))
        rows.append((i, text + pick.choice(["", "", "z" * pick.randrange(200), "xy" * pick.randrange(90)])))
    rows += [(1000 + i, rows[pick.randrange(documents)][1]) for i in range(60)] + [(2000 + i, rows[5][1]) for i in range(80)]
    return rows + [(None, rows[7][1]), (None, None), (2**53 + 1, ""), (2**63 - 1, "ab" * 100), (5, "kurz"), (5, "kurz")]


@pytest.mark.parametrize("most", [4096, 12])
@pytest.mark.parametrize("window", [40, 25])
def test_equals_all_windows(frame, window, most):
    rows = planted(window)
    df = frame(rows, SCHEMA).repartition(5)
    assert got(sd.repeated_spans(df, window=window, most=most)) == expected(rows, window)


def test_few_letters_and_tiny_windows(frame):
    for window in (1, 3, 9):
        rows = [(i, t) for i, t in enumerate(["abababab", "ab", "", "bbbbbbbbbbbbbb", "abcabcabcabc", "aabb", "q", "abcabcabc", "qrstuvwxyz" * 2])]
        assert got(sd.repeated_spans(frame(rows, SCHEMA), window=window)) == expected(rows, window)


def test_hot_buckets_end_with_single_windows(frame):
    # One passage just as long as a window in 300 documents, whose bytes around it all differ.
    pick = random.Random(8)
    passage = "".join(pick.choice("klmnop") for _ in range(60))
    rows = [(i, "".join(pick.choice("abcdef") for _ in range(70)) + passage + "".join(pick.choice("uvwxyz") for _ in range(70))) for i in range(300)]
    for length in (60, 50):
        assert got(sd.repeated_spans(frame(rows, SCHEMA), window=length, most=5)) == expected(rows, length)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = got(op11_suffix_dedup(spark, folder))
    assert found == expected(rows, 400) and sum(r[2] for r in found) > 0


def test_parts_of_long_texts(frame, monkeypatch):
    pick = random.Random(2)
    text = "".join(pick.choice("abcdefghij") for _ in range(9000))
    rows = [(1, text), (2, text[2000:7000]), (3, "k" * 3000), (4, text[:30])]
    for part in (1 << 19, 700):
        monkeypatch.setattr(sd, "PART_BYTES", part)
        texts = [t.encode() for _, t in rows]
        for found, t in zip(sd.describe(texts, 50), texts):
            assert sum(found["sizes"].tolist()) == max(0, len(t) - 49)
    assert got(sd.repeated_spans(frame(rows, SCHEMA), window=50)) == expected(rows, 50)


def test_million_bytes_of_one_letter(frame):
    rows = [(1, "a" * 1_000_000), (2, "b")]
    assert got(sd.repeated_spans(frame(rows, SCHEMA))) == Counter([(1, 1_000_000, 1_000_000, 1, sha256(b"").hexdigest()), (2, 1, 0, 0, sha256(b"b").hexdigest())])


def test_remaining_texts_and_clashing_columns(frame):
    rows = [(1, "é" * 30 + "tail"), (1, "head" + "é" * 30), (2, "nothing here"), (None, None)]
    names = ["key", "body", "sender", "seq", "digest", "mark", "twin", "spans", "kept", "doc", "start", "n_bytes"]
    df = frame(rows, SCHEMA).withColumns({n: F.col("doc_id") for n in names})
    left = sd.without_repeats(df, window=21)
    assert left.columns == df.columns
    assert sorted(str(r["text"]) for r in left.collect()) == ["None", "head", "nothing here", "tail"]


def test_empty_table_leaves_nothing_behind(spark, frame):
    tables = len(spark.catalog.listTables())
    assert sd.repeated_spans(frame([], SCHEMA)).collect() == []
    assert len(spark.catalog.listTables()) == tables
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
