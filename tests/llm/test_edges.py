"""Each corpus operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import exact_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, substring_dedup, toxicity, warc
from cohortline.llm.queries import VOCABULARY

LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, kept string, n_words string, epoch string, shard string"
ROWS = [
    (1, "one two  three\nfour", "en", "src0", "x", "y", "z", "s"),
    (2, "one two three four", "en", "src0", "x", "y", "z", "s"),
    (2, "one two three four", "en", "src0", "x", "y", "z", "s"),
    (3, None, None, None, None, None, None, None),
    (4, "", "", "", "", "", "", ""),
    (None, " \n\t", "de", "src1", "x", "y", "z", "s"),
    (None, f"start of a text\n{PASSAGE}", "de", "src1", "x", "y", "z", "s"),
    (5, f"{PASSAGE}\nits end", "fr", "src12", "x", "y", "z", "s"),
    (6, LONG, "fr", "src12", "x", "y", "z", "s"),
    (7, LONG + " more", "fr", "odd", "x", "y", "z", "s"),
    (8, "é" * 5000, "fr", "odd", "x", "y", "z", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_exact_duplicates(docs, none):
    got = collected(exact_dedup.with_duplicates(docs))
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["keep_id"] == 1 and by_id[1]["group_size"] == 3 and by_id[1]["kept"] is True
    assert [r["keep_id"] for r in got if r["doc_id"] == 2] == [1, 1]
    assert by_id[3]["keep_id"] == by_id[4]["keep_id"] == 3 and by_id[3]["group_size"] == 2
    assert by_id[6]["group_size"] == 1
    assert sum(r["kept"] for r in got) == len({(r["text_sha256"]) for r in got})
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert exact_dedup.with_duplicates(none).count() == 0
    repeated = docs.filter("doc_id = 2")
    assert sorted(r["kept"] for r in collected(exact_dedup.with_duplicates(repeated))) == [False, True]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 1, 2, 3], [7, 1 << 20, 1 << 47], list(range(0, 100_000, 37))])
def test_golomb_round_trip(values):
    assert exact_dedup.decode(exact_dedup.encode(np.array(values, np.int64))).tolist() == values


def test_quality_rules(docs, none):
    got = collected(quality_rules.judge(docs).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept", "failed_rule"))
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["n_words"] == by_id[4]["n_words"] == 0 and by_id[3]["failed_rule"] == "base"
    assert by_id[6]["n_words"] == 30_000 and by_id[6]["failed_rule"] == "letters"  # over half digits
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in got)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    df = spark.range(100).select("id", F.lit(100).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_repeat_words"))
    many, few = F.col("id") < 50, F.col("id") < 10
    rules = [quality_rules.Rule("few", few, F.lit(1.0)), quality_rules.Rule("dear", many, F.lit(100.0)), quality_rules.Rule("many", many, F.lit(1.0))]
    assert [r.name for r in quality_rules.order_rules(df, rules)] == ["many", "few", "dear"]
    assert [r.name for r in quality_rules.order_rules(df.limit(0), rules)] == ["few", "dear", "many"]
    # With measured rates a rule that is dear by its units may come first.
    assert [r.name for r in quality_rules.order_rules(df, rules, [1.0, 1e-9, 1.0])][0] == "dear"
    rates = quality_rules.measured_rates(df, rules)
    assert len(rates) == 3 and all(rate > 0 for rate in rates)
    first = df.select(quality_rules.first_failure(rules).alias("f")).groupBy("f").count().collect()
    assert {r["f"]: r["count"] for r in first} == {"few": 10, "dear": 40, None: 50}


def test_near_duplicates(docs, none):
    got = collected(near_dedup.with_classes(docs))
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["class_id"] == 1 and by_id[1]["class_size"] == 3
    assert by_id[6]["class_id"] == by_id[7]["class_id"] == 6 and by_id[6]["kept"] and not by_id[7]["kept"]
    assert by_id[3]["class_id"] == by_id[4]["class_id"] == 3
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert near_dedup.drop_near_duplicates(docs.filter("doc_id = 2")).count() == 1
    assert near_dedup.with_classes(none).count() == 0


def test_substrings(docs, none):
    got = {r["doc_id"]: r for r in collected(substring_dedup.repeated_spans(docs)) if r["doc_id"] is not None}
    assert got[5]["n_removed"] == 0  # the document with a null key comes last
    clean = {r["doc_id"]: r["text"] for r in collected(substring_dedup.remove_repeats(docs)) if (r["text"] or "").startswith("start")}
    assert clean == {None: "start of a text\n"}
    assert got[2]["n_removed"] == got[3]["n_removed"] == 0
    assert got[7]["n_removed"] == 1 and got[7]["spans"][0]["end"] == len(LONG) + 5
    assert substring_dedup.remove_repeats(docs).columns == docs.columns
    assert substring_dedup.repeated_spans(none).count() == 0


def test_packing(docs, none):
    packed = packing.pack(docs, VOCABULARY, with_ids=True)
    got = collected(packed)
    per_row = {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= packing.WINDOW
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        per_row.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert {r["doc_tokens"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert len([r for r in got if r["doc_id"] == 2]) == 2
    whole = sorted(per_row[(6, max(t for i, t in per_row if i == 6))], key=lambda r: r["start"])
    assert sum(r["length"] for r in whole) == whole[0]["doc_tokens"] and whole[-1]["ids"][-1] == packing.END_ID
    for row in packing.sequences(packed).collect():
        assert len(row["ids"]) == sum(r["length"] for r in got if r["sequence_id"] == row["sequence_id"]) <= packing.WINDOW
    assert packing.pack(none, VOCABULARY).count() == 0


def test_best_fit_is_the_tightest_window():
    rng = np.random.default_rng(5)
    for window in (1, 7, 64, 2048):
        lengths = sorted(rng.integers(1, window + 1, 300).tolist(), reverse=True)
        free, expected = [], []
        for n in lengths:
            fitting = [f for f in free if f >= n]
            if n < window and fitting:
                best = min(fitting)
                free[free.index(best)] = best - n
            else:
                free.append(window - n)
            expected.append(sorted(free))
        placed = packing.best_fit_decreasing(lengths, window)
        left = {}
        for (name, offset), n in zip(placed, lengths):
            assert offset == left.get(name, 0)
            left[name] = offset + n
        assert sorted(window - v for v in left.values()) == expected[-1]


def test_mixing(docs, none):
    domain, weights = F.lit("all"), {"source": {"src0": 3}}
    got = collected(mixing.mix(docs, domain, weights, budget=40, max_epochs=2))
    assert sum(r["take_tokens"] for r in got) == 40
    assert mixing.mix(none, domain, weights).count() == 0
    everything = collected(mixing.mix(docs, domain, {}, budget=10**9, max_epochs=2))
    assert sum(r["take_tokens"] for r in everything) == 2 * sum(len((r[1] or "").split()) for r in ROWS)
    cut = mixing.cut_texts(mixing.mix(docs, domain, weights, budget=40, max_epochs=2))
    assert all(len((r["text"] or "").split()) == r["take_tokens"] for r in collected(cut))


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "en", "s1", 1, 10), ("a", "en", "s2", 1, 1000), ("a", "de", "s1", 1, 1000), ("b", "en", "s1", 1, 1000)],
        "domain string, lang string, source string, n_docs long, tokens long",
    )
    got = {(r["domain"], r["lang"], r["source"]): r["share"] for r in collected(mixing.leaf_budgets(leaves, {}, 800, 1))}
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("a", "de", "s1"): 200, ("b", "en", "s1"): 400}
    got = {(r["domain"], r["lang"], r["source"]): r["share"] for r in collected(mixing.leaf_budgets(leaves, {"domain": {"b": 0}}, 5000, 1))}
    assert got[("a", "de", "s1")] == 1000 and got[("b", "en", "s1")] == 0


def test_personal_data(docs, none, spark):
    text = "mail a.b@x-1.example.com or é@x.y 10.0.0.256 1.2.3.4 and 4539578763621486 +1 (705) 555-1902 password=abc123def456"
    df = spark.createDataFrame([(1, text), (1, text), (2, None), (None, "")], "doc_id long, text string")
    got = collected(pii.digest_columns(pii.find_personal_data(df)))
    first = [r for r in got if r["doc_id"] == 1]
    assert len(got) == 4 and first[0] == first[1]
    assert [first[0][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1]
    assert [r["spans"] for r in got if r["doc_id"] != 1] == ["", ""]
    assert pii.find_personal_data(docs).count() == len(ROWS)
    assert pii.find_personal_data(none).count() == 0


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.85, 0.55]
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth).astype(int) for p in right], axis=1)
    votes[rng.random(votes.shape) < 0.1] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, estimated = pii.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(estimated - right).max() < 0.05
    chosen = {tuple(p): q > 0.5 for p, q in zip(patterns.tolist(), posterior)}
    assert np.mean([chosen[tuple(v)] == t for v, t in zip(votes.tolist(), truth)]) > 0.95


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, None), (9, 1)], "doc_id long, toxic int")
    assert toxicity.grade_documents(docs, labels).count() == 0  # no toxic row can be read
    rng = np.random.default_rng(2)
    words = [a + b for a in "abcdefg" for b in "klmnopqr"]
    rows = []
    for i in range(300):
        grade = i % 3
        rows.append((rng.choice(words, 40).tolist() + ["vile"] * (3 * grade), grade))
    model = toxicity.fit(rows)
    assert (np.diff(model.cuts) > 0).all()
    above = model.above(np.array([model.score(" ".join(w)) for w, _ in rows]))
    assert np.mean(np.rint(above.sum(axis=1)) == [g for _, g in rows]) > 0.95
    got = collected(toxicity.predict(docs, model))
    assert len(got) == len(ROWS) and all(0 <= r["severity"] <= 2 for r in got)
    assert toxicity.predict(none, model).count() == 0


def test_quality_by_sites(docs, none, spark):
    text = ["plain words in a row, as they should be. "] * 5
    rows = [(i, "".join(text) if i % 4 else "| a | $$ | BB | " * 12, f"h{i % 3}", "p") for i in range(120)]
    df = spark.createDataFrame([*rows, (None, None, None, None), (0, "", "sparse", "x")], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)], "doc_id long, quality int")
    got = collected(quality_classifier.score_documents(df, labels, F.col("host"), F.col("path")))
    assert len(got) == 122
    assert all(r["kept"] == (r["doc_id"] % 4 > 0) for r in got if r["host"].startswith("h"))
    sparse = next(r for r in got if r["host"] == "sparse")
    centre = np.mean([r["p_document"] for r in got])
    assert abs(sparse["p_path"] - centre) < 0.05
    assert quality_classifier.score_documents(df, labels.limit(0), F.col("host"), F.col("path")).count() == 0
    assert quality_classifier.score_documents(df.limit(0), labels, F.col("host"), F.col("path")).count() == 0


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/x", "same"), (2, "http://a/y z", "same"), (2, "http://a/y z", "same"), (3, None, None), (None, "u", ""), (4, "u", "a\r\n\r\nWARC/1.1\r\n\r\né")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_captures(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"), payloads=True)
    assert records.count() == 3 * len(rows)
    got = [(r["metadata"]["fields"].get("pageid"), r["type"], (r["original"] or {}).get("pageid"), r["payload_bytes"], bytes(r["payload"] or b"").decode()) for r in collected(warc.assemble(records))]
    assert sorted(got, key=str) == sorted(
        [("1", "revisit", "2", 4, ""), ("2", "response", None, 4, "same"), ("2", "response", None, 4, "same"), ("3", "response", None, 0, ""), ("", "revisit", "3", 0, ""), ("4", "response", None, 19, rows[5][2])],
        key=str,
    )
    assert all(r["payload_digest"] == r["stated_digest"] for r in collected(records) if r["type"] in ("response", "revisit"))
    warc.write_captures(pages.limit(0), str(tmp_path / "none"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "none"))).count() == 0
