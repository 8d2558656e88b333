"""Whole results of the operators without SQL, and of the pipeline's stages, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortline.llm import near_dedup, pii, quality_classifier, quality_rules
from cohortline.llm.queries import VOCABULARY, op2_packing, op10_pii

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def texts_of(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# ---------------------------------------------------------------- near duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def alike(x, y):
    """Whether plain or probability Jaccard similarity reaches 0.8, by their definitions."""
    if not x or not y:
        return not x and not y
    common = x.keys() & y.keys()
    if len(common) >= 0.8 * len(x.keys() | y.keys()):
        return True
    if len(common) < 0.3 * min(len(x), len(y)):
        return False
    every = list(x.keys() | y.keys())
    a = np.array([1 + math.log(x[s]) if s in x else 0.0 for s in every])
    b = np.array([1 + math.log(y[s]) if s in y else 0.0 for s in every])
    total = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero((a > 0) & (b > 0)))
    return total >= 0.8


def classes(texts):
    """The least key of every document's class: components of all pairs that are alike."""
    keys = sorted(texts)
    sets = {k: shingles(texts[k]) for k in keys}
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = defaultdict(list)
    for k in keys:
        for s in sets[k] or [None]:
            holders[s].append(k)
    seen = set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if alike(sets[a], sets[b]):
                        ra, rb = sorted((root(a), root(b)))
                        parent[rb] = ra
    return {k: root(k) for k in keys}


def planted(seed=3):
    """Groups of copies with a few words changed, dozens of unlike texts around one passage, repeats, short and empty texts."""
    pick = random.Random(seed)

    def words(n):
        return ["".join(pick.choice("abcdefghij") for _ in range(pick.randrange(2, 7))) for _ in range(n)]

    out = []
    for size, changes in ((12, 1), (25, 2), (40, 4), (30, 6)):
        base = words(120)
        for _ in range(size):
            copy = list(base)
            for _ in range(pick.randrange(changes + 1)):
                copy[pick.randrange(len(copy))] = words(1)[0]
            out.append(" ".join(copy))
    passage = words(60)
    out += [" ".join(words(20) + passage + words(20)) for _ in range(45)]
    block = words(25)
    out += [" ".join(words(1) + block * n + words(1)) for n in (2, 2, 3, 6, 9)]
    out += ["", " \n", "one", "one", "one two", "a b c d", "a b c d e", "a  b\tc d e"]
    out += [out[i] + " " for i in (0, 3, 5, 50)]
    pick.shuffle(out)
    return dict(enumerate(out))


def test_near_duplicate_classes_equal_all_pairs(frame):
    texts = planted()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.with_classes(frame(list(texts.items()), SCHEMA).repartition(6)).collect()}
    assert got == classes(texts)


def test_near_duplicate_classes_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = near_dedup.with_classes(docs).collect()
    want = classes(texts_of(spark))
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


# ---------------------------------------------------------------- packing


def check_packed(rows, texts):
    """Every id of every text in exactly one piece, and sequences gapless from 0, within the window and with little padding."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    used = sum(r["length"] for r in rows)
    assert len(sequences) <= math.ceil(used / 2048) + 2


def test_packed_ids_of_a_whole_table(spark):
    check_packed(op2_packing(spark, SMALL).collect(), texts_of(spark))


# ---------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
            luhn = sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            right = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if right:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


ODD = [
    "a.b@c.d.e@f.g x@y z@-.- %@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1..2.3.4 12.3.4", "4111 1111 1111 1111-4111111111111111",
    "+1 (234) 567-8901, +12 34 ++49 30 1234567 +1..........2", "٣.1.2.3.4 é@é.de a@b.cé", "79927398713 0000000000000000 5500-0000-0000-0004",
]


def test_base_spans_equal_the_patterns(spark):
    for text in [*texts_of(spark).values(), *ODD]:
        assert pii.base_spans(text) == base_spans(text)


def test_personal_data_of_a_whole_table(spark):
    found = {r["doc_id"]: r for r in op10_pii(spark, SMALL).collect()}
    for key, text in texts_of(spark).items():
        spans = base_spans(text)
        assert [found[key][f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in spans) for k in PATTERNS]
        all_ = found[key]["spans"].split(",") if found[key]["spans"] else []
        assert [s for s in all_ if not s.startswith("secret")] == [f"{k}:{a}:{b}" for a, b, k in spans]


# ---------------------------------------------------------------- quality by sites


def test_posteriors_by_plain_formulas(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.score_documents(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()

    def logit(p):
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p))

    def concentration(groups, middle):
        """Pseudo-counts from the spread of group means about their prior, beyond what their sizes explain."""
        big = {g: v for g, v in groups.items() if len(v) >= 2}
        n = sum(map(len, big.values()))
        if not n:
            return 10.0
        spread = sum(len(v) * (np.mean(v) - middle(g)) ** 2 for g, v in big.items())
        noise = sum(max(np.mean(np.square(v)) - np.mean(v) ** 2, 0) for v in big.values())
        most = np.mean([middle(g) * (1 - middle(g)) for g in big])
        return float(np.clip(most / max((spread - noise) / n, 1e-6) - 1, 1, 1e4))

    hosts, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        hosts[r["host"]].append(r["p_document"])
        paths[r["host"], r["path"]].append(r["p_document"])
    middle = np.mean([r["p_document"] for r in rows])
    k_host = concentration(hosts, lambda g: middle)
    shrunk = {h: (sum(v) + k_host * middle) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = concentration(paths, lambda g: shrunk[g[0]])
    # The evidence is the document's logit less the one prior of the fitted rows, the same for all.
    shifts = set()
    for r in rows:
        own, host, path = r["p_document"], hosts[r["host"]], paths[r["host"], r["path"]]
        p_host = (sum(host) - own + k_host * middle) / (len(host) - 1 + k_host)
        p_path = (sum(path) - own + k_path * p_host) / (len(path) - 1 + k_path)
        assert (r["p_host"], r["p_path"]) == (pytest.approx(p_host, rel=1e-6), pytest.approx(p_path, rel=1e-6))
        if 1e-4 < own < 1 - 1e-4 and 1e-6 < r["p_quality"] < 1 - 1e-6:
            shifts.add(round(logit(own) - (math.log(r["p_quality"] / (1 - r["p_quality"])) - logit(p_path)), 4))
        assert r["kept"] == (r["p_quality"] >= 0.5)
    assert len(shifts) == 1


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stage_by_stage(spark):
    docs, stages = spark.read.parquet(f"{SMALL}/documents.parquet"), dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, SMALL)
    good = {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    rows = first.collect()
    assert {r["doc_id"] for r in rows} == good and first.columns == docs.columns

    second = stages["exact_dedup"](spark, first, SMALL)
    least = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    rows = second.collect()
    assert {r["doc_id"] for r in rows} == set(least.values()) and len(rows) == len(least)

    third = stages["near_dedup"](spark, second, SMALL)
    want = classes({r["doc_id"]: r["text"] or "" for r in rows})
    rows = third.collect()
    assert {r["doc_id"] for r in rows} == set(want.values()) and len(rows) == len(set(want.values()))

    fourth = stages["mixing"](spark, third, SMALL)
    by_key = {r["doc_id"]: r["text"] or "" for r in rows}
    mixed = fourth.collect()
    assert fourth.columns == docs.columns
    for r in mixed:
        words, whole = (r["text"] or "").split(), by_key[r["doc_id"]].split()
        assert words == whole[: len(words)]
    tokens = sum(len(t.split()) for t in by_key.values())
    assert sum(len((r["text"] or "").split()) for r in mixed) == pytest.approx(tokens, rel=0.01)

    packed = stages["packing"](spark, third, SMALL).collect()
    check_packed(packed, by_key)


def test_pipeline_on_odd_rows(spark, frame, tmp_path):
    good = "Seven quiet wizards mix strong potions while every brave knight of our small town watches them from far behind an old stone wall, and nobody dares say one word."
    rows = [(1, good, "en", "site1", 3), (2, good, "en", "site1", 3), (None, None, None, None, None), (3, "", "", "", 0), (2**53 + 1, good + " More.", None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, some in (("odd", rows), ("none", [])):
        frame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} <= {1, 2**53 + 1} and bool(out) == bool(some)
