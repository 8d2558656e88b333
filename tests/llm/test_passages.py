"""Repeated passages that lie inside lines or are wrapped in short ones, against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from cohortline.llm import shingles as sh
from cohortline.llm import substring_dedup
from cohortline.llm.components import _shared_buckets

WIDTH = substring_dedup.MIN_WORDS


def spans_by_hand(texts):
    """For texts without near-equal lines: the words of every run that came before, less those of a run's own first."""
    first, out = {}, []
    for d, text in enumerate(texts):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        spans = []
        for p in range(len(words) - WIDTH + 1):
            run = tuple(text[a:b] for a, b in words[p : p + WIDTH])
            of, at = first.setdefault(run, (d, p))
            if (of, at) != (d, p):
                begin, end = words[max(p, at + WIDTH) if of == d else p][0], words[p + WIDTH - 1][1]
                if spans and begin < spans[-1][1]:
                    spans[-1][1] = end
                else:
                    spans.append([begin, end])
        out.append([tuple(s) for s in spans])
    return out


def got(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring_dedup.repeated_spans(docs).collect()
    assert all(r["n_removed"] == len(r["spans"]) for r in rows)
    return [[(s["start"], s["end"]) for s in r["spans"]] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_passages_inside_and_across_lines(spark):
    passage = [f"käse{i}" for i in range(50)]
    own = iter(f"own{i}" for i in range(1000))
    take = lambda n: [next(own) for _ in range(n)]
    wrapped = "\n".join(" ".join(passage[i : i + 9]) for i in range(0, 50, 9))
    whole = " ".join(passage)
    texts = [
        " ".join(take(60) + passage + take(60)),
        " ".join(take(70)) + f" {whole} " + " ".join(take(70)),
        " ".join(take(8)) + f"\n{wrapped}\n" + " ".join(take(8)),
        " ".join(take(40)) + " " + " ".join(passage[:25]) + "\n\n" + " ".join(passage[25:]) + " " + " ".join(take(40)),
        " ".join(take(30) + passage[: WIDTH - 1] + take(30)),
    ]
    found = got(spark, texts)
    assert found == spans_by_hand(texts)
    assert [len(s) for s in found] == [0, 1, 1, 1, 0]
    assert [texts[d][a:b].split() for d in (1, 2, 3) for a, b in found[d]] == [passage] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"].split() for r in substring_dedup.remove_repeats(docs).collect()}
    for d, text in enumerate(texts):
        cut = [w for w in text.split() if w not in passage] if d in (1, 2, 3) else text.split()
        assert left[d] == cut


def test_many_planted_passages(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    pool = [rng.choice(words, int(n)).tolist() for n in rng.integers(20, 90, 25)]
    common = rng.choice(words, 35).tolist()
    texts = []
    for d in range(300):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            parts += rng.choice(words, int(rng.integers(5, 60))).tolist()
            parts += pool[int(rng.integers(len(pool)))] if rng.random() < 0.4 else []
            parts += common if rng.random() < 0.3 else []
        breaks = rng.integers(3, 18, len(parts)).cumsum()
        texts.append(" ".join(("\n" if i in set(breaks.tolist()) else "") + w for i, w in enumerate(parts)))
    texts += ["so " * 100, "a b c " * 40 + "end", "", " \n"]
    assert sum(map(len, spans_by_hand(texts))) > 200
    assert got(spark, texts) == spans_by_hand(texts)


def test_long_lines_are_cut_by_their_content():
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in rng.integers(0, 500, 300)]
    pieces = []
    for before, after in ((200, 90), (57, 310)):
        words = [f"w{i}" for i in rng.integers(0, 10**6, before)] + passage + [f"w{i}" for i in rng.integers(0, 10**6, after)]
        body = " ".join(words)
        _, hashes = sh.words([body.encode()])
        found = substring_dedup.paragraphs(body.encode(), hashes, substring_dedup.CUT)
        assert [body[a:b].split() for a, b, _ in found] and sum(found[:, 2]) == len(words)
        pieces.append({body[a:b] for a, b, _ in found})
    assert len(pieces[0] & pieces[1]) >= 2
    short = "\n".join([" ".join(["a"] * 128), "", " b c "]).encode()
    assert substring_dedup.paragraphs(short, sh.words([short])[1], substring_dedup.CUT)[:, 2].tolist() == [128, 2]


def test_near_equal_passages_inside_long_lines(spark):
    rng = np.random.default_rng(6)
    own = lambda n: [f"o{i}" for i in rng.integers(0, 10**7, n)]
    passage = own(400)
    changed = [f"new{i}" if i % 90 == 45 else w for i, w in enumerate(passage)]
    texts = [" ".join(own(150) + passage + own(150)), " ".join(own(170) + changed + own(160)), " ".join(own(300))]
    first, second, third = got(spark, texts)
    assert first == third == []
    left = "".join(texts[1][b:a] for (_, b), (a, _) in zip([(0, 0), *second], [*second, (len(texts[1]), 0)])).split()
    assert not set(left) & set(passage)
    assert sum(w.startswith("new") for w in left) < sum(w.startswith("new") for w in changed)
    assert sum(w.startswith("o") for w in left) == 330


def test_buckets_and_runs_that_go_on_in_the_next_batch(spark, frame):
    rng = random.Random(8)
    items = [(i, b) for i in range(60) for b in rng.sample(range(40), 3)] + [(i, 99) for i in range(50)]
    passage = " ".join(f"p{i}" for i in range(45))
    docs = frame([(i, f"own{i} " + passage + f" end{i} " + " ".join(f"w{rng.randrange(9)}" for _ in range(60))) for i in range(12)], "doc_id bigint, text string")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(setting), []
    try:
        for most in ("10000", "7"):
            spark.conf.set(setting, most)
            shared = _shared_buckets(frame(items, "id bigint, bucket bigint"))
            plan = shared._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Join" not in plan
            sizes = Counter(b for _, b in items)
            assert Counter(map(tuple, shared.collect())) == Counter((i, b, sizes[b]) for i, b in items if sizes[b] > 1)
            spans = substring_dedup.repeated_spans(docs).collect()
            found.append(sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in spans))
    finally:
        spark.conf.set(setting, before)
    assert found[0] == found[1] and all(spans for doc, spans in found[0] if doc)


def test_paragraphs_of_a_batch_are_those_of_its_texts():
    rng = random.Random(9)
    texts = ["", " \n\n", "a b\r\nc éè d\n\n e", " ".join(f"w{rng.randrange(50)}" for _ in range(500)) + "\n x", "€ z"]
    texts = [t.encode() for t in texts]
    number, word = sh.words(texts)
    found = substring_dedup.all_paragraphs(texts, number, word, substring_dedup.CUT)
    for i, text in enumerate(texts):
        alone = substring_dedup.paragraphs(text, sh.words([text])[1], substring_dedup.CUT)
        assert found[found[:, 0] == i, 1:].tolist() == alone.tolist()
        for start, end, size in alone.tolist():
            assert len(text.decode()[start:end].split()) == size


def test_repeated_anchors_meet_in_one_shuffle(spark, frame):
    rng = random.Random(10)
    points = [(rng.choice([None, 2**53 + 1, 7]), i, i % 5, rng.randrange(-60, 60)) for i in range(100)] + [(1, 200 + i, 0, 99) for i in range(30)]
    sizes = Counter(p[3] for p in points)
    assert 1 in sizes.values()
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for most in ("10000", "7", "1"):
            spark.conf.set(setting, most)
            found = substring_dedup.repeated(frame(points, "key bigint, mark bigint, at int, anchor bigint"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Join" not in plan and "Aggregate" not in plan
            assert Counter(map(tuple, found.collect())) == Counter(p[:3] for p in points if sizes[p[3]] > 1)
    finally:
        spark.conf.set(setting, before)


def test_paragraphs_are_described_by_the_words_of_their_texts():
    rng = random.Random(11)
    lines = [" ".join(f"é{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))) for _ in range(5000)]
    lines += [lines[3], "  " + lines[3].replace(" ", "\t") + " "]
    text = "\n".join(lines).encode()
    number, word = sh.words([text])
    sizes = substring_dedup.paragraphs(text, word, substring_dedup.CUT)[:, 2]
    digests, keys = substring_dedup.describe(word, np.cumsum(sizes) - sizes, sizes, 3, 4)
    for i in (0, 3, 4095, 4096, 5001):
        own = sh.words([lines[i].encode()])[1]
        digest, key = substring_dedup.describe(own, np.array([0]), np.array([len(own)]), 3, 4)
        assert digests[i] == digest[0] and keys[i].tolist() == key[0].tolist()
    same = {}
    for line, digest in zip(lines, digests.tolist()):
        assert same.setdefault(tuple(line.split()), digest) == digest
    assert len(set(same.values())) == len(same)
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in substring_dedup.describe(np.zeros(0, np.uint64), none, none, 3, 4)] == [0, 0]


def test_signatures_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(12)
    hashes, most = 2000, 1 << sh.HASH_BITS
    for common, own in ((80, 10), (20, 40), (300, 37)):
        shared, left, right = (rng.integers(0, most, n).astype(np.uint64) for n in (common, own, own))
        sets = [np.sort(np.append(shared, x)) for x in (left, right)]
        number = np.repeat([0, 1], [len(x) for x in sets])
        a, b = sh.minhash(number, np.concatenate(sets), 2, hashes)
        assert abs((a == b).mean() - sh.set_jaccard(*sets)) < 0.05
    assert (sh.minhash(np.zeros(0, np.int64), np.zeros(0, np.uint64), 2, 3) == 0).all()


def test_anchors_are_the_leftmost_least_half_runs():
    rng = np.random.default_rng(13)
    for width in (1, 2, 7, 20):
        word = sh.mix(rng.integers(0, 3, 200).astype(np.uint64))
        number = np.sort(rng.integers(0, 4, 200))
        of, place, _, at, least = substring_dedup.word_runs(number, word, 4, width)
        half, starts = (width + 1) // 2, np.searchsorted(number, np.arange(4))
        values = {}
        for d, p, a, v in zip(of, place, at, least):
            assert p <= a <= p + width - half
            assert values.setdefault(tuple(word[starts[d] + a : starts[d] + a + half].tolist()), v) == v
        for d, p, a, v in zip(of, place, at, least):
            inside = [values.get(tuple(word[starts[d] + q : starts[d] + q + half].tolist())) for q in range(p, p + width - half + 1)]
            seen = [x for x in inside if x is not None]
            assert v == min(np.array(seen).view(np.uint64)).view(np.int64) and inside.index(v) == a - p
