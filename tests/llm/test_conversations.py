"""Conversation repair against a brute-force search over all edits, and on edge cases."""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cohortline.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    """What the contract asks of one conversation's rows, by searching all edits from the front with memory."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def after(state, ch):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, ch))

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, lines) of the rest."""
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for name in ("user", "assistant"):
                if after(state, name[0]):
                    cost, audit, lines = best(i, after(state, name[0]), inserted + 1)
                    ways.append((cost + 5, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                for letter, name, price in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if name and after(state, name[0]):
                        cost, audit, lines = best(i + 1, after(state, name[0]), 0)
                        ways.append((cost + price + extra, letter + audit, (f"{name}:{text}", *lines)))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest()), lines


def by_conversation(rows, repaired):
    return {c: expected([r for r in repaired if r[0] == c]) for c in {r[0] for r in rows}}


def some_rows(seed, conversations=150):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(pick.randrange(9)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = pick.choice(["Yes.", "No!", "Why?", "cut of", " ", "", None, f"Own {pick.random()}.", "So. \n\x0b", "é"])
            rows.append((conv if conv else None, pick.choice([turn, turn, turn, None, turn * 3, turn // 2]), role, text))
    return rows + [(2**53 + 1, 2**53 + 1, "user", "A."), (2**53 + 1, 2**53 + 2, "assistant", "B."), (2**63 - 1, None, "user", "x")]


def test_repair_equals_search_over_all_edits(frame):
    rows = some_rows(5)
    damaged_rows = cv.damage(frame(rows, SCHEMA).repartition(5))
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.repair(damaged_rows, absent=F.col("absent")).collect()}
    want = by_conversation(rows, damaged(rows))
    assert got == {c: w[0] for c, w in want.items()}


def test_repaired_rows_are_what_the_audit_says(frame):
    rows = some_rows(6, 60)
    df = frame(rows, SCHEMA)
    reports = cv.repair(df)
    plain = [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]
    want = {c: w[1] for c, w in by_conversation(rows, plain).items()}
    found = {}
    for r in sorted(cv.repaired_rows(df, reports).collect(), key=lambda r: r["place"]):
        found.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert found == {c: list(lines) for c, lines in want.items() if lines}


def test_trail_spills_and_batches_carry_state(spark, monkeypatch):
    monkeypatch.setattr(cv, "SPILL_ROWS", 7)
    pick = random.Random(3)
    rows = [(1, t, pick.choice(["user", "assistant", "system"]), pick.choice(["Yes.", f"{t}.", f"{t}", " "])) for t in range(60)]
    talk = cv.Conversation(True)
    marked = sorted(rows, key=lambda r: r[1])
    seen = set()
    for _, turn, role, text in marked:
        body = text.strip(SPACE)
        fault = cv.BLANK if not body else cv.DUPLICATE if (role, text) in seen else cv.CUT if body[-1] not in ".!?" else cv.CLEAN
        seen.add((role, text))
        talk.add(fault, role[0], role, text, turn)
    assert talk.trail.spilled > 5
    assert tuple(talk.report().values()) == expected(rows)[0]


def test_state_crosses_arrow_batches(spark, frame):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(57)] + [(2, 0, "user", "A.")]
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "5")
    try:
        got = {r["conv_id"]: tuple(r)[1:] for r in cv.repair(frame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {c: expected([r for r in rows if r[0] == c])[0] for c in (1, 2)}


@pytest.mark.parametrize("name", ["conv", "none", "absent", "fault", "same", "first", "dated", "initial", "audit", "own", "kind", "body"])
def test_columns_that_clash(frame, name):
    df = frame([(1, 0, "user", "A."), (1, 1, "assistant", "B.")], SCHEMA).withColumn(name, F.lit("x"))
    report = cv.repair(df).collect()[0]
    assert (report["cost"], report["audit"]) == (0, "KK")


def test_empty_table_and_long_text(frame):
    empty = frame([], SCHEMA)
    assert cv.repair(empty).collect() == [] and cv.repaired_rows(empty, cv.repair(empty)).collect() == []
    report = cv.repair(frame([(1, 0, "user", "x" * 1_000_000 + "."), (1, 1, "assistant", "y")], SCHEMA)).collect()[0]
    # Keeping the cut turn costs 5, an empty turn in its place 2 + 5, no turn at all 2 + 2.
    assert (report["cost"], report["audit"], report["truncated"]) == (4, "DD", 1)
