"""Mapping and unit tables, interval cells, long funnels, join losses."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortline.operators import funnel, joins, mapping

RULES = "position int, kind string, pattern string, name string"


def test_first_rule_wins_across_kinds(frame):
    rules = [
        (3, "regex", "temp", "temperature"), (1, "exact", "Temp skin", "skin"), (2, "regex", "^MAP", "pressure"), (9, "exact", "MAP cuff", "late"),
        (0, "exact", "twice", "b"), (0, "exact", "twice", "a"), (4, "regex", "x|y", "letters"),
    ]
    values = ["temp oral", "Temp skin", "MAP cuff", "twice", "none", None, "y", "temp x"]
    df = frame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = mapping.canonical_by_table(df, "v", frame(rules, RULES), "name")
    want = ["temperature", "skin", "pressure", "a", "none", None, "letters", "temperature"]
    assert [r["name"] for r in out.orderBy("i").collect()] == want
    assert out.columns == ["i", "v", "name"]


def test_mapping_without_rules_of_a_kind(frame):
    df = frame([("a",), ("b",)], "v string")
    exact = mapping.canonical_by_table(df, "v", frame([(1, "exact", "a", "A")], RULES), "w").collect()
    regex = mapping.canonical_by_table(df, "v", frame([(1, "regex", "a", "A")], RULES), "w").collect()
    none = mapping.canonical_by_table(df, "v", frame([], RULES), "w").collect()
    assert {tuple(r) for r in exact} == {tuple(r) for r in regex} == {("a", "A"), ("b", "b")} and {tuple(r) for r in none} == {("a", "a"), ("b", "b")}
    with pytest.raises(ValueError):
        mapping.canonical_by_table(df, "v", frame([(i, "regex", f"a{i}", "A") for i in range(mapping.MAX_PATTERNS + 1)], RULES), "w")


def test_units_from_a_table(frame):
    units = frame([("Ketamine", "mg/hr", 1.0, -1), ("fentanyl", "mg/hr", 1000.0, 0), ("propofol", "mcg", 0.06, 1)], "drug string, unit string, factor double, weight_power int")
    rows = [("KETAMINE", "mg/hr", 10.0, 50.0), ("ketamine", "mg/hr", 10.0, 0.0), ("Fentanyl", "mg/hr", 2.0, None), ("propofol", "mcg", 100.0, 70.0), ("propofol", None, 5.0, 70.0), ("other", "mcg", 7.0, 1.0)]
    df = frame(rows, "med string, u string, r double, w double")
    out = mapping.convert_by_table(df, "med", "u", "r", "w", units, "standard").collect()
    got = {(r["med"], r["u"], r["w"]): r["standard"] for r in out}
    want = [0.2, None, 2000.0, pytest.approx(420.0), 5.0, 7.0]
    assert got == {(med, u, w): value for (med, u, _, w), value in zip(rows, want)}
    twice = units.unionByName(frame([("FENTANYL", "mg/hr", 1.0, 0)], units.schema))
    with pytest.raises(Exception, match="listed twice"):
        mapping.convert_by_table(df, "med", "u", "r", "w", twice, "standard").collect()


def test_a_span_is_two_rows_at_most_however_long(frame):
    begin = datetime(2015, 1, 1, 5)
    rows = [(i, begin, begin + d) for i, d in enumerate([timedelta(0), timedelta(minutes=3), timedelta(hours=1), timedelta(days=9), timedelta(days=365 * 70)])]
    rows += [(9, begin, datetime(9999, 12, 31)), (10, datetime(1, 1, 1), datetime(9999, 12, 31)), (11, begin, None), (12, begin, begin - timedelta(days=1))]
    cells = joins.span_cells(frame(rows, "i int, a timestamp_ntz, b timestamp_ntz"), "a", "b", 1.0)
    counts = {r["i"]: r["count"] for r in cells.groupBy("i").count().collect()}
    assert set(counts) == {0, 1, 2, 3, 4, 9, 10} and max(counts.values()) <= 2


@pytest.mark.parametrize("slot", [0.01, 1.0, 500.0])
def test_spans_of_every_length_equal_brute_force(frame, slot):
    rng = random.Random(4)
    begin = datetime(1969, 12, 1)
    events = [(rng.choice("ab"), i, begin + timedelta(minutes=rng.randrange(200_000))) for i in range(300)]
    spans = []
    for j in range(60):
        a = begin + timedelta(minutes=rng.randrange(200_000))
        spans.append((rng.choice("abc"), j, a, a + timedelta(seconds=rng.choice([0, 30, 5000, 10**5, 10**6, 10**7, 10**9]))))
    left, right = frame(events, "k string, i int, t timestamp_ntz"), frame(spans, "k string, j int, a timestamp_ntz, b timestamp_ntz")
    got = sorted(tuple(r) for r in joins.within_span(left, right, "k", "t", "a", "b", slot).select("i", "j").collect())
    assert got == sorted((i, j) for k, i, t in events for kk, j, a, b in spans if k == kk and a <= t <= b)
    assert joins.within_span(left, right.limit(0), "k", "t", "a", "b").count() == 0


def test_two_hundred_criteria(frame):
    base = frame([(k,) for k in range(400)], "k int").coalesce(1)
    listed = [frame([(k,), (k + 200,)], "k int").coalesce(1) for k in range(200)]
    criteria = [funnel.Criterion(f"c{i}", rows, include=False) for i, rows in enumerate(listed)]
    judged = funnel.cohort_funnel(base, criteria, "k")
    status = {r["k"]: r["failed_step"] for r in judged.status.collect()}
    assert status == {k: k % 200 + 1 for k in range(400)}
    steps = judged.attrition().collect()
    assert [(r["removed"], r["remaining"]) for r in steps] == [(2, 400 - 2 * i) for i in range(1, 201)]


def test_join_losses(frame):
    members = frame([(k,) for k in "abcd"], "k string")
    parts = [("weight", frame([("a",), ("a",), ("b",), ("c",)], "k string")), ("height", frame([("a",), ("d",), ("c",)], "k string")), ("none", frame([("a",)], "k string"))]
    losses = funnel.join_losses(members, parts, "k")
    assert [(r["reason"], r["removed"], r["remaining"]) for r in losses.attrition().collect()] == [("weight", 1, 3), ("height", 1, 2), ("none", 1, 1)]
    assert [r["k"] for r in losses.cohort().collect()] == ["a"]
    text = losses.status._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and len(re.findall("Exchange hashpartitioning", text)) == 1
