"""Operators against brute force, and results that must not depend on layout."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortline.operators import episodes, exposure, funnel, joins, ranks
from tests.conftest import rows

START = datetime(2015, 1, 1)


def sample_events(seed, n=400, hot_share=0.4, minutes=60 * 24 * 5):
    """Events with one hot entity, many tied timestamps, null rates and missing units."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < hot_share else f"e{rng.randrange(6)}"
        at = START + timedelta(minutes=15 * rng.randrange(minutes // 15))
        rate = rng.choice([None, 0.0, 0.0, 1.0, 2.5, 7.0])
        unit = rng.choice([None, "mg/hr", "mg/hr"])
        out.append((i, key, rng.choice("ST"), at, rate, unit))
    return out


SCHEMA = "id long, k string, ev string, t timestamp_ntz, r double, u string"


def brute_episodes(data, start_event, stop=2):
    out = []
    for key in {d[1] for d in data}:
        mine = sorted((d for d in data if d[1] == key), key=lambda d: (d[3], d[0]))
        runs = []
        for _, _, ev, at, _, _ in mine:
            if runs and runs[-1][0] == ev:
                runs[-1][2] = at
            else:
                runs.append([ev, at, at])
        for i, (ev, first, _) in enumerate(runs):
            if ev == start_event:
                out.append((key, first, runs[i + 1][stop] if i + 1 < len(runs) else None))
    return sorted(out, key=str)


def brute_exposure(data):
    out = {}
    for key in {d[1] for d in data}:
        mine = sorted((d for d in data if d[1] == key), key=lambda d: (d[3], d[0]))
        last_t = mine[-1][3]
        kept = [d for d in mine if d[3] == last_t or d[5] is not None]
        hours = [(b[3] - a[3]).total_seconds() / 3600 for a, b in zip(kept, kept[1:])]
        ran = sum(h for d, h in zip(kept, hours) if d[4] is not None and d[4] > 0)
        points = {}
        for d in kept:
            if d[4] is not None:
                points.setdefault(d[3], []).append(d[4])
        curve = sorted((t, sum(v) / len(v)) for t, v in points.items())
        area = sum(
            0.5 * (r0 + r1) * (t1 - t0).total_seconds() / 3600 for (t0, r0), (t1, r1) in zip(curve, curve[1:])
        )
        if area > 0 and ran > 0:
            out[key] = (area, ran)
    return out


@pytest.mark.parametrize("seed,slot_hours,parts", [(1, 1, 3), (2, 6, 7), (3, 24, 1), (4, 0.25, 5), (5, 2000, 4)])
def test_episodes_equal_brute_force(frame, seed, slot_hours, parts):
    data = sample_events(seed)
    df = frame(data, SCHEMA).repartition(parts)
    out = episodes.run_episodes(df, "k", "ev", "t", "S", tie=["id"], slot_hours=slot_hours)
    got = sorted((tuple(r) for r in out.select("k", "start_datetime", "stop_datetime").collect()), key=str)
    assert got == brute_episodes(data, "S")
    out = episodes.run_episodes(df, "k", "ev", "t", "S", tie=["id"], slot_hours=slot_hours, stop_at="first")
    got = sorted((tuple(r) for r in out.select("k", "start_datetime", "stop_datetime").collect()), key=str)
    assert got == brute_episodes(data, "S", stop=1)


@pytest.mark.parametrize("seed,slot_hours,parts", [(11, 1, 3), (12, 6, 7), (13, 24, 1), (14, 0.25, 5), (15, 2000, 4)])
def test_exposure_equals_brute_force(frame, seed, slot_hours, parts):
    data = sample_events(seed)
    df = frame(data, SCHEMA).repartition(parts)
    out = exposure.rate_exposure(df, ["k"], "t", "r", "u", "id", slot_hours).collect()
    want = brute_exposure(data)
    assert {r["k"] for r in out} == set(want)
    for r in out:
        assert (r["dose_auc"], r["cont_duration"]) == pytest.approx(want[r["k"]])


def test_sparse_series_with_unitless_tails(frame):
    """Many tiny series, so that whole slots consist of samples without a unit."""
    rng = random.Random(9)
    data = []
    for i in range(600):
        at = START + timedelta(hours=rng.randrange(12))
        data.append((i, f"s{rng.randrange(150)}", "S", at, rng.choice([None, 0.0, 3.0]), rng.choice([None, None, "x"])))
    for slot in (1, 3):
        out = exposure.rate_exposure(frame(data, SCHEMA), ["k"], "t", "r", "u", "id", slot).collect()
        want = brute_exposure(data)
        assert {r["k"] for r in out} == set(want)
        for r in out:
            assert (r["dose_auc"], r["cont_duration"]) == pytest.approx(want[r["k"]])


def test_area_unchanged_by_interpolated_sample(frame):
    at = [START, START + timedelta(hours=4)]
    two = frame([("A", at[0], 2.0), ("A", at[1], 6.0)], "k string, t timestamp_ntz, r double")
    three = two.union(frame([("A", START + timedelta(hours=1), 3.0)], two.schema))
    areas = [exposure.rate_exposure(d, ["k"], "t", "r").collect()[0]["dose_auc"] for d in (two, three)]
    assert areas == pytest.approx([16.0, 16.0])


def test_runs_alternate(frame):
    df = frame(sample_events(21), SCHEMA)
    runs = episodes.collapse_runs(df, "k", "ev", "t", ["id"]).collect()
    by_key = {}
    for r in runs:
        by_key.setdefault(r["k"], []).append(r)
    for mine in by_key.values():
        mine.sort(key=lambda r: (r["first_ts"], r["last_ts"]))
        assert all(a["last_ts"] <= b["first_ts"] for a, b in zip(mine, mine[1:]))
        assert sum(r["next_last_ts"] is None for r in mine) == 1


def test_interval_join_equals_brute_force(frame):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.5 else "x", i, START + timedelta(minutes=rng.randrange(6000))) for i in range(300)]
    spans = []
    for key in ("hot", "x", "none"):
        for j in range(4):
            a = START + timedelta(minutes=rng.randrange(6000))
            spans.append((key, j, a, a + timedelta(minutes=rng.choice([0, 59, 60, 1440]))))
    spans.append(("hot", 9, START + timedelta(days=2), START))
    left = frame(data, "k string, i long, t timestamp_ntz")
    right = frame(spans, "k string, j long, a timestamp_ntz, b timestamp_ntz")
    for slot in (0.5, 24):
        out = joins.within_span(left, right, "k", "t", "a", "b", slot).select("i", "j")
        want = sorted((i, j) for k, i, t in data for k2, j, a, b in spans if k == k2 and a <= t <= b)
        assert sorted(tuple(r) for r in out.collect()) == want


def test_funnel_counts_add_up(frame):
    rng = random.Random(3)
    base = frame([(i,) for i in range(200)], "k long")
    crit = [
        funnel.Criterion(f"c{j}", frame([(rng.randrange(260),) for _ in range(80)], "k long"), include=j == 1)
        for j in range(4)
    ]
    result = funnel.cohort_funnel(base, crit, "k")
    steps = rows(result.attrition())
    final = result.cohort().count()
    assert sum(s[2] for s in steps) + final == 200 and steps[-1][3] == final


def test_ranks_and_quantiles_equal_brute_force(frame):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([0.0, -1.5, -700.0, 3.25, 1e-9, 1e12, rng.gauss(50, 1), rng.gauss(50, 1)])) for _ in range(500)]
    df = frame(data, "g string, v double").repartition(5)
    for r in ranks.tie_ranks(df, ["g"], "v").collect():
        same = [v for g, v in data if g == r["g"]]
        assert (r["ties"], r["below"], r["total"]) == (
            same.count(r["v"]), sum(v < r["v"] for v in same), len(same),
        )
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in ranks.exact_quantiles(df, ["g"], "v", probs).collect():
        same = sorted(v for g, v in data if g == r["g"])
        for name, p in probs.items():
            at = (len(same) - 1) * p
            lo = int(at)
            hi = min(lo + 1, len(same) - 1)
            assert r[name] == pytest.approx(same[lo] + (at - lo) * (same[hi] - same[lo]))


def test_batches(frame):
    for key_type, ids in (("long", list(range(5, 1005))), ("string", [f"id{i}" for i in range(1000)])):
        df = frame([(i,) for i in ids + ids[:50]], f"k {key_type}")
        out = ranks.id_batches(df, "k", 300, ";").collect()
        assert sorted(r["n_ids"] for r in out) == [100, 300, 300, 300]
        got = [x for r in sorted(out, key=lambda r: r["batch"]) for x in r["ids"].split(";")]
        assert sorted(got) == sorted(map(str, ids))
        if key_type == "long":
            assert got == [str(i) for i in ids]


def test_first_row_is_whole_row(frame):
    df = frame([("a", 2, "x", None), ("a", 1, "z", None), ("a", 1, "y", 5), ("b", 3, "q", 1)], "k string, t long, v string, w long")
    assert rows(joins.first_row(df, "k", ["t", "v"])) == [("a", 1, "y", 5), ("b", 3, "q", 1)]
    assert rows(joins.first_row(df, "k", [F.col("t").desc(), "v"])) == [("a", 2, "x", None), ("b", 3, "q", 1)]
