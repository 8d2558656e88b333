"""Statistics against published or hand-computed values."""

from __future__ import annotations

import math
import random
import re
from itertools import combinations
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from cohortline.functions import pvalues
from cohortline.operators import compare


def long_frame(frame, a, b):
    data = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    return compare.unpivot_numeric(frame(data, "g string, x double"), "g", ["x"])


def test_tail_probabilities():
    assert pvalues.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert pvalues.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert pvalues.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.chi2_sf(15.50731306, 8) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.chi2_sf(2.0, 2) == pytest.approx(0.36787944117, abs=1e-10)
    assert pvalues.f_two_sided(1.0, 7, 7) == pytest.approx(1.0)
    # F(1, n) is the square of t(n), so both tails agree.
    assert 1 - pvalues.beta_cdf(1 * 4.0 / (4.0 + 9), 0.5, 4.5) == pytest.approx(pvalues.t_two_sided(2.0, 9))


def test_tails_at_many_degrees_of_freedom():
    limit = 2 * pvalues.normal_sf(2.0)
    for df in (1e9, 1e11, 1e13):
        # The first correction of the normal tail is of the order 1 / df.
        assert pvalues.t_two_sided(2.0, df) == pytest.approx(limit, rel=max(1e-8, 20 / df))
        assert pvalues.f_two_sided(4.0, 1, df) == pytest.approx(2 * limit, rel=max(1e-8, 20 / df))
        assert pvalues.f_two_sided(2.5, 4, df) == pytest.approx(2 * pvalues.chi2_sf(10.0, 4), rel=max(1e-8, 50 / df))
    # Both ways meet where the method changes.
    below, above = (pvalues.t_two_sided(3.0, df) for df in (pvalues._LARGE_DF, pvalues._LARGE_DF * (1 + 1e-9)))
    assert below == pytest.approx(above, rel=1e-10)
    # With equal degrees of freedom ln F is nearly normal about 0, so f and 1 / f have the same p.
    assert pvalues.f_two_sided(1.001, 1e7, 1e7) == pytest.approx(pvalues.f_two_sided(1 / 1.001, 1e7, 1e7), rel=1e-8)
    assert pvalues.f_two_sided(1.0, 1e6, 1e6) == pytest.approx(1.0)


def test_two_groups(frame):
    long = long_frame(frame, [1, 2, 3, 4], [2, 4, 6, 8])
    m = compare.f_statistics(compare.t_statistics(compare.two_group_moments(long, ("a", "b")))).collect()[0]
    assert m["t_pooled"] == pytest.approx(-1.7320508) and m["df_pooled"] == 6
    assert m["t_welch"] == pytest.approx(-1.7320508) and m["df_welch"] == pytest.approx(4.4117647)
    assert (m["f"], m["df1"], m["df2"]) == (0.25, 3.0, 3.0)
    u = compare.mann_whitney(long, ("a", "b")).collect()[0]
    assert (u["rank_sum_a"], u["u_a"], u["tie_term"]) == (13.0, 3.0, 12.0)


def test_chi_squared(frame):
    cells = {("a", "x"): 10, ("b", "x"): 20, ("a", "y"): 30, ("b", "y"): 40}
    data = [k for k, n in cells.items() for _ in range(n)]
    long = compare.unpivot_categorical(frame(data, "g string, lev string"), "g", ["lev"])
    got = compare.chi_squared(long).collect()[0]
    assert got["chi2"] == pytest.approx(0.7936508) and got["statistic"] == pytest.approx(0.4464286)
    plain = compare.chi_squared(long, yates=False).collect()[0]
    assert plain["statistic"] == pytest.approx(0.7936508) and plain["df"] == 1


def test_chi_squared_with_empty_cells(frame):
    data = [("a", "x")] * 5 + [("b", "y")] * 7 + [("a", "z")] * 3 + [("b", "z")] * 5
    long = compare.unpivot_categorical(frame(data, "g string, lev string"), "g", ["lev"])
    n, want = 20, 0.0
    for g in "ab":
        for lev in "xyz":
            e = sum(d[0] == g for d in data) * sum(d[1] == lev for d in data) / n
            want += (data.count((g, lev)) - e) ** 2 / e
    got = compare.chi_squared(long).collect()[0]
    assert got["statistic"] == pytest.approx(want) and got["df"] == 2


def test_normal_quantile(spark):
    ps = [0.000125, 0.001, 0.07, 0.075, 0.3, 0.5, 0.8, 0.95, 0.9999]
    out = spark.createDataFrame([(p,) for p in ps], "p double").select("p", compare.normal_quantile(F.col("p")).alias("q"))
    for r in out.collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-12)


def test_shapiro_wilk_published_example(frame):
    """Weights of eleven men, the published example of the test: W = 0.79, p = 0.0067."""
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = compare.unpivot_numeric(frame([("m", float(w)) for w in weights], "g string, x double"), "g", ["x"])
    got = compare.normality(df, ["variable", "group"]).collect()[0]
    assert got["method"] == "shapiro-wilk"
    assert got["statistic"] == pytest.approx(0.7888, abs=1e-3)
    assert got["p"] == pytest.approx(0.0067, abs=1e-4)


def brute_shapiro(x):
    """W by the textbook formula with the approximated weights, for n > 5."""
    x, n = sorted(x), len(x)
    m = [NormalDist().inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm, u = sum(v * v for v in m), n**-0.5
    last = -2.706056 * u**5 + 4.434685 * u**4 - 2.071190 * u**3 - 0.147981 * u**2 + 0.221157 * u + m[-1] * mm**-0.5
    nxt = -3.582633 * u**5 + 5.682633 * u**4 - 1.752461 * u**3 - 0.293762 * u**2 + 0.042981 * u + m[-2] * mm**-0.5
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2)
    a = [-last, -nxt] + [v / phi**0.5 for v in m[2:-2]] + [nxt, last]
    mean = sum(x) / n
    return sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_shapiro_wilk_with_ties_and_sizes(frame):
    rng = random.Random(1)
    data = []
    for n in (3, 4, 6, 20, 200):
        data += [(f"n{n}", float(round(rng.gauss(10, 3)))) for _ in range(n)]
    df = compare.unpivot_numeric(frame(data, "g string, x double"), "g", ["x"])
    for r in compare.normality(df, ["variable", "group"]).collect():
        x = [v for g, v in data if g == r["group"]]
        assert 0 < r["statistic"] <= 1 and 0 <= r["p"] <= 1
        if len(x) > 5:
            assert r["statistic"] == pytest.approx(brute_shapiro(x), abs=1e-9)


def test_the_caller_names_the_normality_test(spark):
    df = spark.range(6000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"))
    long = compare.unpivot_numeric(df, "g", ["x"])
    got = compare.normality(long, ["variable", "group"], "jarque-bera").collect()[0]
    # A uniform grid has no skew and excess kurtosis -1.2.
    assert got["method"] == "jarque-bera" and got["statistic"] == pytest.approx(6000 / 6 * 1.2**2 / 4, rel=1e-3)
    got = compare.normality(long, ["variable", "group"]).collect()[0]
    assert got["method"] == "shapiro-wilk" and got["n"] == 6000
    assert got["statistic"] == pytest.approx(brute_shapiro(range(6000)), abs=1e-9)
    with pytest.raises(ValueError):
        compare.normality(long, ["variable", "group"], "by size")


def test_ties_over_several_blocks(frame, spark):
    x = [1.0] * 9000 + [2.0] * 5000 + [3.0, 4.0, 7.0]
    df = spark.range(len(x)).select(F.lit("g").alias("g"), F.expr("CASE WHEN id < 9000 THEN 1D WHEN id < 14000 THEN 2D WHEN id = 14000 THEN 3D WHEN id = 14001 THEN 4D ELSE 7D END").alias("x"))
    got = compare.normality(compare.unpivot_numeric(df, "g", ["x"]), ["variable", "group"]).collect()[0]
    assert got["n"] == len(x) and got["statistic"] == pytest.approx(brute_shapiro(x), abs=1e-9)


def test_groups_without_a_test(frame):
    rows = [("a", 1.0, 5.0, None), ("b", 2.0, 5.0, 1.0), ("b", 3.0, 5.0, 2.0), ("b", 4.0, 5.0, 4.0), ("b", 5.5, 5.0, 8.0)]
    df = frame(rows, "g string, single double, same double, missing double")
    got = {r["variable"]: r for r in compare.group_compare(df, "g", ("a", "b"), ["single", "same", "missing"]).collect()}
    assert got["single"]["test"] == "mann-whitney" and 0 < got["single"]["p"] <= 1
    for name in ("same", "missing"):
        assert got[name]["test"] == "not testable" and got[name]["statistic"] is None and got[name]["p"] is None


def test_test_selection(frame):
    rng = random.Random(2)
    rowset = []
    for _ in range(60):
        rowset.append(("a", rng.gauss(0, 1), rng.gauss(0, 1), rng.expovariate(1), "x"))
        rowset.append(("b", rng.gauss(0, 1), rng.gauss(0, 9), rng.expovariate(1), rng.choice("xy")))
    rowset.append(("other", 1.0, 1.0, 1.0, "z"))
    df = frame(rowset, "g string, same double, wide double, skewed double, cat string")
    out = compare.group_compare(df, "g", ("a", "b"), ["same", "wide", "skewed"], ["cat"])
    got = {r["variable"]: r for r in out.collect()}
    assert got["same"]["test"] == "t pooled" and got["same"]["df"] == 118
    assert got["wide"]["test"] == "t welch" and got["wide"]["df"] < 118
    assert got["skewed"]["test"] == "mann-whitney"
    assert got["cat"]["test"] == "chi-squared" and got["cat"]["p"] < 0.05
    assert all(0 <= r["p"] <= 1 for r in got.values())


def test_table_one(frame):
    df = frame([("a", 1.0, "x"), ("a", 3.0, "y"), ("b", 5.0, "x"), ("b", None, None)], "g string, v double, c string")
    out = {(r["variable"], r["level"], r["stratum"]): r for r in compare.table_one(df, "g", ["v"], ["c"]).collect()}
    assert (out["v", None, "a"]["n"], out["v", None, "a"]["mean"]) == (2, 2.0)
    assert out["v", None, "b"]["n"] == 1
    assert out["c", "x", "a"]["pct"] == 50.0 and out["c", "x", "b"]["pct"] == 100.0


def test_group_summary(frame):
    df = frame([("a", float(v)) for v in (1, 2, 3, 4, 10)], "g string, v double")
    r = compare.group_summary(compare.unpivot_numeric(df, "g", ["v"])).collect()[0]
    assert [r[c] for c in ("n", "mean", "min", "q1", "median", "q3", "max")] == [5, 4.0, 1.0, 2.0, 3.0, 4.0, 10.0]


def test_tie_runs_have_closed_sums(frame):
    """Runs of every length, at the ends and in the middle, against the sums place by place."""
    rng = random.Random(5)
    data = []
    for name, runs in {"mixed": (1, 64, 65, 700, 1, 3000, 66), "ends": (900, 1, 2, 1200), "two": (70, 80)}.items():
        data += [(name, float(v)) for v, ties in enumerate(runs) for _ in range(ties)]
    rng.shuffle(data)
    df = compare.unpivot_numeric(frame(data, "g string, x double"), "g", ["x"])
    for r in compare.normality(df, ["variable", "group"]).collect():
        assert r["statistic"] == pytest.approx(brute_shapiro([v for g, v in data if g == r["group"]]), abs=1e-9)


def test_shapiro_plan_has_a_row_per_distinct_value(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") % 5).cast("double").alias("x"))
    out = compare.shapiro_wilk(compare.unpivot_numeric(df, "g", ["x"]), ["variable", "group"])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text.split("Scan parquet")[0] and out.collect()[0]["n"] == 200_000


def test_exact_rank_sums_equal_all_rankings(frame):
    for n_a, n_b in [(1, 1), (3, 4), (5, 5), (2, 7)]:
        ranks = range(1, n_a + n_b + 1)
        us = [sum(c) - n_a * (n_a + 1) // 2 for c in combinations(ranks, n_a)]
        for u in set(us):
            tail = min(sum(v <= u for v in us), sum(v >= u for v in us)) / len(us)
            assert pvalues.rank_sum_two_sided(u, n_a, n_b) == pytest.approx(min(1.0, 2 * tail), rel=1e-14)
    # Published critical value: at 10 and 10, U = 23 is the largest with p <= 0.05.
    assert pvalues.rank_sum_two_sided(23, 10, 10) <= 0.05 < pvalues.rank_sum_two_sided(24, 10, 10)


def test_exact_rank_sums_of_thousands_of_values(spark):
    for small, large in [(40, 60), (32, 900), (127, 127)]:
        ways, whole = pvalues._rank_sum_counts(small, large, small * large // 2), math.comb(small + large, small)
        for share in (1.0, 0.9, 0.6):
            u = int(small * large / 2 * share)
            assert pvalues._rank_sum_tail(u, small, large) == pytest.approx(sum(ways[: u + 1]) / whole, rel=1e-11)
    # The counts of the whole product would take 1e12 steps here.
    sizes = (14_400, 21_600)
    spread = math.sqrt(sizes[0] * sizes[1] * (sum(sizes) + 1) / 12)
    for z in (0.3, 2.0, 4.0):
        u = int(sizes[0] * sizes[1] / 2 - z * spread)
        df = spark.createDataFrame([(float(u), *map(float, sizes)), (float(sizes[0] * sizes[1] - u), *map(float, sizes[::-1]))], "u double, a double, b double")
        low, high = [r["p"] for r in df.select(pvalues.p_rank_sum("u", "a", "b").alias("p")).collect()]
        assert low == high == pytest.approx(2 * pvalues.normal_sf(z), rel=1e-3)


def test_exact_rank_sum_is_chosen_by_the_caller_and_refuses_ties(frame):
    rows = [("a", float(v)) for v in (1, 4, 6, 9)] + [("b", float(v)) for v in (2, 3, 5, 7, 8)]
    long = compare.unpivot_numeric(frame(rows, "g string, x double"), "g", ["x"])
    sums = compare.mann_whitney(long, ("a", "b"))
    assert compare.rank_sum_p(sums, "exact").collect()[0]["p"] == pytest.approx(1.0)
    tied = compare.unpivot_numeric(frame([*rows, ("b", 9.0)], "g string, x double"), "g", ["x"])
    with pytest.raises(Exception, match="without ties"):
        compare.rank_sum_p(compare.mann_whitney(tied, ("a", "b")), "exact").collect()
    with pytest.raises(ValueError):
        compare.rank_sum_p(sums, "by size")
    out = compare.group_compare(frame(rows, "g string, x double"), "g", ("a", "b"), ["x"], rank_sum="exact").collect()[0]
    assert out["test"] in ("mann-whitney", "t pooled")


def test_t_quantile_published_values():
    for p, df, t in [(0.05, 1, 12.7062047), (0.05, 10, 2.22813885), (0.01, 30, 2.74999565), (0.5, 5, 0.72668684)]:
        assert pvalues.t_quantile(p, df) == pytest.approx(t, rel=1e-7)
    for df in (0.7, 3.3, 118.0, 2e4, 3e6):
        for p in (1e-12, 1e-3, 0.3, 0.999):
            assert pvalues.t_two_sided(pvalues.t_quantile(p, df), df) == pytest.approx(p, rel=1e-7)
    assert math.isnan(pvalues.t_quantile(0.05, 0)) and math.isnan(pvalues.t_quantile(1.0, 5))


def test_mean_differences(frame):
    a, b = [12.9, 11.1, 13.2, 12.0, 14.5], [10.2, 11.9, 9.4, 10.8]
    rows = [("a", v, 1.0, None) for v in a] + [("b", v, 2.0, 3.0) for v in b]
    long = compare.unpivot_numeric(frame(rows, "g string, x double, same double, one double"), "g", ["x", "same", "one"])
    got = {(r["variable"], r["method"]): r for r in compare.mean_differences(long, ("a", "b")).collect()}
    pooled = got["x", "t pooled"]
    mean_a, mean_b = sum(a) / 5, sum(b) / 4
    ss = sum((v - mean_a) ** 2 for v in a) + sum((v - mean_b) ** 2 for v in b)
    half = 2.36462425 * math.sqrt(ss / 7 * (1 / 5 + 1 / 4))
    assert pooled["df"] == 7 and pooled["estimate"] == pytest.approx(mean_a - mean_b)
    assert (pooled["low"], pooled["high"]) == (pytest.approx(mean_a - mean_b - half), pytest.approx(mean_a - mean_b + half))
    welch = got["x", "t welch"]
    assert welch["low"] < welch["estimate"] < welch["high"] and welch["df"] < 7
    assert got["same", "t pooled"]["estimate"] == -1.0 and got["same", "t pooled"]["p"] is None
    assert got["one", "t welch"]["low"] is None


def test_sketched_quantiles(spark):
    df = spark.range(0, 40_000, 1, 6).select(F.lit("g").alias("g"), F.sqrt(F.col("id") * 7919 % 40_009).alias("x"))
    long = compare.unpivot_numeric(df, "g", ["x"])
    out = compare.group_summary(long, quantiles="sketch", accuracy=100)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    row, values = out.collect()[0], sorted(r["x"] for r in df.collect())
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs(values.index(row[name]) + 1 - p * len(values)) <= len(values) / 100 + 1
    with pytest.raises(ValueError):
        compare.group_summary(long, quantiles="approximate")
