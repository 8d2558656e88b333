"""Comparing groups: moments, t and F tests, rank sums, normality, chi-squared, Table 1.

Variables are unpivoted to rows ``(by..., group, variable, value)``, so every statistic of
every variable (and every slice in ``by``) comes from the same few aggregations. Two-group
operators take ``groups=(a, b)`` and ignore other groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.clean import not_nan, ratio
from cohortline.functions.pvalues import p_chi2, p_f, p_normal, p_rank_sum, p_t, t_limit
from cohortline.operators.ranks import exact_quantiles, group_ranks, tie_ranks

NORMALITY_TESTS = ("shapiro-wilk", "jarque-bera")
ALPHA = 0.05
QUANTILES = ("exact", "sketch")
SKETCH_ACCURACY = 10_000
RANK_SUM_METHODS = ("normal", "exact")
EACH_TIE = 64


def unpivot_numeric(df: DataFrame, group: str, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by..., group, variable, value)`` of the numeric variables, unknown values dropped."""
    wide = df.select(*by, F.col(group).alias("group"), *[F.col(v).cast("double").alias(v) for v in variables])
    long = wide.unpivot([*by, "group"], list(variables), "variable", "value")
    return long.withColumn("value", not_nan("value")).filter("value IS NOT NULL AND group IS NOT NULL")


def unpivot_categorical(df: DataFrame, group: str, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by..., group, variable, level)`` of the categorical variables, unknown levels dropped."""
    wide = df.select(*by, F.col(group).alias("group"), *[F.col(v).cast("string").alias(v) for v in variables])
    long = wide.unpivot([*by, "group"], list(variables), "variable", "level")
    return long.filter("level IS NOT NULL AND group IS NOT NULL")


def group_summary(long: DataFrame, by: Sequence[str] = (), quantiles: str = "exact", accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """n, mean, sd, min, q1, median, q3, max per variable and group.

    ``quantiles="exact"`` ranks all values and interpolates. With ``"sketch"`` the quantiles come from a mergeable
    sketch in the same aggregation as the rest, one shuffle of a bounded row per group and task: each is a value of the group whose
    rank is off by at most 1 / ``accuracy`` of the group's size. The caller chooses; size does not.
    """
    keys = [*by, "variable", "group"]
    if quantiles not in QUANTILES:
        raise ValueError(f"quantiles must be one of {QUANTILES}")
    plain = [
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if quantiles == "sketch":
        sketch = F.percentile_approx("value", list(probs.values()), accuracy).alias("__q")
        out = long.groupBy(*keys).agg(*plain, sketch)
        out = out.withColumns({name: F.get("__q", F.lit(i)) for i, name in enumerate(probs)})
    else:
        out = long.groupBy(*keys).agg(*plain).join(exact_quantiles(long, keys, "value", probs), keys)
    return out.select(*keys, "n", "mean", "sd", "min", "q1", "median", "q3", "max")


# ---------------------------------------------------------------- t and F tests


def two_group_moments(long: DataFrame, groups: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and sample variance of both groups, one row per variable."""
    aggs = []
    for side, g in zip("ab", groups):
        v = F.when(F.col("group") == g, F.col("value"))
        aggs += [F.count(v).alias(f"n_{side}"), F.avg(v).alias(f"mean_{side}"), F.var_samp(v).alias(f"var_{side}")]
    return long.filter(F.col("group").isin(*groups)).groupBy(*by, "variable").agg(*aggs)


def t_statistics(moments: DataFrame) -> DataFrame:
    """Adds pooled and Welch t with their degrees of freedom."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    sa, sb = ratio(F.col("var_a"), na), ratio(F.col("var_b"), nb)
    diff = F.col("mean_a") - F.col("mean_b")
    pooled = ratio((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b"), na + nb - 2)
    return moments.withColumns(
        {
            "t_pooled": ratio(diff, F.sqrt(pooled * (1 / na + 1 / nb))),
            "df_pooled": na + nb - 2,
            "t_welch": ratio(diff, F.sqrt(sa + sb)),
            "df_welch": ratio(F.pow(sa + sb, F.lit(2.0)), ratio(sa * sa, na - 1) + ratio(sb * sb, nb - 1)),
        }
    )


def mean_differences(long: DataFrame, groups: tuple[str, str], by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Estimate and confidence interval of both t tests: rows ``by, variable, method, mean_a, mean_b, estimate, t, df, p, low, high``.

    ``estimate`` is the first group's mean less the second's; ``method`` is ``t pooled`` or ``t welch``. A group of fewer than
    two values, or two groups without any spread, has an estimate but no test and no interval.
    """
    if not 0.0 < level < 1.0:
        raise ValueError("level must lie between 0 and 1")
    stats = t_statistics(two_group_moments(long, groups, by))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    errors = {
        "pooled": F.sqrt(ratio((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b"), na + nb - 2) * (ratio(F.lit(1.0), na) + ratio(F.lit(1.0), nb))),
        "welch": F.sqrt(ratio("var_a", na) + ratio("var_b", nb)),
    }
    tests = [
        F.struct(F.lit(f"t {m}").alias("method"), F.col(f"t_{m}").alias("t"), F.when(F.col(f"t_{m}").isNotNull(), F.col(f"df_{m}")).alias("df"), e.alias("error"))
        for m, e in errors.items()
    ]
    rows = stats.withColumn("estimate", F.col("mean_a") - F.col("mean_b")).withColumn("__test", F.explode(F.array(*tests)))
    half = t_limit(F.lit(1.0 - level), F.col("__test.df")) * F.col("__test.error")
    rows = rows.withColumns({"__half": half, "__p": p_t(F.col("__test.t"), F.col("__test.df"))})
    return rows.select(
        *by, "variable", "__test.method", "mean_a", "mean_b", "estimate", "__test.t", "__test.df", F.col("__p").alias("p"),
        (F.col("estimate") - F.col("__half")).alias("low"), (F.col("estimate") + F.col("__half")).alias("high"),
    )


def f_statistics(moments: DataFrame) -> DataFrame:
    """Adds the variance ratio with its degrees of freedom."""
    return moments.withColumns(
        {
            "f": ratio("var_a", "var_b"),
            "df1": (F.col("n_a") - 1).cast("double"),
            "df2": (F.col("n_b") - 1).cast("double"),
        }
    )


# ---------------------------------------------------------------- rank sums


def mann_whitney(long: DataFrame, groups: tuple[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Rank sum and U of the first group with mid-ranks, tie term, and normal z.

    z uses the tie-corrected variance and the continuity correction at every sample size.
    """
    keys = [*by, "variable"]
    a, b = groups
    ranked = tie_ranks(
        long.filter(F.col("group").isin(a, b)),
        keys,
        "value",
        {"in_a": F.col("group") == a, "in_b": F.col("group") == b},
    )
    return _rank_sums(ranked, keys)


def _rank_sums(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From rows (ties, below, in_a, in_b) per distinct value: counts, rank sum, U, tie term and z per key."""
    ties = F.col("ties").cast("double")
    mid_rank = F.col("below") + (ties + 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum("in_a").alias("n_a"),
        F.sum("in_b").alias("n_b"),
        F.sum(F.col("in_a") * mid_rank).alias("rank_sum_a"),
        F.sum(ties * ties * ties - ties).alias("tie_term"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    sigma = F.sqrt(na * nb / 12 * (n + 1 - ratio("tie_term", n * (n - 1))))
    shift = F.col("u_a") - na * nb / 2
    return sums.withColumn("u_a", F.col("rank_sum_a") - na * (na + 1) / 2).withColumn(
        "z", ratio(shift - F.signum(shift) * 0.5, sigma)
    )


def rank_sum_p(sums: DataFrame, method: str = "normal") -> DataFrame:
    """Adds the two-sided ``p`` to the sums of :func:`mann_whitney`, null where it is not defined.

    ``normal`` is the approximation by z. ``exact`` counts all rankings and holds without ties only; a variable with ties ends the
    query with an error. Its cost grows as the smaller size, not as the product of both. The caller chooses; size does not.
    """
    if method not in RANK_SUM_METHODS:
        raise ValueError(f"method must be one of {RANK_SUM_METHODS}")
    if method == "normal":
        two_sided = F.least(2 * p_normal(F.abs("z")), F.lit(1.0))
        return sums.withColumn("p", F.when(F.col("z").isNotNull(), two_sided))
    refused = F.raise_error(F.concat(F.lit("the exact rank-sum distribution needs values without ties: "), F.col("variable")))
    untied = F.when(F.col("tie_term") > 0, refused.cast("double")).otherwise(F.col("u_a"))
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    checked = sums.withColumn("__u", untied)
    return checked.withColumn("p", F.when(both, p_rank_sum("__u", "n_a", "n_b"))).drop("__u")


# ---------------------------------------------------------------- normality

# Rational approximation of the normal quantile function (algorithm AS 241).
CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
TAIL_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
TAIL_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)

# Polynomial coefficients, constant term first, of the normality test (AS R94).
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: Column) -> Column:
    """Normal quantile as a column expression, for 1e-10 < p < 1 - 1e-10."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _poly(CENTRE_NUM, r) / _poly(CENTRE_DEN, r)
    t = F.sqrt(-F.ln(F.least(p, 1 - p))) - 1.6
    tail = F.signum(q) * _poly(TAIL_NUM, t) / _poly(TAIL_DEN, t)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(tail)


def _normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.sqrt(F.lit(2 * math.pi))


def _score(place: Column, n: Column) -> Column:
    """The expected normal score of a place among n; half places lie between two."""
    return normal_quantile((place - F.lit(0.375)) / (n + 0.25))


def _score_integrals(z: Column, place: Column, n: Column) -> tuple[Column, Column]:
    """What the sums of scores and of squared scores up to a half place add up to, ``z`` being its score.

    The midpoint form of Euler's summation: the integrals of the normal quantile and its square have closed forms, and two
    terms correct for the steps. From the 33rd place on from either end the error is below 1e-10 of a score.
    """
    width = n + 0.25
    density = _normal_density(z)
    slope = 1 / (width * density)
    cube = F.lit(7 / 5760) * slope * slope * slope
    plain = -width * density - slope / 24 + (1 + 2 * z * z) * cube
    square = (place - 0.375) - width * z * density - z * slope / 12 + 4 * z * (2 + z * z) * cube
    return plain, square


def _tie_scores(ranked: DataFrame, n: Column) -> DataFrame:
    """Adds ``m`` and ``mm``: the sums of scores and squared scores over each value's tie run.

    Runs of up to 64 places, and the 32 outermost places of longer ones, are added up one by one; what lies between has a closed form.
    So work and memory follow the distinct values, however often one occurs.
    """
    first, ties, half = (F.col("below") + 1).cast("double"), F.col("ties"), EACH_TIE // 2
    low, high = first + (half - 0.5), first + ties - (half + 0.5)
    tail = F.sequence((ties - half).cast("int"), (ties - 1).cast("int"))
    places = F.when(ties <= EACH_TIE, F.sequence(F.lit(0), (ties - 1).cast("int"))).otherwise(
        F.concat(F.sequence(F.lit(0), F.lit(half - 1)), tail)
    )
    scored = ranked.withColumns(
        {
            "__one": _score(first, n),
            "__each": F.when(ties > 1, F.transform(places, lambda i: _score(first + i, n))),
            "__low": F.when(ties > EACH_TIE, _score(low, n)),
            "__high": F.when(ties > EACH_TIE, _score(high, n)),
        }
    )
    below, above = _score_integrals(F.col("__low"), low, n), _score_integrals(F.col("__high"), high, n)

    def total(power: int) -> Column:
        return F.aggregate("__each", F.lit(0.0), lambda t, z: t + (z if power == 1 else z * z))

    sums = {
        name: F.when(ties == 1, one).otherwise(total(power) + F.coalesce(above[power - 1] - below[power - 1], F.lit(0.0)))
        for name, power, one in (("m", 1, F.col("__one")), ("mm", 2, F.col("__one") * F.col("__one")))
    }
    return scored.withColumns(sums).drop("__one", "__each", "__low", "__high")


def shapiro_wilk(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk W and its normal score per key, for 3 known values or more.

    W is defined at any size; the approximation of its distribution, which gives z, was fitted to samples of
    up to 5000 and is carried on beyond. A value that very many rows share is one row with the closed sum of its scores.
    """
    keys = list(keys)
    spread = long.groupBy(*keys).agg((F.var_samp("value") * (F.count("value") - 1)).alias("ss"))
    return _shapiro(tie_ranks(long, keys, "value"), spread, keys)


def _shapiro(ranked: DataFrame, spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From rows (value, ties, below, total) per distinct value and the sums of squares ``ss`` per key."""
    ranked = ranked.filter(F.col("total") >= 3).withColumnRenamed("total", "n")
    n = F.col("n").cast("double")
    last = F.col("below") + F.col("ties")

    def score(i) -> Column:
        return _score(i, n)

    def at(place: Column, name: str) -> Column:
        return F.max(F.when((F.col("below") < place) & (place <= last), F.col("value"))).alias(name)

    sums = _tie_scores(ranked, n).groupBy(*keys, "n").agg(
        F.sum("mm").alias("mm"),
        F.sum(F.col("m") * F.col("value")).alias("mx"),
        at(F.lit(1), "x1"),
        at(F.lit(2), "x2"),
        at(F.col("n") - 1, "y2"),
        at(F.col("n"), "y1"),
    )
    s = sums.join(spread, keys)
    s = s.withColumns({"m1": -score(F.lit(1)), "m2": -score(F.lit(2)), "u": 1 / F.sqrt(n)})
    s = s.withColumn("a1", F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(
        F.col("m1") / F.sqrt("mm") + _poly(LAST_WEIGHT, F.col("u"))))
    s = s.withColumn("a2", F.when(n > 5, F.col("m2") / F.sqrt("mm") + _poly(NEXT_WEIGHT, F.col("u"))))
    # Weights of the inner positions are the scores, scaled so that all squares sum to one.
    m_sq, a_sq = 2 * F.col("m1") * F.col("m1"), 2 * F.col("a1") * F.col("a1")
    inner = F.col("mx") - F.col("m1") * (F.col("y1") - F.col("x1"))
    wide = F.sqrt((F.col("mm") - m_sq) / (1 - a_sq))
    both = F.sqrt(
        (F.col("mm") - m_sq - 2 * F.col("m2") * F.col("m2")) / (1 - a_sq - 2 * F.col("a2") * F.col("a2"))
    )
    outer = F.col("a1") * (F.col("y1") - F.col("x1"))
    next_gap = F.col("y2") - F.col("x2")
    slope = (
        F.when(n == 3, outer)
        .when(n <= 5, outer + inner / wide)
        .otherwise(outer + F.col("a2") * next_gap + (inner - F.col("m2") * next_gap) / both)
    )
    s = s.withColumn("w", F.least(ratio(slope * slope, F.col("ss")), F.lit(1.0)))

    log_gap, log_n = F.ln(1 - F.col("w")), F.ln(n)
    small = (-F.ln(_poly(SMALL_GAMMA, n) - log_gap) - _poly(SMALL_MEAN, n)) / F.exp(_poly(SMALL_LOG_SD, n))
    large = (log_gap - _poly(LARGE_MEAN, log_n)) / F.exp(_poly(LARGE_LOG_SD, log_n))
    exact = F.greatest(
        F.lit(6 / 3.141592653589793) * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0)
    )
    return s.select(
        *keys,
        "n",
        "w",
        F.when(n > 11, large).when(n > 3, small).alias("z"),
        F.when(n == 3, exact).alias("p_exact"),
    )


def jarque_bera(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jarque-Bera statistic from population skewness and excess kurtosis, per key."""
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt")
    )
    s, k = F.col("skew"), F.col("kurt")
    return moments.withColumn("jb", F.col("n") / 6.0 * (s * s + k * k / 4.0))


def normality(long: DataFrame, keys: Sequence[str], method: str = "shapiro-wilk") -> DataFrame:
    """The named normality test (``NORMALITY_TESTS``) per key, the same at every sample size.

    Returns ``keys, n, method, statistic, p``, one row per key; fewer than 3 or constant values have no p. Shapiro-Wilk
    ranks all values; Jarque-Bera needs one aggregation and suits samples too large to rank.
    """
    keys = list(keys)
    if method not in NORMALITY_TESTS:
        raise ValueError(f"method must be one of {NORMALITY_TESTS}")
    if method == "jarque-bera":
        known = F.col("n") >= 3
        statistic = F.when(known, not_nan("jb"))
        tested = jarque_bera(long, keys).withColumns({"statistic": statistic, "p": F.exp(-statistic / 2)})
    else:
        counts = long.groupBy(*keys).agg(F.count("value").alias("n"))
        tested = counts.join(shapiro_wilk(long, keys).drop("n"), keys, "left")
        tested = tested.withColumns({"statistic": F.col("w"), "p": F.coalesce("p_exact", p_normal("z"))})
    return tested.select(*keys, "n", F.lit(method).alias("method"), "statistic", "p")


# ---------------------------------------------------------------- chi-squared


def chi_squared(long: DataFrame, by: Sequence[str] = (), yates: bool = True) -> DataFrame:
    """Pearson chi-squared of level against group per variable.

    Uses the identity ``sum((o - e)^2 / e) = n * (sum(o^2 / (row * column)) - 1)``, where
    empty cells add nothing, so the table never has to be completed. ``statistic`` has
    Yates' correction for 2 x 2 tables if ``yates``.
    """
    keys = [*by, "variable"]
    cells = long.groupBy(*keys, "level", "group").agg(F.count(F.lit(1)).alias("o"))
    levels = cells.groupBy(*keys, "level").agg(F.sum("o").alias("level_n"))
    parts = cells.join(levels, [*keys, "level"]).groupBy(*keys, "group").agg(
        F.sum("o").alias("group_n"),
        F.sum(F.col("o") * F.col("o").cast("double") / F.col("level_n")).alias("part"),
    )
    sums = parts.groupBy(*keys).agg(
        F.sum("group_n").alias("n"),
        F.sum(F.col("part") / F.col("group_n")).alias("share"),
        F.count(F.lit(1)).alias("n_groups"),
        F.min("group_n").cast("double").alias("g"),
    )
    heights = levels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_levels"), F.min("level_n").cast("double").alias("l")
    )
    n = F.col("n").cast("double")
    # In a 2 x 2 table every cell is equally far from its expectation, so the corrected
    # statistic follows from the plain one and the margins.
    g1, l1 = F.col("g") / n, F.col("l") / n
    margins = n * g1 * (1 - g1) * l1 * (1 - l1)
    gap = F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) * margins)
    corrected = ratio(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)), margins)
    two_by_two = F.lit(yates) & (F.col("n_groups") == 2) & (F.col("n_levels") == 2)
    return (
        sums.join(heights, keys)
        .withColumn("chi2", n * (F.col("share") - 1))
        .withColumn("df", ((F.col("n_groups") - 1) * (F.col("n_levels") - 1)).cast("double"))
        .withColumn("statistic", F.when(two_by_two, corrected).otherwise(F.col("chi2")))
        .select(*keys, "n", "n_groups", "n_levels", "df", "chi2", "statistic")
    )


# ---------------------------------------------------------------- chosen tests and tables


def compare_numeric(
    long: DataFrame,
    groups: tuple[str, str],
    by: Sequence[str] = (),
    normality_test: str = "shapiro-wilk",
    rank_sum: str = "normal",
) -> DataFrame:
    """The test each numeric variable calls for, with statistic, df and p.

    Both groups pass the normality test (p >= 0.05) and have equal variances (F test p >= 0.05): pooled t.
    Both pass and variances differ: Welch t. Otherwise Mann-Whitney, also where a group has too few or only equal values
    to be tested for normality. Where that has no p either, as a group is empty or all values are equal: "not testable".

    Every distinct value is dealt out once with its counts in both groups: normality of either and the ranks of both together
    come from that one table.
    """
    keys = [*by, "variable"]
    long = long.filter(F.col("group").isin(*groups))
    stats = f_statistics(t_statistics(two_group_moments(long, groups, by)))
    ranked = group_ranks(long, keys, "value", {side: F.col("group") == g for side, g in zip("ab", groups)})
    if normality_test == "shapiro-wilk":
        sides = [
            F.struct(F.lit(s).alias("group"), F.col(f"n_{s}").alias("ties"), F.col(f"below_{s}").alias("below"), F.col(f"total_{s}").alias("total"))
            for s in "ab"
        ]
        apart = ranked.select(*keys, "value", F.explode(F.array(*sides)).alias("side")).select(*keys, "value", "side.*").filter("ties > 0")
        squares = [F.struct(F.lit(s).alias("group"), (F.col(f"var_{s}") * (F.col(f"n_{s}") - 1)).alias("ss")) for s in "ab"]
        spread = stats.select(*keys, F.explode(F.array(*squares)).alias("side")).select(*keys, "side.*")
        tested = _shapiro(apart, spread, [*keys, "group"]).withColumn("p", F.coalesce("p_exact", p_normal("z")))
    else:
        tested = normality(long, [*keys, "group"], normality_test)
    normal = tested.groupBy(*keys).agg(((F.count("p") == 2) & (F.min("p") >= ALPHA)).alias("normal"))
    chosen = stats.join(normal, keys, "left").withColumns(
        {
            "normal": F.coalesce("normal", F.lit(False)),
            "p_f": p_f("f", "df1", "df2"),
            "p_pooled": p_t("t_pooled", "df_pooled"),
            "p_welch": p_t("t_welch", "df_welch"),
        }
    )
    pooled = ranked.withColumns({"ties": F.col("n_a") + F.col("n_b"), "below": F.col("below_a") + F.col("below_b"), "in_a": F.col("n_a"), "in_b": F.col("n_b")})
    sums = _rank_sums(pooled, keys).join(chosen.filter("NOT normal").select(*keys), keys, "left_semi") if rank_sum == "exact" else _rank_sums(pooled, keys)
    ranks = rank_sum_p(sums, rank_sum).select(*keys, "u_a", F.col("p").alias("p_u"))
    equal = F.col("p_f") >= ALPHA
    rank_test = F.when(F.col("p_u").isNull(), F.lit("not testable")).otherwise(F.lit("mann-whitney"))

    def choose(u, pooled, welch) -> Column:
        return F.when(~F.col("normal"), u).when(equal, pooled).otherwise(welch)

    return chosen.join(ranks, keys, "left").select(
        *keys,
        choose(rank_test, F.lit("t pooled"), F.lit("t welch")).alias("test"),
        choose(F.when(F.col("p_u").isNotNull(), F.col("u_a")), F.col("t_pooled"), F.col("t_welch")).alias("statistic"),
        choose(F.lit(None).cast("double"), F.col("df_pooled"), F.col("df_welch")).alias("df"),
        choose(F.col("p_u"), F.col("p_pooled"), F.col("p_welch")).alias("p"),
        F.lit(normality_test).alias("normality_test"),
    )


def compare_categorical(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chi-squared with p for each categorical variable; "not testable" where there is one level or one group only."""
    stats = chi_squared(long, by)
    apart = F.col("df") > 0
    stats = stats.withColumns({c: F.when(apart, F.col(c)) for c in ("statistic", "df")})
    return stats.select(
        *by, "variable", F.when(F.col("df").isNotNull(), "chi-squared").otherwise("not testable").alias("test"), "statistic", "df",
        p_chi2("statistic", "df").alias("p"), F.lit(None).cast("string").alias("normality_test"),
    )


def group_compare(
    df: DataFrame,
    group: str,
    groups: tuple[str, str],
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    by: Sequence[str] = (),
    normality_test: str = "shapiro-wilk",
    rank_sum: str = "normal",
) -> DataFrame:
    """One row per variable (and slice): which test was used, its statistic, df and p."""
    chosen = df.filter(F.col(group).isin(*groups))
    parts = []
    if numeric:
        parts.append(compare_numeric(unpivot_numeric(chosen, group, numeric, by), groups, by, normality_test, rank_sum))
    if categorical:
        parts.append(compare_categorical(unpivot_categorical(chosen, group, categorical, by), by))
    if not parts:
        raise ValueError("no variables given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_one(
    df: DataFrame,
    group: str,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``variable, level, stratum, n, pct, mean, sd``: mean (sd) and n (%) by group."""
    parts = []
    if numeric:
        long = unpivot_numeric(df, group, numeric, by)
        parts.append(
            long.groupBy(*by, "variable", F.col("group").alias("stratum")).agg(
                F.lit(None).cast("string").alias("level"),
                F.count("value").alias("n"),
                F.lit(None).cast("double").alias("pct"),
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("sd"),
            )
        )
    if categorical:
        long = unpivot_categorical(df, group, categorical, by).withColumnRenamed("group", "stratum")
        cells = long.groupBy(*by, "variable", "stratum", "level").agg(F.count(F.lit(1)).alias("n"))
        totals = cells.groupBy(*by, "variable", "stratum").agg(F.sum("n").alias("__total"))
        parts.append(
            cells.join(totals, [*by, "variable", "stratum"]).select(
                *by, "variable", "stratum", "level", "n",
                (100.0 * F.col("n") / F.col("__total")).alias("pct"),
                F.lit(None).cast("double").alias("mean"),
                F.lit(None).cast("double").alias("sd"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*by, "variable", "level", "stratum", "n", "pct", "mean", "sd")


def table_one_with_p(
    df: DataFrame,
    group: str,
    groups: tuple[str, str],
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    by: Sequence[str] = (),
    normality_test: str = "shapiro-wilk",
) -> DataFrame:
    """:func:`table_one` with the chosen test, statistic and p of each variable."""
    chosen = df.filter(F.col(group).isin(*groups))
    tests = group_compare(chosen, group, groups, numeric, categorical, by, normality_test)
    return table_one(chosen, group, numeric, categorical, by).join(
        tests.select(*by, "variable", "test", "statistic", "p"), [*by, "variable"], "left"
    )
