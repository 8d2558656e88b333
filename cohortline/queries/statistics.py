"""Group summaries, tests and Table 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions.pvalues import p_f, p_t
from cohortline.operators import compare
from cohortline.queries.registry import Tables, query, rounded

PAIR = ("click", "view")


def _values(t: Tables):
    return compare.unpivot_numeric(t.events, "event_type", ["value"])


def _prices(t: Tables):
    rows = t.orders.filter(F.col("o_orderstatus").isin("F", "P")).withColumnRenamed("o_orderstatus", "status")
    return rows.withColumn("year", F.year("o_orderdate"))


@query("group_summary", """
SELECT 'o_totalprice' AS variable, o_orderpriority AS "group", count(*) AS n, round(avg(o_totalprice), 4) AS mean,
  round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max,
  round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(quantile_cont(o_totalprice, 0.75), 4) AS q3
FROM orders GROUP BY o_orderpriority
""")
def group_summary(t: Tables):
    long = compare.unpivot_numeric(t.orders, "o_orderpriority", ["o_totalprice"])
    return rounded(compare.group_summary(long), 4, "mean", "sd", "q1", "median", "q3")


@query("group_summary_sketch", """
SELECT 'o_totalprice' AS variable, o_orderpriority AS "group", count(*) AS n, round(avg(o_totalprice), 4) AS mean,
  min(o_totalprice) AS min, max(o_totalprice) AS max, true AS q1_within, true AS median_within, true AS q3_within
FROM orders GROUP BY o_orderpriority
""")
def group_summary_sketch(t: Tables):
    """Sketched quartiles: do their true ranks, counted over all rows, lie within the stated error?"""
    long = compare.unpivot_numeric(t.orders, "o_orderpriority", ["o_totalprice"])
    accuracy, probs = 1000, {"q1": 0.25, "median": 0.5, "q3": 0.75}
    summary = compare.group_summary(long, quantiles="sketch", accuracy=accuracy)
    counts = [F.count_if(F.col("value") < F.col(q)).alias(f"{q}_below") for q in probs]
    counts += [F.count_if(F.col("value") <= F.col(q)).alias(f"{q}_upto") for q in probs]
    keys = ["variable", "group", "n", "mean", "min", "max"]
    ranked = long.join(summary, ["variable", "group"]).groupBy(*keys).agg(*counts)
    slack = F.col("n") / accuracy + 1
    within = {
        f"{q}_within": (F.col(f"{q}_below") <= p * F.col("n") + slack) & (F.col(f"{q}_upto") >= p * F.col("n") - slack) for q, p in probs.items()
    }
    return rounded(ranked.withColumns(within).select(*keys, *within), 4, "mean")


@query("table_one", """
SELECT 'o_totalprice' AS variable, NULL::VARCHAR AS level, o_orderstatus AS stratum, count(*) AS n,
       NULL::DOUBLE AS pct, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd
FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 'o_orderpriority', o_orderpriority, o_orderstatus, count(*),
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 4), NULL, NULL
FROM orders GROUP BY o_orderpriority, o_orderstatus
""")
def table_one(t: Tables):
    out = compare.table_one(t.orders, "o_orderstatus", ["o_totalprice"], ["o_orderpriority"])
    return rounded(out, 4, "pct", "mean", "sd")


MOMENTS_SQL = """
m AS (
  SELECT 'value' AS variable,
    count(*) FILTER (event_type = 'click') AS n_a, count(*) FILTER (event_type = 'view') AS n_b,
    avg(value) FILTER (event_type = 'click') AS mean_a, avg(value) FILTER (event_type = 'view') AS mean_b,
    var_samp(value) FILTER (event_type = 'click') AS var_a, var_samp(value) FILTER (event_type = 'view') AS var_b
  FROM events)
"""


@query("ttest_stats", f"""
WITH {MOMENTS_SQL}
SELECT variable, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
  round((mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)), 6)
    AS t_pooled,
  (n_a + n_b - 2)::DOUBLE AS df_pooled,
  round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 6) AS t_welch,
  round(power(var_a / n_a + var_b / n_b, 2)
        / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)), 4) AS df_welch
FROM m
""")
def ttest_stats(t: Tables):
    out = compare.t_statistics(compare.two_group_moments(_values(t), PAIR)).drop("var_a", "var_b")
    return rounded(rounded(out, 6, "mean_a", "mean_b", "t_pooled", "t_welch"), 4, "df_welch")


@query("ftest_stats", f"""
WITH {MOMENTS_SQL}
SELECT variable, round(var_a, 5) AS var_a, round(var_b, 5) AS var_b, round(var_a / var_b, 6) AS f,
       (n_a - 1)::DOUBLE AS df1, (n_b - 1)::DOUBLE AS df2 FROM m
""")
def ftest_stats(t: Tables):
    out = compare.f_statistics(compare.two_group_moments(_values(t), PAIR))
    return rounded(rounded(out, 5, "var_a", "var_b"), 6, "f").select("variable", "var_a", "var_b", "f", "df1", "df2")


def _simpson(density: str, upper: str, steps: int) -> str:
    """SQL of the integral of ``density``, an expression in u, from 0 to ``upper``."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    point = density.replace("{u}", f"({upper} * i / {steps})")
    return f"({upper} / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * ({point}))))"


def _t_tail_sql(t: str, df: str) -> str:
    """Both tails of t, by integrating its density up to |t|."""
    constant = f"(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()))"
    density = f"exp({constant} - ({df} + 1) / 2 * ln(1 + {{u}} * {{u}} / {df}))"
    return f"(1 - 2 * {_simpson(density, f'abs({t})', 2000)})"


@query("ttest_p", f"""
WITH {MOMENTS_SQL},
t AS (
  SELECT variable, (n_a + n_b - 2)::DOUBLE AS df,
    (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)) AS pooled,
    (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS welch,
    power(var_a / n_a + var_b / n_b, 2) / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)) AS df_welch
  FROM m)
SELECT variable, round({_t_tail_sql("pooled", "df")}, 7) AS p_pooled, round({_t_tail_sql("welch", "df_welch")}, 7) AS p_welch FROM t
""")
def ttest_p(t: Tables):
    out = compare.t_statistics(compare.two_group_moments(_values(t), PAIR))
    out = out.select("variable", p_t("t_pooled", "df_pooled").alias("p_pooled"), p_t("t_welch", "df_welch").alias("p_welch"))
    return rounded(out, 7, "p_pooled", "p_welch")


BETA_DENSITY = "CASE WHEN {u} = 0 THEN 0 ELSE exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln({u}) + (b - 1) * ln(1 - {u})) END"


@query("ftest_p", f"""
WITH {MOMENTS_SQL},
f AS (SELECT variable, (n_a - 1) / 2.0 AS a, (n_b - 1) / 2.0 AS b, var_a / var_b AS f FROM m),
x AS (SELECT *, a * f / (a * f + b) AS x FROM f),
l AS (SELECT variable, {_simpson(BETA_DENSITY, "x", 20000)} AS lower FROM x)
SELECT variable, round(2 * least(lower, 1 - lower), 7) AS p_f FROM l
""")
def ftest_p(t: Tables):
    out = compare.f_statistics(compare.two_group_moments(_values(t), PAIR))
    return rounded(out.select("variable", p_f("f", "df1", "df2").alias("p_f")), 7, "p_f")


@query("mannwhitney_u", """
WITH r AS (
  SELECT event_type, value, rank() OVER (ORDER BY value) AS lo, count(*) OVER (PARTITION BY value) AS ties
  FROM events WHERE event_type IN ('click', 'view')),
s AS (
  SELECT count(*) FILTER (event_type = 'click') AS n_a, count(*) FILTER (event_type = 'view') AS n_b,
    sum(lo + (ties - 1) / 2.0) FILTER (event_type = 'click') AS rank_sum_a,
    sum(ties::DOUBLE * ties - 1) AS tie_term FROM r),
u AS (SELECT *, rank_sum_a - n_a * (n_a + 1) / 2.0 AS u_a FROM s)
SELECT 'value' AS variable, n_a, n_b, round(rank_sum_a, 1) AS rank_sum_a, round(tie_term, 1) AS tie_term,
  round(u_a, 1) AS u_a,
  round((u_a - n_a * n_b / 2.0 - 0.5 * sign(u_a - n_a * n_b / 2.0))
    / sqrt(n_a::DOUBLE * n_b / 12 * (n_a + n_b + 1 - tie_term / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))), 6) AS z
FROM u
""")
def mannwhitney_u(t: Tables):
    out = compare.mann_whitney(_values(t), PAIR)
    return rounded(rounded(out, 1, "rank_sum_a", "tie_term", "u_a"), 6, "z")


BY_NATION = ("owners", "others")


def _by_nation(t: Tables):
    """Account balances of two customer groups in every nation; the key's share of a cent keeps values apart."""
    owner = F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")
    return t.customer.select(
        F.col("c_nationkey").alias("nation"),
        F.when(owner, BY_NATION[0]).otherwise(BY_NATION[1]).alias("customers"),
        (F.col("c_acctbal") + F.col("c_custkey") / 1e8).alias("balance"),
    )


BALANCES_SQL = """
balances AS (
  SELECT c_nationkey AS nation, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'owners' ELSE 'others' END AS customers,
         c_acctbal + c_custkey / 1e8 AS balance FROM customer)
"""
U_SQL = """
placed AS (SELECT nation, customers, rank() OVER (PARTITION BY nation ORDER BY balance) AS place FROM balances),
sums AS (
  SELECT nation, count(*) FILTER (customers = 'owners') AS n_a, count(*) FILTER (customers = 'others') AS n_b,
         sum(place) FILTER (customers = 'owners') AS rank_sum FROM placed GROUP BY nation),
us AS (SELECT nation, n_a, n_b, (coalesce(rank_sum, 0) - n_a * (n_a + 1) / 2)::DOUBLE AS u_a FROM sums)
"""


# The counts of rankings by U, one more value at a time: a product with 1 - x^(larger + n), then a quotient by 1 - x^n.
@query("mannwhitney_exact", f"""
WITH RECURSIVE {BALANCES_SQL}, {U_SQL},
sized AS (
  SELECT *, least(n_a, n_b) AS small, greatest(n_a, n_b) AS large, n_a * n_b // 2 + 1 AS half FROM us WHERE n_a > 0 AND n_b > 0),
ways AS (
  SELECT nation, 0::BIGINT AS n, list_transform(range(half), lambda i: CASE WHEN i = 0 THEN 1 ELSE 0 END::DOUBLE) AS w FROM sized
  UNION ALL
  SELECT nation, n, list_transform(range(len(a)), lambda u: list_sum(a[u % n + 1:u + 1:n])) FROM (
    SELECT w.nation, w.n + 1 AS n, list_transform(range(len(w.w)), lambda u: w.w[u + 1] - CASE WHEN u >= large + w.n + 1 THEN w.w[u - large - w.n] ELSE 0 END) AS a
    FROM ways w JOIN sized s ON w.nation = s.nation WHERE w.n < small)),
tails AS (
  SELECT s.*, list_sum(w.w[1:least(u_a, n_a * n_b - u_a)::BIGINT + 1]) AS tail,
         exp(lgamma(n_a + n_b + 1) - lgamma(n_a + 1) - lgamma(n_b + 1)) AS whole
  FROM sized s JOIN ways w ON w.nation = s.nation AND w.n = s.small)
SELECT us.nation, us.n_a, us.n_b, us.u_a, CASE WHEN tail IS NOT NULL THEN round(least(1, 2 * tail / whole), 7) END AS p FROM us LEFT JOIN tails USING (nation)
""")
def mannwhitney_exact(t: Tables):
    long = compare.unpivot_numeric(_by_nation(t), "customers", ["balance"], ["nation"])
    out = compare.rank_sum_p(compare.mann_whitney(long, BY_NATION, ["nation"]), "exact")
    return rounded(out.select("nation", "n_a", "n_b", "u_a", "p"), 7, "p")


def _newton_t(steps: int) -> str:
    """SQL of the t that leaves 5 % in both tails, from 1.96 on by Newton steps on the integrated density."""
    density = "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + {t} * {t} / df))"
    parts, last = ["q0 AS (SELECT *, 1.96::DOUBLE AS q FROM both_tests)"], "q0"
    for i in range(1, steps + 1):
        step = f"q + ({_t_tail_sql('q', 'df')} - 0.05) / (2 * {density.replace('{t}', 'q')})"
        parts.append(f"q{i} AS (SELECT * EXCLUDE (q), {step} AS q FROM {last})")
        last = f"q{i}"
    return ",\n".join(parts)


@query("ttest_intervals", f"""
WITH m AS (
  SELECT o_orderpriority, 'o_totalprice' AS variable,
    (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS n_a, (count(*) FILTER (o_orderstatus = 'P'))::DOUBLE AS n_b,
    avg(o_totalprice) FILTER (o_orderstatus = 'F') AS mean_a, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS mean_b,
    var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va, var_samp(o_totalprice) FILTER (o_orderstatus = 'P') AS vb
  FROM orders GROUP BY o_orderpriority),
both_tests AS (
  SELECT *, 't pooled' AS method, n_a + n_b - 2 AS df, sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS se FROM m
  UNION ALL
  SELECT *, 't welch', power(va / n_a + vb / n_b, 2) / (power(va / n_a, 2) / (n_a - 1) + power(vb / n_b, 2) / (n_b - 1)),
    sqrt(va / n_a + vb / n_b) FROM m),
{_newton_t(6)}
SELECT o_orderpriority, variable, method, round(mean_a, 3) AS mean_a, round(mean_b, 3) AS mean_b, round(mean_a - mean_b, 3) AS estimate,
  round((mean_a - mean_b) / se, 6) AS t, round(df, 4) AS df, round({_t_tail_sql("((mean_a - mean_b) / se)", "df")}, 6) AS p,
  round(mean_a - mean_b - q * se, 2) AS low, round(mean_a - mean_b + q * se, 2) AS high
FROM q6
""")
def ttest_intervals(t: Tables):
    """Estimate and 95 % interval of the difference in every slice, by both t tests."""
    long = compare.unpivot_numeric(_prices(t), "status", ["o_totalprice"], ["o_orderpriority"])
    out = compare.mean_differences(long, ("F", "P"), ["o_orderpriority"])
    return rounded(rounded(rounded(rounded(out, 3, "mean_a", "mean_b", "estimate"), 6, "t", "p"), 4, "df"), 2, "low", "high")


@query("chi2_stat", """
WITH c AS (SELECT o_orderpriority AS l, o_orderstatus AS g, count(*) AS o FROM orders GROUP BY 1, 2),
e AS (SELECT *, sum(o) OVER (PARTITION BY l) * sum(o) OVER (PARTITION BY g) / (sum(o) OVER ())::DOUBLE AS e FROM c)
SELECT 'o_orderpriority' AS variable, sum(o)::BIGINT AS n, count(DISTINCT g) AS n_groups, count(DISTINCT l) AS n_levels,
  ((count(DISTINCT g) - 1) * (count(DISTINCT l) - 1))::DOUBLE AS df,
  round(sum(power(o - e, 2) / e), 6) AS chi2, round(sum(power(o - e, 2) / e), 6) AS statistic
FROM e
""")
def chi2_stat(t: Tables):
    long = compare.unpivot_categorical(t.orders, "o_orderstatus", ["o_orderpriority"])
    return rounded(compare.chi_squared(long), 6, "chi2", "statistic")


@query("chi2_yates", """
WITH x AS (SELECT (l_tax > 0.04)::VARCHAR AS l, l_returnflag AS g FROM lineitem WHERE l_returnflag <> 'N'),
c AS (SELECT l, g, count(*) AS o FROM x GROUP BY 1, 2),
e AS (SELECT *, sum(o) OVER (PARTITION BY l) * sum(o) OVER (PARTITION BY g) / (sum(o) OVER ())::DOUBLE AS e FROM c)
SELECT 'high_tax' AS variable, sum(o)::BIGINT AS n, 2::BIGINT AS n_groups, 2::BIGINT AS n_levels, 1.0::DOUBLE AS df,
  round(sum(power(o - e, 2) / e), 6) AS chi2,
  round(sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 6) AS statistic
FROM e
""")
def chi2_yates(t: Tables):
    rows = t.lineitem.filter("l_returnflag <> 'N'").select("l_returnflag", (F.col("l_tax") > 0.04).alias("high_tax"))
    long = compare.unpivot_categorical(rows, "l_returnflag", ["high_tax"])
    return rounded(compare.chi_squared(long), 6, "chi2", "statistic")


@query("jarque_bera", """
WITH c AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d FROM events),
k AS (
  SELECT event_type, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4
  FROM c GROUP BY event_type)
SELECT 'value' AS variable, event_type AS "group", n, round(m3 / power(m2, 1.5), 6) AS skew,
  round(m4 / (m2 * m2) - 3, 6) AS kurt,
  round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 3) AS jb
FROM k
""")
def jarque_bera(t: Tables):
    out = compare.jarque_bera(_values(t), ["variable", "group"])
    return rounded(rounded(out, 6, "skew", "kurt"), 3, "jb")


def _upper_tail(x: str) -> str:
    """SQL of the normal upper tail for x >= 0: half less a series of positive terms, and 0 from 8 on."""
    series = f"list_sum(list_transform(range(0, 80), lambda k: power({x}, 2 * k + 1) * power(2.0, k) * gamma(k + 1) / gamma(2 * k + 2)))"
    return f"(CASE WHEN {x} >= 8 THEN 0 ELSE 0.5 - exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {series} END)"


def _newton(column: str) -> str:
    return f"{column} + ({_upper_tail(column)} - tail) * sqrt(2 * pi()) * exp({column} * {column} / 2)"


def _shapiro_sql(table: str, group: str, value: str) -> str:
    """The textbook form: every position gets its weight, and W is a squared weighted sum; ``shapiro`` has w, z and p.

    Normal quantiles come from a rough published start (26.2.23 of the handbook of mathematical functions) and three
    Newton steps on the series of the normal integral, the rest from the published polynomials.
    """
    return f"""
x AS (
  SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS i,
         count(*) OVER (PARTITION BY {group}) AS n FROM {table} WHERE {value} IS NOT NULL AND {group} IS NOT NULL),
p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM x WHERE n >= 3),
tails AS (SELECT *, least(p, 1 - p) AS tail, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p),
start AS (
  SELECT *, greatest(t - (2.515517 + 0.802853 * t + 0.010328 * t * t)
    / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t), 0) AS s0 FROM tails),
step1 AS (SELECT *, {_newton("s0")} AS s1 FROM start),
step2 AS (SELECT *, {_newton("s1")} AS s2 FROM step1),
scored AS (SELECT *, sign(p - 0.5) * ({_newton("s2")}) AS m FROM step2),
sized AS (
  SELECT *, sum(m * m) OVER (PARTITION BY g) AS mm, min(m) OVER (PARTITION BY g) AS lowest,
         min(CASE WHEN i = 2 THEN m END) OVER (PARTITION BY g) AS second FROM scored),
extreme AS (
  SELECT *, CASE WHEN n = 3 THEN sqrt(0.5) ELSE -2.706056 * power(n, -2.5) + 4.434685 * power(n, -2) - 2.07119 * power(n, -1.5) - 0.147981 / n
           + 0.221157 / sqrt(n) - lowest / sqrt(mm) END AS a1,
         -3.582633 * power(n, -2.5) + 5.682633 * power(n, -2) - 1.752461 * power(n, -1.5) - 0.293762 / n
           + 0.042981 / sqrt(n) - second / sqrt(mm) AS a2 FROM sized),
weighted AS (
  SELECT *, CASE WHEN i = 1 THEN -a1 WHEN i = n THEN a1 WHEN n = 3 THEN 0
    WHEN n <= 5 THEN m / sqrt((mm - 2 * lowest * lowest) / (1 - 2 * a1 * a1))
    WHEN i = 2 THEN -a2 WHEN i = n - 1 THEN a2
    ELSE m / sqrt((mm - 2 * lowest * lowest - 2 * second * second) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a
  FROM extreme),
stat AS (SELECT g, max(n) AS n, least(power(sum(a * v), 2) / nullif(var_samp(v) * (count(*) - 1), 0), 1) AS w FROM weighted GROUP BY g),
z_scores AS (
  SELECT *, CASE WHEN n > 11 THEN
      (ln(1 - w) + 1.5861 + 0.31082 * ln(n) + 0.083751 * ln(n) * ln(n) - 0.0038915 * ln(n) * ln(n) * ln(n))
      / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * ln(n) * ln(n))
    WHEN n > 3 THEN
      (-ln(0.459 * n - 2.273 - ln(1 - w)) - 0.544 + 0.39978 * n - 0.025054 * n * n + 6.714e-4 * n * n * n)
      / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n) END AS z FROM stat),
shapiro AS (
  SELECT *, CASE WHEN w IS NULL THEN NULL WHEN n = 3 THEN greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0)
    WHEN z >= 0 THEN {_upper_tail("z")} ELSE 1 - {_upper_tail("(-z)")} END AS p FROM z_scores)
"""


def chosen_tests_sql(table: str) -> str:
    """The whole choice for rows (k, side a or b, v): ``chosen`` has each k's test with statistic, df and p."""
    return f"""
sided AS (SELECT k || '|' || side AS ks, v FROM {table} WHERE v IS NOT NULL),
{_shapiro_sql("sided", "ks", "v")},
normal AS (SELECT regexp_replace(g, '[|][ab]$', '') AS k, count(p) = 2 AND min(p) >= 0.05 AS normal FROM shapiro GROUP BY 1),
places AS (
  SELECT k, side, v, rank() OVER (PARTITION BY k ORDER BY v) AS lo, count(*) OVER (PARTITION BY k, v) AS ties FROM {table} WHERE v IS NOT NULL),
sums AS (
  SELECT k, (count(*) FILTER (side = 'a'))::DOUBLE AS na, (count(*) FILTER (side = 'b'))::DOUBLE AS nb,
    coalesce(sum(lo + (ties - 1) / 2.0) FILTER (side = 'a'), 0) AS ra, sum(ties::DOUBLE * ties - 1) AS tie_term,
    avg(v) FILTER (side = 'a') AS mean_a, avg(v) FILTER (side = 'b') AS mean_b,
    var_samp(v) FILTER (side = 'a') AS va, var_samp(v) FILTER (side = 'b') AS vb FROM places GROUP BY k),
us AS (
  SELECT *, ra - na * (na + 1) / 2 AS ua, na + nb - 2 AS df, (na - 1) / 2 AS a, (nb - 1) / 2 AS b,
    (mean_a - mean_b) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / nullif(na + nb - 2, 0) * (1 / nullif(na, 0) + 1 / nullif(nb, 0))), 0) AS pooled,
    (mean_a - mean_b) / nullif(sqrt(va / nullif(na, 0) + vb / nullif(nb, 0)), 0) AS welch,
    power(va / na + vb / nb, 2) / nullif(power(va / na, 2) / nullif(na - 1, 0) + power(vb / nb, 2) / nullif(nb - 1, 0), 0) AS df_welch,
    sqrt(na * nb / 12 * (na + nb + 1 - tie_term / nullif((na + nb) * (na + nb - 1), 0))) AS sigma
  FROM sums),
ratios AS (
  SELECT *, a * (va / nullif(vb, 0)) / (a * (va / nullif(vb, 0)) + b) AS x,
    (abs(ua - na * nb / 2) - CASE WHEN ua = na * nb / 2 THEN 0 ELSE 0.5 END) / nullif(sigma, 0) AS zu FROM us),
lowers AS (SELECT *, {_simpson(BETA_DENSITY, "x", 4000)} AS lower FROM ratios),
picked AS (
  SELECT lowers.*, CASE WHEN NOT coalesce(normal, false) THEN CASE WHEN zu IS NULL THEN 'not testable' ELSE 'mann-whitney' END
    WHEN 2 * least(lower, 1 - lower) >= 0.05 THEN 't pooled' ELSE 't welch' END AS test FROM lowers LEFT JOIN normal USING (k)),
chosen AS (
  SELECT k, test, CASE test WHEN 'mann-whitney' THEN ua WHEN 't pooled' THEN pooled WHEN 't welch' THEN welch END AS statistic,
    CASE test WHEN 't pooled' THEN df WHEN 't welch' THEN df_welch END AS df,
    CASE test WHEN 'mann-whitney' THEN least(2 * CASE WHEN zu >= 0 THEN {_upper_tail("zu")} ELSE 1 - {_upper_tail("(-zu)")} END, 1) WHEN 't pooled' THEN {_t_tail_sql("pooled", "df")}
      WHEN 't welch' THEN {_t_tail_sql("welch", "df_welch")} END AS p FROM picked)
"""


def chi_squared_sql(table: str) -> str:
    """Pearson's test of (k, level, side) rows, with Yates' correction for 2 x 2 tables: ``chi`` has each k's test."""
    return f"""
cells AS (SELECT k, level, side, count(*) AS o FROM {table} WHERE level IS NOT NULL GROUP BY ALL),
grid AS (
  SELECT l.k, l.level, s.side, coalesce(o, 0) AS o FROM (SELECT DISTINCT k, level FROM cells) l
  JOIN (SELECT DISTINCT k, side FROM cells) s ON l.k = s.k LEFT JOIN cells c ON c.k = l.k AND c.level = l.level AND c.side = s.side),
expected AS (
  SELECT *, sum(o) OVER (PARTITION BY k, level) * sum(o) OVER (PARTITION BY k, side) / (sum(o) OVER (PARTITION BY k))::DOUBLE AS e FROM grid),
chi_sums AS (
  SELECT k, ((count(DISTINCT level) - 1) * (count(DISTINCT side) - 1))::DOUBLE AS df,
    CASE WHEN count(*) = 4 AND count(DISTINCT level) = 2 THEN sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e)
    ELSE sum(power(o - e, 2) / e) END AS x FROM expected GROUP BY k),
chi AS (
  SELECT k, CASE WHEN df > 0 THEN 'chi-squared' ELSE 'not testable' END AS test, CASE WHEN df > 0 THEN x END AS statistic,
    CASE WHEN df > 0 THEN df END AS df,
    CASE df WHEN 1 THEN 2 * {_upper_tail("sqrt(x)")} WHEN 2 THEN exp(-x / 2)
      WHEN 3 THEN 2 * {_upper_tail("sqrt(x)")} + sqrt(2 * x / pi()) * exp(-x / 2) WHEN 4 THEN exp(-x / 2) * (1 + x / 2) END AS p
  FROM chi_sums)
"""


@query("shapiro_w", f"""
WITH {_shapiro_sql("customer", "c_mktsegment", "c_acctbal")}
SELECT 'c_acctbal' AS variable, g AS "group", n, round(w, 8) AS w, round(z, 5) AS z FROM shapiro
""")
def shapiro_w(t: Tables):
    long = compare.unpivot_numeric(t.customer, "c_mktsegment", ["c_acctbal"])
    out = compare.shapiro_wilk(long, ["variable", "group"]).drop("p_exact")
    return rounded(rounded(out, 8, "w"), 5, "z")


@query("normality", f"""
WITH {_shapiro_sql("orders", "o_orderpriority", "o_totalprice")}
SELECT 'o_totalprice' AS variable, g AS "group", n, 'shapiro-wilk' AS method, round(w, 8) AS statistic, round(p, 8) AS p
FROM shapiro
""")
def normality(t: Tables):
    long = compare.unpivot_numeric(t.orders, "o_orderpriority", ["o_totalprice"])
    return rounded(compare.normality(long, ["variable", "group"]), 8, "statistic", "p")


# Both groups of every nation pass through the whole choice: normality, equal variances, then the test itself.
@query("group_compare_by_nation", f"""
WITH {BALANCES_SQL}, tested AS (SELECT nation::VARCHAR AS k, CASE customers WHEN 'owners' THEN 'a' ELSE 'b' END AS side, balance AS v FROM balances),
{chosen_tests_sql("tested")}
SELECT k::BIGINT AS nation, 'balance' AS variable, test, round(statistic, 6) AS statistic, round(df, 4) AS df, round(p, 6) AS p,
  'shapiro-wilk' AS normality_test
FROM chosen
""")
def group_compare_by_nation(t: Tables):
    """Small samples, where the choice leads to each of the three tests."""
    out = compare.group_compare(_by_nation(t), "customers", BY_NATION, ["balance"], by=["nation"])
    return rounded(rounded(out, 6, "statistic", "p"), 4, "df").withColumn("nation", F.col("nation").cast("long"))


CATEGORY_SQL = """
x AS (SELECT o_orderstatus AS g, o_orderpriority, year(o_orderdate)::VARCHAR AS y FROM orders WHERE o_orderstatus IN ('F', 'P')),
c AS (
  SELECT 'o_orderpriority' AS v, o_orderpriority AS l, g, count(*) AS o FROM x GROUP BY ALL
  UNION ALL SELECT 'year', y, g, count(*) FROM x GROUP BY ALL),
e AS (
  SELECT *, sum(o) OVER (PARTITION BY v, l) * sum(o) OVER (PARTITION BY v, g) / (sum(o) OVER (PARTITION BY v))::DOUBLE AS e FROM c),
s AS (SELECT v, sum(power(o - e, 2) / e) AS stat, (count(DISTINCT l) - 1)::DOUBLE AS df FROM e GROUP BY v),
categories AS (
  SELECT v AS variable, 'chi-squared' AS test, stat AS statistic, df, NULL::VARCHAR AS normality_test,
    exp(-stat / 2) * (1 + stat / 2 + CASE WHEN df = 6 THEN power(stat / 2, 2) / 2 ELSE 0 END) AS p
  FROM s)
"""


def _rank_sum_sql(slice_expr: str) -> str:
    """Rank-sum test of prices per slice; its normal tail is summed from the series of erf.

    Prices are spread evenly, far from normal in both groups, so this is the test due.
    """
    return f"""
prices AS (SELECT {slice_expr} AS k, o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'P')),
r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY v) AS lo, count(*) OVER (PARTITION BY k, v) AS ties FROM prices),
sums AS (
  SELECT k, count(*) FILTER (g = 'F')::DOUBLE AS na, count(*) FILTER (g = 'P')::DOUBLE AS nb,
    sum(lo + (ties - 1) / 2.0) FILTER (g = 'F') AS ra, sum(ties::DOUBLE * ties - 1) AS tie_term FROM r GROUP BY k),
u AS (SELECT *, ra - na * (na + 1) / 2 AS ua FROM sums),
z AS (
  SELECT *, (abs(ua - na * nb / 2) - CASE WHEN ua = na * nb / 2 THEN 0 ELSE 0.5 END)
    / sqrt(na * nb / 12 * (na + nb + 1 - tie_term / ((na + nb) * (na + nb - 1)))) / sqrt(2) AS h FROM u),
ranked AS (
  SELECT k, 'o_totalprice' AS variable, 'mann-whitney' AS test, ua AS statistic, NULL::DOUBLE AS df,
    'shapiro-wilk' AS normality_test,
    1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100), lambda n:
      CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * power(h, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) AS p
  FROM z)
"""


# With an even number of degrees of freedom the chi-squared tail is a finite sum.
@query("compare_categorical", f"""
WITH {CATEGORY_SQL}
SELECT variable, test, round(statistic, 6) AS statistic, df, normality_test, round(p, 8) AS p FROM categories
""")
def compare_categorical(t: Tables):
    long = compare.unpivot_categorical(_prices(t), "status", ["o_orderpriority", "year"])
    return rounded(rounded(compare.compare_categorical(long), 6, "statistic"), 8, "p")


@query("group_compare", f"""
WITH {CATEGORY_SQL}, {_rank_sum_sql("'all'")}
SELECT variable, test, round(statistic, 6) AS statistic, df, normality_test, round(p, 8) AS p FROM categories
UNION ALL SELECT variable, test, round(statistic, 6), df, normality_test, round(p, 8) FROM ranked
""")
def group_compare(t: Tables):
    out = compare.group_compare(_prices(t), "status", ("F", "P"), ["o_totalprice"], ["o_orderpriority", "year"])
    return rounded(rounded(out, 6, "statistic"), 8, "p")


@query("group_compare_by_slice", f"""
WITH {_rank_sum_sql("o_orderpriority")}
SELECT k AS o_orderpriority, variable, test, round(statistic, 6) AS statistic, df, normality_test, round(p, 8) AS p FROM ranked
""")
def group_compare_by_slice(t: Tables):
    out = compare.group_compare(_prices(t), "status", ("F", "P"), ["o_totalprice"], by=["o_orderpriority"])
    return rounded(rounded(out, 6, "statistic"), 8, "p")


@query("table_one_with_p", f"""
WITH {CATEGORY_SQL}, {_rank_sum_sql("'all'")}
SELECT 'o_totalprice' AS variable, NULL::VARCHAR AS level, g AS stratum, count(*) AS n, NULL::DOUBLE AS pct,
  round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, 'mann-whitney' AS test,
  (SELECT round(statistic, 6) FROM ranked) AS statistic, (SELECT round(p, 8) FROM ranked) AS p
FROM prices GROUP BY g
UNION ALL
SELECT v, l, g, o, round(100.0 * o / sum(o) OVER (PARTITION BY g), 4), NULL, NULL, 'chi-squared',
  (SELECT round(statistic, 6) FROM categories WHERE variable = v), (SELECT round(p, 8) FROM categories WHERE variable = v)
FROM c WHERE v = 'o_orderpriority'
""")
def table_one_with_p(t: Tables):
    out = compare.table_one_with_p(_prices(t), "status", ("F", "P"), ["o_totalprice"], ["o_orderpriority"])
    return rounded(rounded(rounded(out, 4, "pct", "mean", "sd"), 6, "statistic"), 8, "p")
