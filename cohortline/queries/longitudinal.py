"""Episodes, stays, interval joins, exposure and per-entity features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import timing
from cohortline.operators import episodes, exposure, features, joins
from cohortline.queries.registry import Tables, query, rounded, stamp

RUNS_SQL = """
ordered AS (
  SELECT user_id, event_type, ts,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS prev
  FROM events),
numbered AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> event_type THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS run
  FROM ordered),
runs AS (
  SELECT user_id, run, min(event_type) AS event_type, min(ts) AS first_ts, max(ts) AS last_ts
  FROM numbered GROUP BY user_id, run),
paired AS (
  SELECT *, lead(last_ts) OVER (PARTITION BY user_id ORDER BY run) AS stop FROM runs)
"""


def _last_seen(t: Tables):
    return t.events.groupBy("user_id").agg(timing.plus_days(F.max("ts"), 1).alias("end_datetime"))


@query("run_episodes", f"""
WITH {RUNS_SQL},
ends AS (SELECT user_id, max(ts) + INTERVAL 1 DAY AS end_datetime FROM events GROUP BY user_id)
SELECT p.user_id, first_ts AS start_datetime, stop AS stop_datetime,
       round(date_diff('microsecond', first_ts, coalesce(stop, end_datetime)) / 3.6e9, 6) AS duration_hours
FROM paired p LEFT JOIN ends e ON p.user_id = e.user_id WHERE event_type = 'click'
""")
def run_episodes(t: Tables):
    out = episodes.run_episodes(t.events, "user_id", "event_type", "ts", "click", _last_seen(t))
    return rounded(out, 6, "duration_hours")


@query("episode_min_duration", f"""
WITH {RUNS_SQL}
SELECT DISTINCT user_id FROM paired
WHERE event_type = 'click'
  AND date_diff('microsecond', first_ts, coalesce(stop, TIMESTAMP '2024-01-31')) / 3.6e9 >= 24
""")
def episode_min_duration(t: Tables):
    found = episodes.run_episodes(t.events, "user_id", "event_type", "ts", "click", stamp("2024-01-31"))
    return episodes.keys_with_long_episode(found, "user_id", 24)


@query("episodes_to_first_stop", f"""
WITH {RUNS_SQL},
starts AS (SELECT *, lead(first_ts) OVER (PARTITION BY user_id ORDER BY run) AS stop_first FROM runs)
SELECT user_id, first_ts AS start_datetime, stop_first AS stop_datetime,
       round(date_diff('microsecond', first_ts, stop_first) / 3.6e9, 6) AS duration_hours
FROM starts WHERE event_type = 'view'
""")
def episodes_to_first_stop(t: Tables):
    out = episodes.run_episodes(t.events, "user_id", "event_type", "ts", "view", stop_at="first")
    return rounded(out, 6, "duration_hours")


@query("episode_total_duration", f"""
WITH {RUNS_SQL}
SELECT user_id,
       CASE WHEN count(stop) = count(*)
            THEN round(sum(date_diff('microsecond', first_ts, stop) / 3.6e9), 5) END AS total_hours
FROM paired WHERE event_type = 'error' GROUP BY user_id
""")
def episode_total_duration(t: Tables):
    found = episodes.run_episodes(t.events, "user_id", "event_type", "ts", "error")
    return rounded(episodes.total_duration(found, "user_id", "total_hours"), 5, "total_hours")


STAYS_SQL = """
ordered AS (
  SELECT o_custkey, o_orderstatus, o_orderdate, o_orderkey, o_orderdate + INTERVAL 1 DAY AS depart,
         lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
  FROM orders),
numbered AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> o_orderstatus THEN 1 ELSE 0 END)
         OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run
  FROM ordered),
stays AS (
  SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, min(o_orderdate) AS arrive_datetime,
         max(depart) AS depart_datetime
  FROM numbered GROUP BY o_custkey, run)
"""


def _stays(t: Tables):
    rows = t.orders.withColumn("depart", timing.plus_days("o_orderdate", 1))
    # Order dates span years, so slots of a month keep the two levels in balance.
    return episodes.unit_stays(
        rows, "o_custkey", "o_orderstatus", "o_orderdate", "depart", tie=["o_orderkey"], slot_hours=24 * 30
    )


@query("stay_builder", f"""
WITH {STAYS_SQL}
SELECT *, round(date_diff('microsecond', arrive_datetime, depart_datetime) / 8.64e10, 6) AS length_days FROM stays
""")
def stay_builder(t: Tables):
    return rounded(_stays(t), 6, "length_days")


@query("repeat_stays", f"""
WITH {STAYS_SQL}
SELECT o_custkey, count(*) AS n_stays FROM stays WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1
""")
def repeat_stays(t: Tables):
    return episodes.keys_with_repeat_stays(_stays(t), "o_custkey", "o_orderstatus", "P")


@query("prior_event_exclusion", """
SELECT DISTINCT a.o_custkey FROM orders a
JOIN (SELECT o_custkey, min(o_orderdate) AS first_p FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) b
  ON a.o_custkey = b.o_custkey
WHERE a.o_orderstatus = 'F' AND a.o_orderdate < b.first_p
""")
def prior_event_exclusion(t: Tables):
    first_p = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("o_orderdate"))
    rows = joins.union_all(
        t.orders.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.lit(False).alias("is_ref")),
        first_p.withColumn("is_ref", F.lit(True)),
    )
    return joins.keys_before_reference(rows, "o_custkey", "o_orderdate", ~F.col("is_ref"), F.col("is_ref"))


@query("outside_interval", f"""
WITH {RUNS_SQL},
spans AS (
  SELECT user_id, min(ts) AS arrive, max(ts) AS depart FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT DISTINCT p.user_id FROM paired p JOIN spans s ON p.user_id = s.user_id
WHERE p.event_type = 'click' AND (p.stop < s.arrive OR p.first_ts > s.depart)
""")
def outside_interval(t: Tables):
    found = episodes.run_episodes(t.events, "user_id", "event_type", "ts", "click")
    spans = (
        t.events.filter("event_type = 'signup'")
        .groupBy("user_id")
        .agg(F.min("ts").alias("arrive"), F.max("ts").alias("depart"))
    )
    return joins.keys_outside_span(
        found, spans, "user_id", "start_datetime", "stop_datetime", "arrive", "depart"
    )


def _first_signup_day(t: Tables):
    first = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("arrival"))
    return first.withColumn("until", timing.plus_days("arrival", 1))


@query("interval_join_24h", """
SELECT e.user_id, e.event_id, e.ts, e.event_type, e.value, s.arrival
FROM events e JOIN (
  SELECT user_id, min(ts) AS arrival FROM events WHERE event_type = 'signup' GROUP BY user_id) s
  ON e.user_id = s.user_id AND e.ts BETWEEN s.arrival AND s.arrival + INTERVAL 1 DAY
""")
def interval_join_24h(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts", "event_type", "value")
    return joins.within_span(rows, _first_signup_day(t), "user_id", "ts", "arrival", "until").drop("until")


# Spans of five minutes, three hours, four and forty days, and without an end.
SPAN_END = """CASE event_id % 5 WHEN 0 THEN ts + INTERVAL 5 MINUTE WHEN 1 THEN ts + INTERVAL 3 HOUR WHEN 2 THEN ts + INTERVAL 4 DAY
  WHEN 3 THEN ts + INTERVAL 40 DAY ELSE TIMESTAMP '9999-12-31 23:59:59' END"""


@query("interval_spans", f"""
WITH spans AS (SELECT user_id, event_id AS span_id, ts AS begin, {SPAN_END} AS finish FROM events WHERE event_type = 'signup')
SELECT s.user_id, span_id, count(*) AS n, round(sum(e.value), 4) AS total, max(e.ts) AS last_ts
FROM spans s JOIN events e ON e.user_id = s.user_id AND e.ts BETWEEN begin AND finish GROUP BY ALL
""")
def interval_spans(t: Tables):
    """Events inside spans from minutes to centuries, none of which is more than two rows in the join."""
    end = F.expr(SPAN_END.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    spans = t.events.filter("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("begin"), end.cast("timestamp_ntz").alias("finish")
    )
    found = joins.within_span(t.events.select("user_id", "ts", "value"), spans, "user_id", "ts", "begin", "finish")
    out = found.groupBy("user_id", "span_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last_ts"))
    return rounded(out, 4, "total")


@query("worst_values_wide", """
WITH w AS (
  SELECT e.user_id, e.event_type, e.value FROM events e JOIN (
    SELECT user_id, min(ts) AS arrival FROM events WHERE event_type = 'signup' GROUP BY user_id) s
    ON e.user_id = s.user_id AND e.ts BETWEEN s.arrival AND s.arrival + INTERVAL 1 DAY)
SELECT user_id,
  min(value) FILTER (event_type = 'click') AS clk_min, max(value) FILTER (event_type = 'click') AS clk_max,
  min(value) FILTER (event_type = 'error') AS err_min, max(value) FILTER (event_type = 'error') AS err_max,
  min(value) FILTER (event_type = 'purchase') AS buy_min, max(value) FILTER (event_type = 'purchase') AS buy_max,
  min(value) FILTER (event_type = 'refund') AS refund_min, max(value) FILTER (event_type = 'refund') AS refund_max
FROM w WHERE event_type IN ('click', 'error', 'purchase', 'refund') AND value IS NOT NULL GROUP BY user_id
""")
def worst_values_wide(t: Tables):
    rows = t.events.select("user_id", "ts", "event_type", "value")
    day = joins.within_span(rows, _first_signup_day(t), "user_id", "ts", "arrival", "until")
    names = {"click": "clk", "error": "err", "purchase": "buy", "refund": "refund"}
    return features.worst_values(day, "user_id", "event_type", "value", names)


@query("worst_values_long", """
SELECT user_id, event_type, min(value) AS min_value, max(value) AS max_value
FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type
""")
def worst_values_long(t: Tables):
    return features.worst_values_long(t.events, "user_id", "event_type", "value")


EXPOSURE_SQL = """
samples AS (
  SELECT user_id, event_type AS med, ts AS t, event_id,
         CASE WHEN value < 20 THEN 0 ELSE value END AS rate,
         CASE WHEN value BETWEEN 40 AND 50 THEN NULL ELSE 'mg/hr' END AS unit
  FROM events),
marked AS (SELECT *, max(t) OVER (PARTITION BY user_id, med) AS last_t FROM samples),
kept AS (SELECT * FROM marked WHERE t = last_t OR unit IS NOT NULL),
timed AS (
  SELECT *, date_diff('microsecond', t, lead(t) OVER (PARTITION BY user_id, med ORDER BY t, event_id)) / 3.6e9 AS dur
  FROM kept),
active AS (
  SELECT user_id, med, sum(dur) AS cont_duration FROM timed WHERE rate > 0 GROUP BY user_id, med HAVING sum(dur) > 0),
points AS (SELECT user_id, med, t, avg(rate) AS r FROM kept WHERE rate IS NOT NULL GROUP BY user_id, med, t),
steps AS (
  SELECT user_id, med, t, r, lag(t) OVER w AS pt, lag(r) OVER w AS pr
  FROM points WINDOW w AS (PARTITION BY user_id, med ORDER BY t)),
area AS (
  SELECT user_id, med, sum(0.5 * (r + pr) * date_diff('microsecond', pt, t) / 3.6e9) AS dose_auc
  FROM steps GROUP BY user_id, med HAVING sum(0.5 * (r + pr) * date_diff('microsecond', pt, t) / 3.6e9) > 0)
"""


def _samples(t: Tables):
    return t.events.select(
        "user_id",
        F.col("event_type").alias("med"),
        "ts",
        "event_id",
        F.when(F.col("value") < 20, F.lit(0.0)).otherwise(F.col("value")).alias("rate"),
        F.when(~F.col("value").between(40, 50), F.lit("mg/hr")).alias("unit"),
    )


def _exposure(t: Tables):
    return exposure.rate_exposure(_samples(t), ["user_id", "med"], "ts", "rate", "unit", "event_id")


@query("infusion_exposure", f"""
WITH {EXPOSURE_SQL}
SELECT user_id, med, round(dose_auc, 5) AS dose_auc, round(cont_duration, 5) AS cont_duration,
       round(dose_auc / cont_duration, 5) AS time_wt_avg_rate
FROM area JOIN active USING (user_id, med)
""")
def infusion_exposure(t: Tables):
    return rounded(_exposure(t), 5, "dose_auc", "cont_duration", "time_wt_avg_rate")


@query("bolus_vs_continuous", f"""
WITH {EXPOSURE_SQL},
cont AS (
  SELECT user_id, med, dose_auc AS total_cont_dose FROM area JOIN active USING (user_id, med)
  WHERE med IN ('click', 'view')),
bolus AS (
  SELECT user_id, event_type AS med,
         CASE WHEN count(nullif(value, 50.0)) = count(*) THEN sum(value) END AS total_bolus_dose
  FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id, event_type)
SELECT coalesce(c.user_id, b.user_id) AS user_id, coalesce(c.med, b.med) AS med,
       round(total_cont_dose, 4) AS total_cont_dose, round(total_bolus_dose, 4) AS total_bolus_dose,
       round(coalesce(total_cont_dose, 0) + coalesce(total_bolus_dose, 0), 4) AS total_dose
FROM cont c FULL JOIN bolus b ON c.user_id = b.user_id AND c.med = b.med
""")
def bolus_vs_continuous(t: Tables):
    keys = ["user_id", "med"]
    cont = _exposure(t).filter(F.col("med").isin("click", "view")).select(
        *keys, F.col("dose_auc").alias("total_cont_dose")
    )
    doses = t.events.filter(F.col("event_type").isin("view", "error")).select(
        "user_id", F.col("event_type").alias("med"), F.nullif("value", F.lit(50.0)).alias("dose")
    )
    out = exposure.combine_doses(cont, exposure.bolus_totals(doses, keys, "dose"), keys)
    return rounded(out, 4, "total_cont_dose", "total_bolus_dose", "total_dose")


@query("unit_normalize", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type, rate_unit, l_quantity AS recorded,
  round(CASE WHEN p_type = 'PROMO' AND rate_unit = 'F' THEN l_quantity * 1000.0
             WHEN p_type = 'LARGE' AND rate_unit = 'F' THEN l_quantity / p_size
             WHEN p_type = 'SMALL' AND rate_unit = 'O' THEN l_quantity * 60.0
             ELSE l_quantity END, 6) AS standard,
  round(CASE WHEN p_type = 'PROMO' THEN l_quantity * p_size * 60 / 1000
             WHEN p_type = 'LARGE' THEN l_quantity * p_size
             ELSE l_quantity END, 6) AS total
FROM (SELECT *, l_linestatus AS rate_unit FROM lineitem) l JOIN part ON l_partkey = p_partkey
""")
def unit_normalize(t: Tables):
    conversions = [("promo", "F", 1000.0, 0), ("large", "F", 1.0, -1), ("small", "O", 60.0, 0)]
    scales = [("promo", 60.0 / 1000.0, 1), ("large", 1.0, 1)]
    rows = t.lineitem.join(t.part.select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    standard = exposure.convert_rate("p_type", "l_linestatus", "l_quantity", "p_size", conversions)
    total = exposure.total_dose("p_type", "l_quantity", "p_size", scales)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_type",
        F.col("l_linestatus").alias("rate_unit"),
        F.col("l_quantity").alias("recorded"),
        F.round(standard, 6).alias("standard"),
        F.round(total, 6).alias("total"),
    )


@query("not_also_bolus", """
SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 4) AS quantity
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
GROUP BY l_orderkey
""")
def not_also_bolus(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("event_id"), "l_quantity")
    other = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id"))
    kept = exposure.not_also_bolus(lines, other, "event_id")
    return kept.groupBy(F.col("event_id").alias("l_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("quantity")
    )


@query("daily_rollup", """
WITH rows AS (
  SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type, value, nullif(value, 10.0) AS score
  FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, day,
  CASE WHEN count(*) FILTER (event_type = 'view') = count(score) FILTER (event_type = 'view')
       THEN min(score) FILTER (event_type = 'view') END AS min_score,
  CASE WHEN count(*) FILTER (event_type = 'view') = count(score) FILTER (event_type = 'view')
       THEN max(score) FILTER (event_type = 'view') END AS max_score,
  CASE WHEN count(*) FILTER (event_type = 'click') > 0
       THEN count(*) FILTER (event_type = 'click' AND value > 60) END AS num_positive
FROM rows GROUP BY user_id, day
""")
def daily_rollup(t: Tables):
    return features.daily_rollup(
        t.events, "user_id", "ts",
        is_score=F.col("event_type") == "view", score=F.nullif("value", F.lit(10.0)),
        is_screen=F.col("event_type") == "click", positive=F.col("value") > 60,
    )


@query("any_positive", """
SELECT user_id, coalesce(bool_or(event_type = 'click' AND value > 150), false) AS ever_positive
FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id
""")
def any_positive(t: Tables):
    daily = features.daily_rollup(
        t.events, "user_id", "ts",
        is_score=F.col("event_type") == "view", score=F.col("value"),
        is_screen=F.col("event_type") == "click", positive=F.col("value") > 150,
    )
    return features.any_positive(daily, "user_id", "num_positive", "ever_positive")


@query("first_measure", """
SELECT c.user_id, c.value AS first_click, v.value AS first_view
FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events WHERE event_type = 'click') c
JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.rn = 1 AND v.rn = 1
""")
def first_measure(t: Tables):
    return features.first_measures(
        t.events, "user_id", "value", ["ts", "event_id"],
        {"first_click": F.col("event_type") == "click", "first_view": F.col("event_type") == "view"},
    )


@query("threshold_flags", """
SELECT c_custkey, coalesce(bool_or(event_type = 'view' AND value > 200), false) AS "view",
       coalesce(bool_or(event_type = 'click' AND value > 250), false) AS click
FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey
""")
def threshold_flags(t: Tables):
    rows = t.events.withColumnRenamed("user_id", "c_custkey")
    limits = {"view": 200.0, "click": 250.0}
    return features.threshold_flags(rows, t.customer, "c_custkey", "event_type", "value", limits)
