"""Funnels, key-set joins, code sets, classes, indicator matrices, groups and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.operators import codes, episodes, features, funnel, joins, ranks
from cohortline.queries.longitudinal import RUNS_SQL
from cohortline.queries.registry import Tables, query, rounded, stamp

CRITERIA_SQL = """
base AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0),
urgent AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
big AS (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 450000 GROUP BY 1 HAVING count(*) > 1),
faulty AS (SELECT DISTINCT user_id AS c_custkey FROM events WHERE event_type = 'error' AND value > 200),
abroad AS (
  SELECT DISTINCT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%A'),
status AS (
  SELECT c_custkey, c_nationkey, c_acctbal,
    CASE WHEN c_custkey NOT IN (SELECT c_custkey FROM urgent) THEN 1
         WHEN c_custkey IN (SELECT c_custkey FROM big) THEN 2
         WHEN c_custkey IN (SELECT c_custkey FROM faulty) THEN 3
         WHEN c_custkey IN (SELECT c_custkey FROM abroad) THEN 4 END AS failed_step
  FROM base)
"""


def _funnel(t: Tables) -> funnel.Funnel:
    base = t.customer.filter("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    regions = t.region.filter(F.col("r_name").like("%A")).select(F.col("r_regionkey").alias("n_regionkey"))
    nations = joins.keep_in(t.nation, regions, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"))
    criteria = [
        funnel.Criterion("has an urgent order", orders.filter("o_orderpriority = '1-URGENT'"), include=True),
        funnel.Criterion(
            "several big orders",
            orders.filter("o_totalprice > 450000").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        ),
        funnel.Criterion(
            "large error",
            t.events.filter("event_type = 'error' AND value > 200").select(F.col("user_id").alias("c_custkey")),
        ),
        funnel.Criterion("region", joins.keep_in(t.customer, nations, "c_nationkey")),
    ]
    return funnel.cohort_funnel(base, criteria, "c_custkey")


@query("cohort_funnel", f"WITH {CRITERIA_SQL} SELECT c_custkey, c_nationkey, c_acctbal FROM status WHERE failed_step IS NULL")
def cohort_funnel(t: Tables):
    return _funnel(t).cohort()


@query("funnel_status", f"WITH {CRITERIA_SQL} SELECT c_custkey, failed_step FROM status")
def funnel_status(t: Tables):
    return _funnel(t).status


@query("funnel_attrition", f"""
WITH {CRITERIA_SQL},
steps(step_no, reason) AS (
  VALUES (1, 'has an urgent order'), (2, 'several big orders'), (3, 'large error'), (4, 'region'))
SELECT step_no, reason,
  (SELECT count(*) FROM status WHERE failed_step = step_no) AS removed,
  (SELECT count(*) FROM status WHERE failed_step IS NULL OR failed_step > step_no) AS remaining
FROM steps
""")
def funnel_attrition(t: Tables):
    return _funnel(t).attrition()


@query("first_row_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1
""")
def first_row_per_key(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    return joins.first_row(rows, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("semi_join_cohort", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)
""")
def semi_join_cohort(t: Tables):
    buyers = t.events.filter("event_type = 'purchase' AND value > 100").select(F.col("user_id").alias("o_custkey"))
    return joins.keep_in(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), buyers, "o_custkey")


@query("anti_join_cohort", """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error' AND value > 50)
""")
def anti_join_cohort(t: Tables):
    failed = t.events.filter("event_type = 'error' AND value > 50").select(F.col("user_id").alias("c_custkey"))
    return joins.drop_in(t.customer.select("c_custkey", "c_name"), failed, "c_custkey")


@query("left_join_groups", """
SELECT c_custkey, c_acctbal, n_events FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id) ON c_custkey = user_id
""")
def left_join_groups(t: Tables):
    counts = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    return t.customer.select("c_custkey", "c_acctbal").join(counts, "c_custkey", "left")


@query("supplement_merge", """
WITH a AS (SELECT user_id, ts, event_type, value, 'primary' AS origin FROM events WHERE value > 20),
     b AS (SELECT user_id, ts, event_type, value, props FROM events WHERE value < 60 AND event_type <> 'view')
SELECT user_id, ts, event_type, value, origin, NULL::VARCHAR AS props FROM a
UNION ALL
SELECT user_id, ts, event_type, value, NULL, props FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.ts = b.ts AND a.event_type = b.event_type)
""")
def supplement_merge(t: Tables):
    primary = t.events.filter("value > 20").select("user_id", "ts", "event_type", "value", F.lit("primary").alias("origin"))
    secondary = t.events.filter("value < 60 AND event_type <> 'view'").select(
        "user_id", "ts", "event_type", "value", "props"
    )
    return joins.add_missing(primary, secondary, ["user_id", "ts", "event_type"])


@query("null_key_joins", """
WITH l AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS level FROM orders),
     r AS (SELECT DISTINCT nullif(o_orderpriority, '5-LOW') AS level FROM orders WHERE o_orderpriority > '3')
SELECT 'anti' AS kind, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.level = l.level)
UNION ALL
SELECT 'anti null-safe', count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.level IS NOT DISTINCT FROM l.level)
UNION ALL
SELECT 'semi', count(*) FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.level = l.level)
UNION ALL
SELECT 'semi null-safe', count(*) FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.level IS NOT DISTINCT FROM l.level)
""")
def null_key_joins(t: Tables):
    level = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("level")
    left = t.orders.select("o_orderkey", level)
    right = t.orders.filter("o_orderpriority > '3'").select(level)

    def counted(df, kind):
        return df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))

    return joins.union_all(
        counted(joins.drop_in(left, right, "level"), "anti"),
        counted(joins.drop_in(left, right, "level", null_safe=True), "anti null-safe"),
        counted(joins.keep_in(left, right, "level"), "semi"),
        counted(joins.keep_in(left, right, "level", null_safe=True), "semi null-safe"),
    )


# Brands stand for codes and types for the categories that group them.
CODE_SPEC = (
    ("ckd", "ICD9", "Brand#7"),
    ("ckd", "ICD9", "Brand#13"),
    ("liver", "CCS", "PROMO"),
    ("seizure", "ICD9", "Brand#22"),
    ("seizure", "CCS", "NO SUCH TYPE"),
)
CODES_SQL = """
spec(disease_state, type, code) AS (
  VALUES ('ckd', 'ICD9', 'Brand#7'), ('ckd', 'ICD9', 'Brand#13'), ('liver', 'CCS', 'PROMO'),
         ('seizure', 'ICD9', 'Brand#22'), ('seizure', 'CCS', 'NO SUCH TYPE')),
crosswalk AS (SELECT DISTINCT p_type AS ccs, p_name AS icd9_code FROM part),
codes AS (
  SELECT disease_state, code AS icd9_code FROM spec WHERE type = 'ICD9'
  UNION SELECT disease_state, icd9_code FROM spec JOIN crosswalk ON code = ccs WHERE type = 'CCS'),
diagnoses AS (
  SELECT l_suppkey, p_brand AS diag_code, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT l_suppkey, p_name, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey),
states AS (
  SELECT DISTINCT l_suppkey, disease_state FROM diagnoses JOIN codes ON diag_code = icd9_code
  WHERE l_returnflag = 'R')
"""


def _code_states(t: Tables):
    spec = codes.lookup_frame(t.spark, CODE_SPEC, ("disease_state", "type", "code"))
    crosswalk = t.part.select(F.col("p_type").alias("ccs"), F.col("p_name").alias("icd9_code")).distinct()
    lines = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag")
    coded = lines.join(t.part.select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    diagnoses = coded.unpivot(["l_suppkey", "l_returnflag"], ["p_brand", "p_name"], "system", "diag_code")
    return codes.code_states(
        diagnoses, codes.expand_codes(spec, crosswalk), "l_suppkey", "diag_code", ("l_returnflag", "R")
    )


@query("code_set_flags", f"WITH {CODES_SQL} SELECT l_suppkey, disease_state FROM states")
def code_set_flags(t: Tables):
    return _code_states(t)


@query("code_set_matrix", f"""
WITH {CODES_SQL}
SELECT s_suppkey AS l_suppkey, coalesce(bool_or(disease_state = 'asthma'), false) AS asthma,
       coalesce(bool_or(disease_state = 'ckd'), false) AS ckd,
       coalesce(bool_or(disease_state = 'liver'), false) AS liver,
       coalesce(bool_or(disease_state = 'seizure'), false) AS seizure
FROM supplier LEFT JOIN states ON s_suppkey = l_suppkey GROUP BY s_suppkey
""")
def code_set_matrix(t: Tables):
    cohort = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"))
    return features.indicator_matrix(
        _code_states(t), cohort, "l_suppkey", "disease_state", ["asthma", "ckd", "liver", "seizure"]
    )


@query("priority_class", """
WITH membership AS (SELECT DISTINCT p_type AS med_class, p_brand || ' ' || p_name AS med_name FROM part),
first_tier AS (SELECT * FROM membership WHERE med_class IN ('PROMO', 'SMALL')),
second_tier AS (
  SELECT * FROM membership WHERE med_class = 'LARGE' AND med_name NOT IN (SELECT med_name FROM first_tier))
SELECT DISTINCT med_class, lower(med_name) AS med_name FROM first_tier
UNION SELECT DISTINCT med_class, lower(med_name) FROM second_tier
""")
def priority_class(t: Tables):
    membership = t.part.select(F.col("p_type").alias("med_class"), F.concat_ws(" ", "p_brand", "p_name").alias("med_name"))
    return codes.class_members(membership, {"PROMO": 0, "SMALL": 0, "LARGE": 1})


@query("class_matrix", """
WITH membership AS (SELECT DISTINCT p_type AS med_class, p_brand || ' ' || p_name AS med_name FROM part),
first_tier AS (SELECT * FROM membership WHERE med_class IN ('PROMO', 'SMALL')),
members AS (
  SELECT DISTINCT med_class, lower(med_name) AS med_name FROM first_tier
  UNION SELECT DISTINCT med_class, lower(med_name) FROM membership
  WHERE med_class = 'LARGE' AND med_name NOT IN (SELECT med_name FROM first_tier)),
taken AS (
  SELECT DISTINCT l_orderkey, med_class FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN members ON lower(p_brand || ' ' || p_name) = med_name)
SELECT o_orderkey AS l_orderkey, coalesce(bool_or(med_class = 'PROMO'), false) AS promo,
       coalesce(bool_or(med_class = 'SMALL'), false) AS small, coalesce(bool_or(med_class = 'LARGE'), false) AS "large"
FROM orders LEFT JOIN taken ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def class_matrix(t: Tables):
    parts = t.part.select("p_partkey", F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("home_med"))
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    taken = codes.class_rows(rows, priority_class(t), "l_orderkey", "home_med")
    cohort = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return features.indicator_matrix(taken, cohort, "l_orderkey", "med_class", ["PROMO", "SMALL", "LARGE"])


@query("indicator_matrix", """
SELECT c_custkey,
  coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS urgent,
  coalesce(bool_or(o_orderpriority = '2-HIGH'), false) AS high,
  coalesce(bool_or(o_orderpriority = '5-LOW'), false) AS low,
  coalesce(bool_or(o_orderpriority = '6-NEVER'), false) AS never
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
WHERE c_acctbal > 0 GROUP BY c_custkey
""")
def indicator_matrix(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    levels = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low", "6-NEVER": "never"}
    return features.indicator_matrix(
        rows, t.customer.filter("c_acctbal > 0"), "c_custkey", "o_orderpriority", levels
    )


@query("exposure_group", f"""
WITH {RUNS_SQL},
hit AS (
  SELECT DISTINCT user_id FROM paired WHERE event_type = 'error'
    AND date_diff('microsecond', first_ts, coalesce(stop, TIMESTAMP '2024-01-31')) / 3.6e9 >= 48)
SELECT c_custkey AS user_id, h.user_id IS NOT NULL AS exposed,
       CASE WHEN h.user_id IS NOT NULL THEN 'BZD' ELSE 'No BZD' END AS "group"
FROM customer LEFT JOIN hit h ON c_custkey = h.user_id
""")
def exposure_group(t: Tables):
    found = episodes.run_episodes(t.events, "user_id", "event_type", "ts", "error", stamp("2024-01-31"))
    cohort = t.customer.select(F.col("c_custkey").alias("user_id"))
    return funnel.exposure_group(cohort, found, "user_id", F.col("duration_hours") >= 48, ("BZD", "No BZD"))


@query("id_batches", """
SELECT floor((rn - 1) / 750)::BIGINT AS batch, count(*) AS n_ids, string_agg(c_custkey::VARCHAR, ';' ORDER BY c_custkey) AS ids
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) GROUP BY 1
""")
def id_batches(t: Tables):
    return ranks.id_batches(t.customer, "c_custkey")


@query("row_numbers", """
SELECT user_id, row_number() OVER (ORDER BY user_id) AS row_no FROM (SELECT DISTINCT user_id FROM events)
""")
def row_numbers(t: Tables):
    return ranks.row_numbers(t.events, "user_id")


@query("tie_ranks", """
SELECT event_type, value, count(*) AS ties, min(r) AS rank,
       round(avg(r) + (count(*) - 1) / 2.0, 4) AS mid_rank, min(total) AS total
FROM (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) AS r,
             count(*) OVER (PARTITION BY event_type) AS total FROM events WHERE value IS NOT NULL)
GROUP BY event_type, value
""")
def tie_ranks(t: Tables):
    out = ranks.tie_ranks(t.events, ["event_type"], "value")
    return rounded(
        out.select(
            "event_type", "value", "ties", (F.col("below") + 1).alias("rank"),
            (F.col("below") + (F.col("ties") + 1) / 2).alias("mid_rank"), "total",
        ),
        4, "mid_rank",
    )
