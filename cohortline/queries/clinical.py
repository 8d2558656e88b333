"""The whole study run on clinical extracts that are derived from the given tables.

Customers are encounters, orders give locations, diagnoses and home medications, events
give ventilation, drugs, labs and vitals. ``EXTRACTS_SQL`` states the same derivation for
the oracle, which then follows the study step by step with plain joins and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators import codes, joins
from cohortline.plans import fixed_values as fv
from cohortline.plans import study, study_files
from cohortline.queries.registry import Tables, query, rounded
from cohortline.queries.statistics import chi_squared_sql, chosen_tests_sql
from cohortline.session import new_folder
from cohortline.sources.extracts import read_text_csv

CROSSWALK = (
    ("177", "630.1"), ("6", "070.1"), ("6", "070.2"), ("98", "401.9"), ("49", "250.0"), ("157", "584.9"), ("127", "491.2"),
    ("653", "290.0"), ("108", "428.0"), ("128", "493.9"), ("83", "345.9"),
)
CLASS_MEMBERS = (
    ("antidepressants", "Sertraline"),
    ("antipsychotics", "Haloperidol"),
    ("gamma-aminobutyric acid analogs", "Gabapentin"),
    ("benzodiazepines", "Lorazepam"),
    ("benzodiazepines", "Clonazepam"),
    ("anticonvulsants", "Clonazepam"),
    ("anticonvulsants", "Phenytoin"),
    ("narcotic analgesic combinations", "Oxycodone"),
)


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


VENT = f"CASE WHEN value > 20 THEN '{fv.VENT_START}' ELSE '{fv.VENT_STOP}' END"
PLACE = (
    f"CASE WHEN o_orderstatus = 'F' AND o_totalprice > 250000 THEN '{fv.STUDY_UNIT}' "
    f"WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN '{fv.OTHER_UNITS[2]}' ELSE 'Ward' END"
)
# Diagnosis codes and home medications by the order's number.
CODES = ("585.1", "070.2", "401.9", "250.0", "999", "584.9", "491.2", "290.0", "428.0", "493.9", "345.9")
HOME_MEDS = ("LORAZEPAM", "Clonazepam", "Phenytoin", "Oxycodone", "Aspirin", "Sertraline", "haloperidol", "Gabapentin")
DIAGNOSIS = (
    "CASE WHEN o_totalprice > 497000 THEN '427.5' WHEN o_totalprice > 494000 THEN '630.1' ELSE "
    + _case(f"CAST(o_orderkey % {len(CODES)} AS VARCHAR(9))", {str(i): code for i, code in enumerate(CODES)})
    + " END"
)
HOME = _case(f"CAST(o_orderkey % {len(HOME_MEDS)} AS VARCHAR(9))", {str(i): med for i, med in enumerate(HOME_MEDS)})
LAB = _case(
    "event_type",
    {"view": fv.SEDATION_SCORE, "click": fv.DELIRIUM_SCREEN, "error": "AST", "purchase": "ALT", "signup": "Sodium Lvl"},
)
LAB_RESULT = (
    "CASE WHEN event_type = 'view' AND value BETWEEN 40 AND 45 THEN 'x' "
    "WHEN event_type = 'view' THEN CAST(CAST(floor(value / 20) AS INT) - 2 AS VARCHAR(9)) "
    "WHEN event_type = 'click' AND value > 100 THEN 'Positive' "
    "WHEN event_type = 'click' AND value < 15 THEN 'Unable to assess' "
    "WHEN event_type = 'click' THEN 'Negative' ELSE CAST(value AS VARCHAR(30)) END"
)
# A second laboratory row per event, by its number.
CHEMISTRY_NAMES = ("Creatinine Lvl", "Glasgow Coma Score", "PaO2", "POC A PH", "POC A PCO2", "Potassium Lvl", "WBC", "Hct", "FIO2 (%)")
CHEMISTRY = _case(f"CAST(event_id % {len(CHEMISTRY_NAMES)} AS VARCHAR(9))", {str(i): name for i, name in enumerate(CHEMISTRY_NAMES)})
GAS = _case("event_type", {"purchase": "Poc A PO2", "signup": "sodium lvl"})
VITAL = _case(
    "event_type",
    {
        "view": "Temperature Oral", "click": "Mean Arterial Pressure (Cuff)", "error": "Apical Heart Rate",
        "purchase": "Respiratory Rate", "signup": "Temperature Axillary",
    },
)
CONT = _case("event_type", {"view": "Fentanyl", "click": "Propofol", "error": "Midazolam"})
CONT_UNIT = (
    "CASE WHEN value BETWEEN 40 AND 50 THEN NULL WHEN event_type = 'click' THEN 'microgram/kg/min' ELSE 'mg/hr' END"
)
BOLUS = _case("event_type", {"purchase": "Lorazepam", "signup": "Fentanyl", "error": "Midazolam"})
IS_BOLUS = "event_type IN ('purchase', 'signup') OR event_type = 'error' AND value > 120"
ANSWER = _case("c_mktsegment", {"BUILDING": " Yes", "FURNITURE": "no", "MACHINERY": "nk"})

EXTRACTS_SQL = f"""
ev AS (SELECT (user_id * 5 + event_id % 5)::VARCHAR AS pie_id, ts - INTERVAL 3652 DAY AS t, event_type, value, event_id::VARCHAR AS event_id
       FROM events),
pat AS (SELECT c_custkey::VARCHAR AS pie_id, c_acctbal / 50 AS age,
               TIMESTAMP '2014-02-10' + to_days(c_nationkey * 25) AS discharge, c_mktsegment, c_acctbal,
               (c_custkey + 100000)::VARCHAR AS fin FROM customer),
screened AS (SELECT * FROM pat WHERE discharge < TIMESTAMP '2015-09-01' AND age >= 18),
loc AS (
  SELECT o_custkey::VARCHAR AS pie_id, {PLACE} AS location,
         TIMESTAMP '2014-01-01' + to_minutes(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) AS arrive,
         TIMESTAMP '2014-01-01' + to_minutes(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)
           + CAST(floor(abs(o_totalprice - 250000) / 6) AS INT)) AS depart
  FROM orders),
vent AS (SELECT pie_id, {VENT} AS ev, t FROM ev WHERE event_type IN ('purchase', 'signup')),
vent_n AS (
  SELECT *, sum(CASE WHEN p IS NULL OR p <> ev THEN 1 ELSE 0 END) OVER (PARTITION BY pie_id ORDER BY t, ev ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(ev) OVER (PARTITION BY pie_id ORDER BY t, ev) AS p FROM vent)),
vent_p AS (
  SELECT *, lead(last_t) OVER (PARTITION BY pie_id ORDER BY run) AS stop
  FROM (SELECT pie_id, run, min(ev) AS ev, min(t) AS start, max(t) AS last_t FROM vent_n GROUP BY pie_id, run)),
episode AS (
  SELECT v.pie_id, start, stop, date_diff('microsecond', start, coalesce(stop, discharge)) / 3.6e9 AS hours
  FROM vent_p v LEFT JOIN screened s ON v.pie_id = s.pie_id WHERE ev = '{fv.VENT_START}'),
loc_n AS (
  SELECT *, sum(CASE WHEN p IS NULL OR p <> location THEN 1 ELSE 0 END) OVER (PARTITION BY pie_id ORDER BY arrive, location ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(location) OVER (PARTITION BY pie_id ORDER BY arrive, location) AS p FROM loc)),
stay AS (
  SELECT pie_id, min(location) AS location, min(arrive) AS arrive, max(depart) AS depart,
         date_diff('microsecond', min(arrive), max(depart)) / 8.64e10 AS days
  FROM loc_n GROUP BY pie_id, run),
unit AS (SELECT * FROM stay WHERE location = '{fv.STUDY_UNIT}'),
dx AS (SELECT o_custkey::VARCHAR AS pie_id, CASE WHEN o_orderstatus = 'O' THEN 'Admitting' ELSE 'Final' END AS diag_type,
              {DIAGNOSIS} AS code FROM orders),
x1 AS (SELECT pie_id FROM episode WHERE hours >= 24),
x2 AS (SELECT pie_id FROM ev WHERE event_type = 'view' AND value > 30),
x4 AS (SELECT pie_id FROM unit GROUP BY pie_id HAVING count(*) > 1),
x6 AS (SELECT s.pie_id FROM stay s JOIN unit u ON s.pie_id = u.pie_id AND s.arrive < u.arrive
       WHERE s.location = '{fv.OTHER_UNITS[2]}'),
x14 AS (SELECT e.pie_id FROM episode e JOIN unit u ON e.pie_id = u.pie_id WHERE e.stop < u.arrive OR e.start > u.depart),
status AS (
  SELECT pie_id, CASE
    WHEN pie_id NOT IN (SELECT pie_id FROM x1) THEN 1
    WHEN pie_id NOT IN (SELECT pie_id FROM x2) THEN 2
    WHEN pie_id NOT IN (SELECT pie_id FROM unit) THEN 3
    WHEN pie_id IN (SELECT pie_id FROM x4) THEN 4
    WHEN c_mktsegment = 'MACHINERY' THEN 5
    WHEN pie_id IN (SELECT pie_id FROM x6) THEN 6
    WHEN pie_id IN (SELECT pie_id FROM unit WHERE days < 1) THEN 7
    WHEN pie_id IN (SELECT pie_id FROM ev WHERE event_type = 'error' AND value > 220) THEN 8
    WHEN pie_id IN (SELECT pie_id FROM ev WHERE event_type = 'error' AND value > 200) THEN 9
    WHEN pie_id IN (SELECT pie_id FROM dx WHERE code IN ('427.5', '630.1')) THEN 10
    WHEN pie_id NOT IN (SELECT pie_id FROM dx) THEN 11
    WHEN pie_id IN (SELECT pie_id FROM ev WHERE event_type = 'view' AND value > 260) THEN 12
    WHEN pie_id IN (SELECT o_custkey::VARCHAR FROM orders WHERE o_totalprice BETWEEN 493000 AND 494000) THEN 13
    WHEN pie_id IN (SELECT pie_id FROM x14) THEN 14 END AS failed_step
  FROM screened),
cohort AS (SELECT pie_id FROM status WHERE failed_step IS NULL),
span AS (SELECT u.pie_id, arrive AS arrival, depart AS leave, days FROM unit u JOIN cohort USING (pie_id)),
weight AS (SELECT pie_id, 40 + value / 2 AS weight, row_number() OVER (PARTITION BY pie_id ORDER BY t) AS rn
           FROM ev WHERE event_type = 'click' AND value >= 5),
height AS (SELECT pie_id, 150 + value / 10 AS height, row_number() OVER (PARTITION BY pie_id ORDER BY t) AS rn
           FROM ev WHERE event_type = 'signup'),
lab AS (
  SELECT pie_id, t, {LAB} AS lab, {LAB_RESULT} AS result FROM ev
  UNION ALL SELECT pie_id, t, {CHEMISTRY.replace("event_id", "event_id::BIGINT")}, CAST(value / 8 AS VARCHAR(30)) FROM ev),
stay_lab AS (SELECT l.*, try_cast(result AS DOUBLE) AS num FROM lab l JOIN span s ON l.pie_id = s.pie_id AND t BETWEEN arrival AND leave),
measured AS (
  SELECT c.pie_id, p.age, p.c_mktsegment AS diagnosis, s.days AS unit_length_stay, e.vent_duration, w.weight, h.height,
    coalesce((SELECT bool_or(num > 75) FROM stay_lab l WHERE l.pie_id = c.pie_id AND lab = 'AST'), false) AS ast,
    coalesce((SELECT bool_or(num > 81) FROM stay_lab l WHERE l.pie_id = c.pie_id AND lab = 'ALT'), false) AS alt
  FROM cohort c JOIN pat p USING (pie_id) JOIN span s USING (pie_id)
  JOIN (SELECT pie_id, CASE WHEN count(hours) = count(*) THEN sum(hours) END AS vent_duration FROM episode GROUP BY pie_id) e USING (pie_id)
  JOIN weight w ON w.pie_id = c.pie_id AND w.rn = 1 JOIN height h ON h.pie_id = c.pie_id AND h.rn = 1),
daily AS (
  SELECT pie_id, date_trunc('day', t)::TIMESTAMP AS lab_date,
    CASE WHEN count(*) FILTER (lab = '{fv.SEDATION_SCORE}') = count(num) FILTER (lab = '{fv.SEDATION_SCORE}')
         THEN min(num) FILTER (lab = '{fv.SEDATION_SCORE}') END AS min_rass,
    CASE WHEN count(*) FILTER (lab = '{fv.SEDATION_SCORE}') = count(num) FILTER (lab = '{fv.SEDATION_SCORE}')
         THEN max(num) FILTER (lab = '{fv.SEDATION_SCORE}') END AS max_rass,
    CASE WHEN count(*) FILTER (lab = '{fv.DELIRIUM_SCREEN}') > 0 THEN count(*) FILTER (result = 'Positive') END AS num_cam_icu_pos
  FROM stay_lab WHERE lab = '{fv.SEDATION_SCORE}' OR lab = '{fv.DELIRIUM_SCREEN}' AND result <> 'Unable to assess'
  GROUP BY 1, 2),
bolus AS (SELECT pie_id, lower({BOLUS}) AS med, t, value AS dose, event_id FROM ev WHERE {IS_BOLUS}),
bolus_sum AS (
  SELECT b.pie_id, med, sum(dose) AS total_bolus_dose FROM bolus b JOIN span s ON b.pie_id = s.pie_id AND t BETWEEN arrival AND leave
  GROUP BY 1, 2),
cont AS (
  SELECT e.pie_id, med, t, event_id, unit, weight, CASE WHEN med = 'fentanyl' AND unit = 'mg/hr' THEN rate * 1000 ELSE rate END AS rate
  FROM (SELECT pie_id, t, event_id, lower({CONT}) AS med, {CONT_UNIT} AS unit, CASE WHEN value < 20 THEN 0 ELSE value END AS rate
        FROM ev WHERE event_type IN ('view', 'click', 'error')) e
  JOIN span s ON e.pie_id = s.pie_id AND t BETWEEN arrival AND leave JOIN measured m ON m.pie_id = e.pie_id
  WHERE event_id NOT IN (SELECT event_id FROM bolus)),
kept AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY pie_id, med) AS last_t FROM cont) WHERE t = last_t OR unit IS NOT NULL),
steps AS (
  SELECT *, lag(t) OVER w AS pt, lag(rate) OVER w AS pr FROM kept WINDOW w AS (PARTITION BY pie_id, med ORDER BY t)),
area AS (
  SELECT pie_id, med, max(weight) AS weight, sum(0.5 * (rate + pr) * date_diff('microsecond', pt, t) / 3.6e9) AS dose_auc,
         sum(date_diff('microsecond', pt, t) / 3.6e9) FILTER (pr > 0) AS cont_duration
  FROM steps GROUP BY pie_id, med),
running AS (
  SELECT *, CASE WHEN med = 'propofol' THEN dose_auc * weight * 60 / 1000 ELSE dose_auc END AS total_cont_dose
  FROM area WHERE dose_auc > 0 AND cont_duration > 0),
given AS (
  SELECT coalesce(r.pie_id, b.pie_id) AS pie_id, coalesce(r.med, b.med) AS med, weight, dose_auc, cont_duration,
         dose_auc / cont_duration AS time_wt_avg_rate, total_cont_dose, total_bolus_dose,
         coalesce(total_cont_dose, 0) + coalesce(total_bolus_dose, 0) AS total_dose
  FROM running r FULL JOIN bolus_sum b ON r.pie_id = b.pie_id AND r.med = b.med),
demographics AS (
  SELECT m.*, d.cam_icu_pos,
    m.pie_id IN (SELECT pie_id FROM given WHERE med IN ('midazolam', 'lorazepam') AND cont_duration IS NOT NULL) AS bzd
  FROM measured m JOIN (SELECT pie_id, coalesce(sum(num_cam_icu_pos), 0) > 0 AS cam_icu_pos FROM daily GROUP BY pie_id) d
    ON m.pie_id = d.pie_id),
review AS (SELECT pie_id, c_mktsegment FROM pat WHERE NOT c_acctbal BETWEEN 5000 AND 5500)
"""


def _event_time():
    return (F.col("ts") - F.expr("INTERVAL 3652 DAY")).alias("t")


def extracts(t: Tables) -> dict[str, DataFrame]:
    """Clinical extracts derived from customers, orders and events."""
    ev = t.events.select(
        (F.col("user_id") * 5 + F.col("event_id") % 5).cast("string").alias("pie_id"), _event_time(), "event_type", "value",
        F.col("event_id").cast("string").alias("event_id"),
    )
    people = t.customer.select(
        F.col("c_custkey").cast("string").alias("pie_id"),
        (F.col("c_acctbal") / 50).alias("age"),
        F.expr("TIMESTAMP_NTZ'2014-02-10' + make_dt_interval(c_nationkey * 25)").alias("discharge_datetime"),
        "c_mktsegment", "c_acctbal",
        (F.col("c_custkey") + 100000).cast("string").alias("fin"),
    )
    orders = t.orders.withColumn("pie_id", F.col("o_custkey").cast("string")).withColumn(
        "minute", F.date_diff("o_orderdate", F.lit("1995-01-01").cast("date"))
    )
    arrive = "TIMESTAMP_NTZ'2014-01-01' + make_dt_interval(0, 0, minute"
    long_stay = " + CAST(floor(abs(o_totalprice - 250000) / 6) AS INT))"
    vented = ev.filter("event_type IN ('purchase', 'signup')")

    def of(kind, *cols):
        return ev.filter(F.col("event_type") == kind).select("pie_id", *cols)

    def marked(kind, limit, yes, no, name):
        return of(kind, F.when(F.col("value") > limit, F.lit(yes)).otherwise(F.lit(no)).alias(name))

    return {
        "patients": people.select("pie_id", "age", "discharge_datetime"),
        "vent_start": vented.select("pie_id", F.expr(VENT).alias("vent_event"), F.col("t").alias("vent_datetime")),
        "meds_continuous": marked("view", 30, "mg/hr", "", "med_rate_units"),
        "paralytics": marked("error", 220, "mg/hr", "", "med_rate_units"),
        "labs_preg": marked("error", 200, "Positive", "Negative", "lab_result"),
        "mpp": marked("view", 260, "Comfort Care only", "Sepsis", "mpp"),
        "locations": orders.select(
            "pie_id", F.expr(PLACE).alias("location"), F.expr(arrive + ")").alias("arrive_datetime"),
            F.expr(arrive + long_stay).alias("depart_datetime"),
        ),
        "facility": people.select(
            "pie_id", F.when(F.col("c_mktsegment") == "MACHINERY", "Direct").otherwise("Emergency").alias("admit_type")
        ),
        "diagnosis": orders.select(
            "pie_id", F.when(F.col("o_orderstatus") == "O", "Admitting").otherwise("Final").alias("diag_type"),
            F.expr(DIAGNOSIS).alias("diag_code"),
        ),
        "procedures": orders.select(
            "pie_id", F.when(F.col("o_totalprice").between(493000, 494000), "31.1").otherwise("38.9").alias("proc_code")
        ),
        "identifiers": people.select("pie_id", "fin"),
        "demographics": people.select(
            "pie_id", "age", F.lit("inpatient").alias("visit_type"), F.lit("main").alias("facility"),
            F.col("c_mktsegment").alias("diagnosis"),
        ),
        "measures": ev.filter("event_type IN ('click', 'signup')").select(
            "pie_id",
            F.expr(_case("event_type", {"click": "Weight", "signup": "Height"})).alias("measure"),
            F.expr("CASE WHEN event_type = 'signup' THEN 'cm' WHEN value < 5 THEN 'lb' ELSE 'kg' END").alias("measure_units"),
            F.col("t").alias("measure_datetime"),
            F.expr("CASE WHEN event_type = 'click' THEN 40 + value / 2 ELSE 150 + value / 10 END").alias("measure_result"),
        ),
        "labs": ev.select(
            "pie_id", F.expr(LAB).alias("lab"), F.expr(LAB_RESULT).alias("result"), F.col("t").alias("lab_datetime")
        ).unionByName(
            ev.select(
                "pie_id", F.expr(CHEMISTRY.replace("event_id", "CAST(event_id AS BIGINT)")).alias("lab"),
                (F.col("value") / 8).cast("string").alias("result"), F.col("t").alias("lab_datetime"),
            )
        ),
        "labs_abg": ev.filter("event_type IN ('purchase', 'signup')").select(
            "pie_id", F.expr(GAS).alias("lab"), (F.col("value") + 7).cast("string").alias("lab_result"),
            F.col("t").alias("lab_datetime"),
        ),
        "vitals": ev.select(
            "pie_id", F.expr(VITAL).alias("vital"), F.col("value").alias("result"), F.col("t").alias("vital_datetime")
        ),
        "meds_cont": ev.filter("event_type IN ('view', 'click', 'error')").select(
            "pie_id", F.expr(CONT).alias("med"), F.col("t").alias("med_datetime"),
            F.expr("CASE WHEN value < 20 THEN 0D ELSE value END").alias("rate"),
            F.expr(CONT_UNIT).alias("rate_unit"), "event_id",
        ),
        "meds_bolus": ev.filter(IS_BOLUS).select(
            "pie_id", F.expr(BOLUS).alias("med"), F.col("t").alias("med_datetime"), F.col("value").alias("dose"), "event_id"
        ),
        "home_meds": orders.select("pie_id", F.expr(HOME).alias("home_med")),
        "ccs_crosswalk": codes.lookup_frame(t.spark, CROSSWALK, ("ccs", "icd9_code")),
        "drug_class_members": codes.lookup_frame(t.spark, CLASS_MEMBERS, ("med_class", "med_name")),
        "manual_review": people.select(
            "fin",
            F.when(F.col("c_acctbal").between(5000, 5500), "x").alias("exclude"),
            F.lit("home").alias("disposition"),
            F.expr(ANSWER).alias("alcohol_use"),
            F.expr(ANSWER).alias("arf"),
            F.lit(" 1.5 ").alias("number_of_packs_day"),
            F.expr(ANSWER).alias("severe_organ_insufficiency_or_immunocompromised"),
            F.expr(_case("c_mktsegment", {"BUILDING": "No", "FURNITURE": "HIV "})).alias("if_yes"),
            F.col("c_mktsegment").alias("diagnosis_categories"),
        ),
    }


def _study(t: Tables) -> tuple[dict[str, DataFrame], study.StudyCohort]:
    tables = extracts(t)
    return tables, study.study_cohort(tables)


def _features(t: Tables) -> tuple[dict[str, DataFrame], study.StudyFeatures]:
    tables, chosen = _study(t)
    return tables, study.study_features(tables, chosen)


REASONS = (
    "ventilated at least 24 h", "continuous medication", "admitted to the unit", "several unit stays", "transferred in",
    "other intensive care first", "unit stay under a day", "paralytic infusion", "pregnancy test", "excluded diagnosis",
    "no diagnosis", "excluded problem", "tracheostomy", "ventilated outside the unit",
)


@query("study_attrition", f"""
WITH {EXTRACTS_SQL},
nos AS (SELECT unnest(range(1, 15)) AS step_no, unnest({list(REASONS)}) AS reason)
SELECT step_no::INT AS step_no, reason,
  (SELECT count(*) FROM status WHERE failed_step = step_no) AS removed,
  (SELECT count(*) FROM status WHERE failed_step IS NULL OR failed_step > step_no) AS remaining
FROM nos
""")
def study_attrition(t: Tables):
    return _study(t)[1].funnel.attrition()


@query("study_joins_attrition", f"""
WITH {EXTRACTS_SQL},
lost AS (
  SELECT pie_id, CASE WHEN pie_id NOT IN (SELECT pie_id FROM pat) THEN 1 WHEN pie_id NOT IN (SELECT pie_id FROM span) THEN 2
    WHEN pie_id NOT IN (SELECT pie_id FROM episode) THEN 3 WHEN pie_id NOT IN (SELECT pie_id FROM weight) THEN 4
    WHEN pie_id NOT IN (SELECT pie_id FROM height) THEN 5 WHEN pie_id NOT IN (SELECT pie_id FROM daily) THEN 6 END AS step FROM cohort),
nos AS (SELECT unnest(range(1, 7)) AS step_no, unnest(['demographics', 'unit stay', 'ventilation', 'weight', 'height', 'assessments']) AS reason)
SELECT step_no::INT AS step_no, reason, (SELECT count(*) FROM lost WHERE step = step_no) AS removed,
  (SELECT count(*) FROM lost WHERE step IS NULL OR step > step_no) AS remaining
FROM nos
""")
def study_joins_attrition(t: Tables):
    tables, chosen = _study(t)
    return study.cohort_losses(tables, chosen).attrition()


@query("study_cohort", f"WITH {EXTRACTS_SQL} SELECT pie_id, failed_step FROM status")
def study_cohort(t: Tables):
    return _study(t)[1].funnel.status


@query("study_demographics", f"""
WITH {EXTRACTS_SQL}
SELECT pie_id, age, diagnosis, round(unit_length_stay, 5) AS unit_length_stay, round(vent_duration, 5) AS vent_duration,
       weight, height, ast, alt, cam_icu_pos, bzd FROM demographics
""")
def study_demographics(t: Tables):
    return rounded(_features(t)[1].demographics, 5, "unit_length_stay", "vent_duration")


HISTORY = {
    "arf": "584.9", "asthma": "493.9", "ckd": "585.1", "copd": "491.2", "dementia": "290.0", "diabetes": "250.0",
    "heart_failure": "428.0", "hypertension": "401.9", "liver": "070.2", "seizure": "345.9",
}


HISTORY_SQL = f"""
final AS (SELECT pie_id, code FROM dx WHERE diag_type = 'Final'),
history AS (
  SELECT c.pie_id, {", ".join(f"coalesce(bool_or(code = '{code}'), false) AS {state}" for state, code in HISTORY.items())}
  FROM cohort c LEFT JOIN final f ON c.pie_id = f.pie_id GROUP BY c.pie_id)
"""
HOME_SQL = f"""
h AS (SELECT o_custkey::VARCHAR AS pie_id, lower({HOME}) AS med FROM orders),
home AS (
  SELECT c.pie_id, coalesce(bool_or(med IN ('lorazepam', 'clonazepam')), false) AS benzodiazepines,
    coalesce(bool_or(med = 'oxycodone'), false) AS narcotic_analgesics, coalesce(bool_or(med = 'sertraline'), false) AS antidepressants,
    coalesce(bool_or(med = 'haloperidol'), false) AS antipsychotics, coalesce(bool_or(med = 'phenytoin'), false) AS anticonvulsants,
    coalesce(bool_or(med = 'gabapentin'), false) AS gamma_aminobutyric_acid_analogs
  FROM cohort c LEFT JOIN h ON c.pie_id = h.pie_id GROUP BY c.pie_id)
"""


@query("study_history", f"WITH {EXTRACTS_SQL}, {HISTORY_SQL} SELECT * FROM history")
def study_history(t: Tables):
    tables, chosen = _study(t)
    return study.history(tables, chosen.keys)


@query("study_home_meds", f"WITH {EXTRACTS_SQL}, {HOME_SQL} SELECT * FROM home")
def study_home_meds(t: Tables):
    tables, chosen = _study(t)
    return study.home_meds(tables, chosen.keys)


def _ranges(names: dict[str, str], column: str, value: str) -> str:
    return ", ".join(
        f"min({value}) FILTER ({column} = '{raw}') AS {short}_min, max({value}) FILTER ({column} = '{raw}') AS {short}_max" for raw, short in names.items()
    )


SEVERITY_SQL = f"""
both_labs AS (
  SELECT pie_id, t, replace(lower(lab), 'poc a po2', 'pao2') AS lab, try_cast(result AS DOUBLE) AS num FROM lab
  UNION ALL
  SELECT g.pie_id, g.t, replace(lower(g.lab), 'poc a po2', 'pao2'), g.value + 7 FROM (
    SELECT *, {GAS} AS lab FROM ev WHERE event_type IN ('purchase', 'signup')) g
  ANTI JOIN lab l ON l.pie_id = g.pie_id AND l.t = g.t AND lower(l.lab) = lower(g.lab)),
l AS (
  SELECT b.pie_id, {_ranges(fv.SEVERITY_LABS, "lab", "num")}
  FROM both_labs b JOIN span s ON b.pie_id = s.pie_id AND t BETWEEN arrival AND arrival + INTERVAL 1 DAY
  WHERE lab IN ({", ".join(f"'{name}'" for name in fv.SEVERITY_LABS)}) AND num IS NOT NULL GROUP BY b.pie_id),
signs AS (
  SELECT pie_id, t, value, CASE WHEN event_type IN ('view', 'signup') THEN 'Temperature' WHEN event_type = 'click' THEN 'Mean Arterial Pressure'
    WHEN event_type = 'error' THEN 'Apical Heart Rate' ELSE 'Respiratory Rate' END AS vital FROM ev),
v AS (
  SELECT e.pie_id, {_ranges(fv.SEVERITY_VITALS, "vital", "value")}
  FROM signs e JOIN span s ON e.pie_id = s.pie_id AND t BETWEEN arrival AND arrival + INTERVAL 1 DAY GROUP BY e.pie_id),
severity AS (
  SELECT m.pie_id, m.age, l.* EXCLUDE (pie_id), v.* EXCLUDE (pie_id) FROM measured m JOIN l ON l.pie_id = m.pie_id JOIN v ON v.pie_id = m.pie_id)
"""


@query("study_severity", f"WITH {EXTRACTS_SQL}, {SEVERITY_SQL} SELECT * FROM severity")
def study_severity(t: Tables):
    return _features(t)[1].severity


SEDATIVE_NUMBERS = ("dose_auc", "cont_duration", "time_wt_avg_rate", "total_cont_dose", "total_bolus_dose", "total_dose")


@query("study_sedatives", f"""
WITH {EXTRACTS_SQL}
SELECT pie_id, med, weight, {", ".join(f"round({c}, 3) AS {c}" for c in SEDATIVE_NUMBERS)} FROM given
""")
def study_sedatives(t: Tables):
    return rounded(_features(t)[1].sedatives, 3, *SEDATIVE_NUMBERS)


@query("study_assessments", f"WITH {EXTRACTS_SQL} SELECT * FROM daily")
def study_assessments(t: Tables):
    tables, chosen = _study(t)
    return study.assessments(tables, chosen.span)


SHEET_SQL = f"""
a AS (SELECT pie_id, c_mktsegment, {ANSWER} AS answer FROM pat WHERE NOT c_acctbal BETWEEN 5000 AND 5500),
sheet AS (
  SELECT pie_id, CASE trim(lower(answer)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS alcohol_use,
    1.5::DOUBLE AS num_packs_day, CASE trim(lower(answer)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS organ_insuff,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'hiv' END AS organ_insuff_type, lower(c_mktsegment) AS diagnosis_categories
  FROM a)
"""
MEMBERS_SQL = f"""
members AS (SELECT d.pie_id, CASE WHEN bzd THEN '{fv.GROUP_LABELS[0]}' ELSE '{fv.GROUP_LABELS[1]}' END AS "group" FROM demographics d JOIN review r ON d.pie_id = r.pie_id)
"""
ANALYSIS = ("demographics", "pmh", "home_meds", "apache", "sedatives")


def _analysis(t: Tables, *names: str) -> dict[str, DataFrame]:
    """The named analysis tables."""
    tables, found = _features(t)
    builders = study.review_builders(study.clean_review(tables["manual_review"], tables["identifiers"]), found)
    return {name: builders[name]() for name in names}


@query("study_review", f"""
WITH {EXTRACTS_SQL}, {MEMBERS_SQL}
SELECT pie_id, "group", med, round(time_wt_avg_rate, 3) AS time_wt_avg_rate,
  round(total_cont_dose, 3) AS total_cont_dose, round(total_bolus_dose, 3) AS total_bolus_dose, round(total_dose, 3) AS total_dose
FROM members JOIN given USING (pie_id)
""")
def study_review(t: Tables):
    return rounded(_analysis(t, "sedatives")["sedatives"], 3, *SEDATIVE_NUMBERS[2:])


@query("study_review_demographics", f"""
WITH {EXTRACTS_SQL}, {SHEET_SQL}, {MEMBERS_SQL}
SELECT pie_id, "group", age, diagnosis, round(unit_length_stay, 5) AS unit_length_stay, round(vent_duration, 5) AS vent_duration,
       weight, height, ast, alt, cam_icu_pos, diagnosis_categories
FROM members JOIN demographics USING (pie_id) JOIN sheet USING (pie_id)
""")
def study_review_demographics(t: Tables):
    return rounded(_analysis(t, "demographics")["demographics"], 5, "unit_length_stay", "vent_duration")


@query("study_review_pmh", f"""
WITH {EXTRACTS_SQL}, {SHEET_SQL}, {MEMBERS_SQL}, {HISTORY_SQL}
SELECT pie_id, "group", history.* EXCLUDE (pie_id), alcohol_use, num_packs_day
FROM members JOIN history USING (pie_id) JOIN sheet USING (pie_id)
""")
def study_review_pmh(t: Tables):
    return _analysis(t, "pmh")["pmh"]


@query("study_review_home_meds", f"""
WITH {EXTRACTS_SQL}, {MEMBERS_SQL}, {HOME_SQL} SELECT pie_id, "group", home.* EXCLUDE (pie_id) FROM members JOIN home USING (pie_id)
""")
def study_review_home_meds(t: Tables):
    return _analysis(t, "home_meds")["home_meds"]


@query("study_review_apache", f"""
WITH {EXTRACTS_SQL}, {SHEET_SQL}, {MEMBERS_SQL}, {SEVERITY_SQL}
SELECT pie_id, "group", severity.* EXCLUDE (pie_id), organ_insuff, organ_insuff_type
FROM members JOIN severity USING (pie_id) JOIN sheet USING (pie_id)
""")
def study_review_apache(t: Tables):
    return _analysis(t, "apache")["apache"]


@query("study_exports", f"""
WITH {EXTRACTS_SQL}, {MEMBERS_SQL}, {SEVERITY_SQL}
SELECT 'demographics' AS name, count(*) AS n_rows, count(DISTINCT pie_id) AS n_patients FROM members
UNION ALL SELECT 'pmh', count(*), count(DISTINCT pie_id) FROM members
UNION ALL SELECT 'home_meds', count(*), count(DISTINCT pie_id) FROM members
UNION ALL SELECT 'apache', count(*), count(DISTINCT pie_id) FROM members JOIN severity USING (pie_id)
UNION ALL SELECT 'sedatives', count(*), count(DISTINCT pie_id) FROM members JOIN given USING (pie_id)
""")
def study_exports(t: Tables):
    """The five analysis tables written as CSV files and read back."""
    paths = study_files.write_analysis_tables(_analysis(t, *ANALYSIS), new_folder(t.spark, "exports"))
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pie_id").alias("n_patients")]
    return joins.union_all(*[read_text_csv(t.spark, path).agg(F.lit(name).alias("name"), *counts) for name, path in paths.items()])


@query("study_review_sheet", f"WITH {EXTRACTS_SQL}, {SHEET_SQL} SELECT * FROM sheet")
def study_review_sheet(t: Tables):
    tables = extracts(t)
    return study.clean_review(tables["manual_review"], tables["identifiers"])


REPORT_NUMBERS = ("age", "unit_length_stay", "vent_duration", "weight", "height")
REPORT_LEVELS = ("ast", "alt", "cam_icu_pos", "diagnosis_categories")
REPORT_DOSES = ("time_wt_avg_rate", "total_cont_dose", "total_bolus_dose", "total_dose")


def _label(side: str) -> str:
    return f"CASE {side} WHEN 'a' THEN '{fv.GROUP_LABELS[0]}' ELSE '{fv.GROUP_LABELS[1]}' END"


def _stacked(columns: tuple[str, ...], source: str, key: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT {key.format(c)} AS k, side, {c}::{value[1]} AS {value[0]} FROM {source}" for c in columns)


def _report_rows(report: DataFrame) -> DataFrame:
    return rounded(rounded(report, 4, "pct", "mean", "sd", "statistic"), 6, "p")


@query("study_report", f"""
WITH {EXTRACTS_SQL}, {SHEET_SQL}, {MEMBERS_SQL},
reported AS (
  SELECT d.*, diagnosis_categories, CASE WHEN bzd THEN 'a' ELSE 'b' END AS side FROM demographics d JOIN members USING (pie_id) JOIN sheet USING (pie_id)),
numbers AS ({_stacked(REPORT_NUMBERS, "reported", "'{}'", ("v", "DOUBLE"))}),
levels AS ({_stacked(REPORT_LEVELS, "reported", "'{}'", ("level", "VARCHAR"))}),
{chosen_tests_sql("numbers")}, {chi_squared_sql("levels")},
counted AS (SELECT k, level, side, count(*) AS n, sum(count(*)) OVER (PARTITION BY k, side) AS whole FROM levels WHERE level IS NOT NULL GROUP BY k, level, side)
SELECT k AS variable, NULL::VARCHAR AS level, {_label("side")} AS stratum, count(v) AS n, NULL::DOUBLE AS pct, round(avg(v), 4) AS mean,
  round(stddev_samp(v), 4) AS sd, any_value(test) AS test, round(any_value(statistic), 4) AS statistic, round(any_value(p), 6) AS p
FROM numbers JOIN chosen USING (k) WHERE v IS NOT NULL GROUP BY k, side
UNION ALL
SELECT k, level, {_label("side")}, n, round(100.0 * n / whole, 4), NULL, NULL, test, round(statistic, 4), round(p, 6) FROM counted JOIN chi USING (k)
""")
def study_report(t: Tables):
    return _report_rows(study.report_tables({"demographics": _analysis(t, "demographics")["demographics"]})["demographics"])


@query("study_report_sedatives", f"""
WITH {EXTRACTS_SQL}, {MEMBERS_SQL},
reported AS (SELECT g.*, CASE "group" WHEN '{fv.GROUP_LABELS[0]}' THEN 'a' ELSE 'b' END AS side FROM given g JOIN members USING (pie_id)),
numbers AS ({_stacked(REPORT_DOSES, "reported", "med || '/{}'", ("v", "DOUBLE"))}),
{chosen_tests_sql("numbers")}
SELECT split_part(k, '/', 1) AS med, split_part(k, '/', 2) AS variable, NULL::VARCHAR AS level, {_label("side")} AS stratum, count(v) AS n,
  NULL::DOUBLE AS pct, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, any_value(test) AS test,
  round(any_value(statistic), 4) AS statistic, round(any_value(p), 6) AS p
FROM numbers JOIN chosen USING (k) WHERE v IS NOT NULL GROUP BY k, side
""")
def study_report_sedatives(t: Tables):
    return _report_rows(study.report_tables({"sedatives": _analysis(t, "sedatives")["sedatives"]})["sedatives"])
