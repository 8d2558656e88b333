"""Hand-computed cases of the composite operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortline.functions import aggregates, clean
from cohortline.operators import codes, episodes, exposure, features, funnel, joins
from cohortline.plans import study
from tests.conftest import rows, ts


@pytest.mark.parametrize("slot_hours", [0.5, 6, 24, 24 * 365])
def test_episodes(frame, slot_hours):
    s, p = "vent start time", "vent stop time"
    events = frame(
        [
            ("A", s, ts("01-01")), ("A", s, ts("01-01 06:00")), ("A", p, ts("01-02")), ("A", p, ts("01-02 03:00")),
            ("A", s, ts("01-05")), ("B", p, ts("02-01")), ("B", s, ts("02-01 12:00")), ("C", s, ts("03-01")),
            ("C", p, ts("03-01 10:00")), ("C", None, ts("03-01 05:00")), ("C", p, None),
        ],
        "pie_id string, vent_event string, vent_datetime timestamp_ntz",
    )
    ends = frame(
        [("A", ts("01-06 12:00")), ("B", ts("02-03")), ("C", ts("03-05"))],
        "pie_id string, end_datetime timestamp_ntz",
    )
    found = episodes.run_episodes(
        events, "pie_id", "vent_event", "vent_datetime", s, ends, slot_hours=slot_hours
    )
    assert rows(found) == [
        ("A", ts("01-01"), ts("01-02 03:00"), 27.0),
        ("A", ts("01-05"), None, 36.0),
        ("B", ts("02-01 12:00"), None, 36.0),
        ("C", ts("03-01"), ts("03-01 10:00"), 10.0),
    ]
    assert rows(episodes.keys_with_long_episode(found, "pie_id", 24)) == [("A",), ("B",)]
    first = episodes.run_episodes(
        events, "pie_id", "vent_event", "vent_datetime", s, ends, slot_hours=slot_hours, stop_at="first"
    )
    assert rows(first)[0] == ("A", ts("01-01"), ts("01-02"), 24.0)
    assert [r[3] for r in rows(first)[1:]] == [36.0, 36.0, 10.0]


@pytest.mark.parametrize("slot_hours", [0.5, 2, 24])
def test_exposure(frame, slot_hours):
    c = [
        (1, "Fentanyl", 0, 0.05, "mg/hr"), (2, "Fentanyl", 2, 0.1, "mg/hr"), (3, "Fentanyl", 3, 9.9, None),
        (4, "Fentanyl", 4, 0.0, "mg/hr"), (5, "Fentanyl", 5, 0.0, None),
        (6, "Propofol", 0, 20.0, "microgram/kg/min"), (7, "Propofol", 1, 20.0, "microgram/kg/min"),
        (8, "Propofol", 3, 0.0, "microgram/kg/min"), (9, "Midazolam", 0, 2.0, "mg/hr"),
        (10, "Propofol", 2, 500.0, "microgram/kg/min"),
    ]
    cont = frame(
        [("A", e, m.lower(), ts(f"01-01 {h:02d}:00"), r, u) for e, m, h, r, u in c],
        "pie_id string, event_id long, med string, t timestamp_ntz, rate double, rate_unit string",
    )
    bolus = frame(
        [("A", 20, "fentanyl", 25.0), ("A", 21, "fentanyl", 50.0), ("A", 22, "lorazepam", 2.0), ("A", 10, "propofol", 5.0)],
        "pie_id string, event_id long, med string, dose double",
    )
    weight = F.lit(80.0)
    samples = exposure.not_also_bolus(cont, bolus, "event_id").withColumn(
        "rate", exposure.convert_rate("med", "rate_unit", "rate", weight)
    )
    running = exposure.rate_exposure(
        samples, ["pie_id", "med"], "t", "rate", "rate_unit", "event_id", slot_hours
    ).withColumn("total_cont_dose", exposure.total_dose("med", "dose_auc", weight))
    total = exposure.combine_doses(
        running, exposure.bolus_totals(bolus, ["pie_id", "med"], "dose"), ["pie_id", "med"]
    )
    got = {r["med"]: r for r in total.collect()}
    assert set(got) == {"fentanyl", "propofol", "lorazepam"}

    def values(med):
        r = got[med]
        names = ("dose_auc", "cont_duration", "time_wt_avg_rate", "total_cont_dose", "total_bolus_dose", "total_dose")
        return [r[n] for n in names]

    assert values("fentanyl") == pytest.approx([250, 4, 62.5, 250, 75, 325])
    assert values("propofol") == pytest.approx([40, 3, 40 / 3, 192, 5, 197])
    assert values("lorazepam") == [None, None, None, None, 2.0, 2.0]
    group = funnel.exposure_group(
        cont.select("pie_id").distinct(), total, "pie_id",
        funnel.listed_drug_given("med", "cont_duration", ["midazolam", "lorazepam"]), ("BZD", "No BZD"),
    )
    assert rows(group) == [("A", False, "No BZD")]


def test_conversions(frame):
    df = frame(
        [
            ("Ketamine", "mg/hr", 160.0), ("fentanyl", "microgram/kg/min", 2.0), ("fentanyl", None, 2.0),
            ("ketamine", "mg/kg/hr", 3.0), ("other", "mg/hr", 7.0),
        ],
        "med string, unit string, rate double",
    )
    out = df.select(exposure.convert_rate("med", "unit", "rate", F.lit(80.0)).alias("r"))
    assert [r.r for r in out.collect()] == [2.0, 120.0, 2.0, 3.0, 7.0]


def test_null_and_tied_samples(frame):
    """Tied samples are averaged for the area; a null rate ends an interval but adds no point."""
    data = [
        (1, 0, 10.0), (2, 0, 20.0),  # average 15, the later one positive
        (3, 2, None),  # ends the first interval after 2 h
        (4, 4, 5.0), (5, 6, 0.0),
    ]
    df = frame([("A", e, ts(f"01-01 {h:02d}:00"), r) for e, h, r in data], "k string, e long, t timestamp_ntz, r double")
    for slot in (1, 3, 24):
        got = exposure.rate_exposure(df, ["k"], "t", "r", tie="e", slot_hours=slot).collect()[0]
        assert got["dose_auc"] == pytest.approx(0.5 * (15 + 5) * 4 + 0.5 * 5 * 2)
        assert got["cont_duration"] == pytest.approx(2 + 2)


def test_funnel(frame):
    base = frame([(f"p{i}",) for i in range(1, 7)], "pie_id string")
    one = frame([("p2",), ("p3",), ("zz",)], "pie_id string")
    two = frame([("p3",), ("p4",), ("p4",)], "pie_id string")
    a, b = funnel.Criterion("one", one), funnel.Criterion("two", two)
    forward = funnel.cohort_funnel(base, [a, b], "pie_id")
    backward = funnel.cohort_funnel(base, [b, a], "pie_id")
    assert rows(forward.cohort()) == rows(backward.cohort()) == [("p1",), ("p5",), ("p6",)]
    assert rows(forward.attrition()) == [(1, "one", 2, 4), (2, "two", 1, 3)]
    assert rows(backward.attrition()) == [(1, "two", 2, 4), (2, "one", 1, 3)]
    kept = funnel.cohort_funnel(base, [funnel.Criterion("in", one, include=True)], "pie_id")
    assert rows(kept.cohort()) == [("p2",), ("p3",)]


def test_indicator_matrix(frame):
    data = frame([("A", "ckd"), ("A", "ckd"), ("B", "copd"), ("Z", "ckd")], "pie_id string, state string")
    cohort = frame([("A",), ("B",), ("C",)], "pie_id string")
    out = features.indicator_matrix(data, cohort, "pie_id", "state", ["asthma", "ckd", "copd"])
    assert out.columns == ["pie_id", "asthma", "ckd", "copd"]
    assert rows(out) == [("A", False, True, False), ("B", False, False, True), ("C", False, False, False)]


def test_code_sets(spark, frame):
    spec = codes.lookup_frame(spark, [("ckd", "ICD9", "585.1"), ("liver", "CCS", "6")], ("disease_state", "type", "code"))
    crosswalk = frame([("6", "070.1"), ("6", "070.2")], "ccs string, icd9_code string")
    diagnoses = frame(
        [("A", "585.1", "Final"), ("B", "070.2", "Final"), ("C", "585.1", "Admitting"), ("D", "585", "Final")],
        "pie_id string, diag_code string, diag_type string",
    )
    expanded = codes.expand_codes(spec, crosswalk)
    out = codes.code_states(diagnoses, expanded, "pie_id", "diag_code", ("diag_type", "Final"))
    assert rows(out) == [("A", "ckd"), ("B", "liver")]
    assert rows(codes.keys_with_codes(diagnoses, expanded, "pie_id", "diag_code")) == [("A",), ("B",), ("C",)]


def test_worst_values_first_day(frame):
    labs = frame(
        [
            ("A", "poc a po2", "80", ts("01-01 10:00")), ("A", "pao2", "60", ts("01-02 10:00")),
            ("A", "pao2", "50", ts("01-02 10:00:01")), ("A", "wbc", ">30", ts("01-01 11:00")),
            ("A", "wbc", "12.5", ts("01-01 12:00")),
        ],
        "pie_id string, lab string, result string, t timestamp_ntz",
    )
    span = frame([("A", ts("01-01 10:00"), ts("01-09"))], "pie_id string, arrival timestamp_ntz, leave timestamp_ntz")
    day = study.first_day(labs, span, "t").withColumn("result", clean.to_number("result"))
    day = day.withColumn("lab", clean.relabel("lab", {"poc a po2": "pao2"}))
    out = features.worst_values(day, "pie_id", "lab", "result", {"pao2": "pao2", "wbc": "wbc"})
    assert rows(out, "pie_id", "pao2_min", "pao2_max", "wbc_min", "wbc_max") == [("A", 60.0, 80.0, 12.5, 12.5)]


def test_daily_rollup(frame):
    r, c = "RASS Score", "(CAM-ICU) Interpretation"
    data = [
        ("A", r, "-2", 1), ("A", r, "1", 1), ("A", c, "Positive", 1), ("A", c, "Negative", 1), ("A", r, "0", 2),
        ("A", c, "Unable to assess", 2), ("B", c, "Negative", 1), ("C", r, "x", 1), ("C", r, "1", 1),
        ("A", c, "Unable to assess", 3), ("A", c, None, 4),
    ]
    labs = frame(
        [(p, lab, v, ts(f"01-0{d} 08:00")) for p, lab, v, d in data],
        "pie_id string, lab string, result string, lab_datetime timestamp_ntz",
    )
    span = frame(
        [(p, ts("01-01"), ts("01-09")) for p in "ABC"], "pie_id string, arrival timestamp_ntz, leave timestamp_ntz"
    )
    daily = study.assessments({"labs": labs}, span)
    assert rows(daily, "pie_id", "lab_date", "min_rass", "max_rass", "num_cam_icu_pos") == [
        ("A", ts("01-01"), -2.0, 1.0, 1),
        ("A", ts("01-02"), 0.0, 0.0, None),
        ("B", ts("01-01"), None, None, 0),
        ("C", ts("01-01"), None, None, None),
    ]
    flags = features.any_positive(daily, "pie_id", "num_cam_icu_pos", "pos")
    assert rows(flags) == [("A", True), ("B", False), ("C", False)]


def test_null_rules(frame):
    df = frame([("a", 1.0), ("a", None), ("b", None), ("b", None)], "k string, x double")
    out = df.groupBy("k").agg(aggregates.sum_strict("x").alias("s"), aggregates.sum_or_zero("x").alias("t"))
    assert rows(out) == [("a", None, 1.0), ("b", None, 0.0)]
    keys = frame([("a",), (None,), ("b",)], "k string")
    other = frame([("b",)], "k string")
    assert rows(joins.drop_in(keys, other, "k")) == [("a",), (None,)]
    nulls = frame([(None,), ("b",)], "k string")
    assert rows(joins.drop_in(keys, nulls, "k", null_safe=True)) == [("a",)]
    assert rows(joins.keep_in(keys, nulls, "k", null_safe=True)) == [("b",), (None,)]
    assert rows(joins.keep_in(keys, nulls, "k")) == [("b",)]


def test_priority_class(frame):
    members = frame(
        [
            ("benzodiazepines", "Lorazepam"), ("benzodiazepines", "Clonazepam"),
            ("anticonvulsants", "Clonazepam"), ("anticonvulsants", "Phenytoin"), ("unlisted", "Aspirin"),
        ],
        "med_class string, med_name string",
    )
    out = codes.class_members(members, {"benzodiazepines": 0, "anticonvulsants": 1})
    assert rows(out) == [
        ("anticonvulsants", "phenytoin"), ("benzodiazepines", "clonazepam"), ("benzodiazepines", "lorazepam"),
    ]


def test_threshold_flags(frame):
    data = frame([("A", "AST", 76.0), ("A", "ALT", 81.0), ("B", "AST", 75.0)], "pie_id string, lab string, v double")
    cohort = frame([("A",), ("B",), ("C",)], "pie_id string")
    out = features.threshold_flags(data, cohort, "pie_id", "lab", "v", {"AST": 75.0, "ALT": 81.0})
    assert rows(out, "pie_id", "ast", "alt") == [("A", True, False), ("B", False, False), ("C", False, False)]


@pytest.mark.parametrize("slot_hours", [1, 24, 1000])
def test_stays(frame, slot_hours):
    data = frame(
        [
            ("A", "M", ts("01-01"), ts("01-01 12:00")), ("A", "M", ts("01-01 12:00"), ts("01-03")),
            ("A", "W", ts("01-03"), ts("01-05")),
        ],
        "pie_id string, location string, arrive timestamp_ntz, depart timestamp_ntz",
    )
    stays = episodes.unit_stays(data, "pie_id", "location", "arrive", "depart", slot_hours=slot_hours)
    assert rows(stays) == [("A", "M", ts("01-01"), ts("01-03"), 2.0), ("A", "W", ts("01-03"), ts("01-05"), 2.0)]
    assert rows(episodes.keys_with_repeat_stays(stays, "pie_id", "location", "M")) == []


def test_review_sheet(frame):
    sheet = frame(
        [
            ("123", None, "x", " Yes", "nk", "1.5", "NK", "No"), ("456", "x", "y", "no", "no", "1", "2", "HIV"),
            (None, None, "z", "yes", "yes", "3", "4", "HIV"),
        ],
        "fin string, exclude string, disposition string, `alcohol.use` string, `illicit.drug.use` string,"
        " `number.of.packs.day` string, `number.of.years` string, `if.yes` string",
    )
    ids = frame([("A", "123"), ("B", "456")], "pie_id string, fin string")
    out = study.clean_review(sheet, ids)
    assert out.columns == ["pie_id", "alcohol_use", "illicit_drug_use", "num_packs_day", "num_years_smk", "organ_insuff_type"]
    assert rows(out) == [("A", True, None, 1.5, None, None)]


def test_theta_joins(frame):
    stays = frame(
        [("A", "W", ts("01-01")), ("A", "M", ts("01-02")), ("B", "M", ts("01-01")), ("B", "W", ts("01-02"))],
        "k string, loc string, t timestamp_ntz",
    )
    out = joins.keys_before_reference(stays, "k", "t", F.col("loc") == "W", F.col("loc") == "M")
    assert rows(out) == [("A",)]
    eps = frame(
        [("A", ts("01-01"), ts("01-02")), ("B", ts("01-09"), None), ("C", ts("01-01"), None), ("D", ts("01-03"), ts("01-04"))],
        "k string, start timestamp_ntz, stop timestamp_ntz",
    )
    spans = frame([(k, ts("01-03"), ts("01-05")) for k in "ABCD"], "k string, arrive timestamp_ntz, depart timestamp_ntz")
    assert rows(joins.keys_outside_span(eps, spans, "k", "start", "stop", "arrive", "depart")) == [("A",), ("B",)]
