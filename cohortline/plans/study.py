"""The study from extracts to comparison, as functions over lazily read tables.

``tables`` maps the schema names of the extracts (``patients``, ``vent_start``,
``locations`` ...) to DataFrames. Nothing is collected: lists of ids stay key sets. Tables
that several steps read (episodes, stays, cohort, unit span, exposure) are computed once
and written to the shared folder; each is small next to the extracts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import clean, timing
from cohortline.functions.columns import (
    drop_between, drop_prefix, front, keep_between, keep_prefix, map_columns, numeric_columns, other_columns,
    rename, safe_names, sorted_columns,
)
from cohortline.operators import codes, compare, episodes, exposure, features, funnel, joins
from cohortline.plans import fixed_values as fv
from cohortline.session import materialize

KEY = "pie_id"
Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class StudyUnits:
    """Unit names a site replaces with its own."""

    study: str = fv.STUDY_UNIT
    other: tuple[str, ...] = fv.OTHER_UNITS


def screen(patients: DataFrame) -> DataFrame:
    """Adults discharged before the cut-off, one row per encounter."""
    cutoff = timing.parse_date(F.lit(fv.DISCHARGED_BEFORE))
    chosen = patients.filter((F.col("discharge_datetime") < cutoff) & (F.col("age") >= fv.MIN_AGE))
    return joins.first_row(chosen, KEY, ["discharge_datetime", "age"])


def vent_episodes(tables: Tables, screened: DataFrame) -> DataFrame:
    """``pie_id, start_datetime, stop_datetime, vent_duration`` of every ventilation episode."""
    ends = screened.select(KEY, F.col("discharge_datetime").alias("end_datetime"))
    found = episodes.run_episodes(
        tables["vent_start"], KEY, "vent_event", "vent_datetime", fv.VENT_START, ends
    )
    return found.withColumnRenamed("duration_hours", "vent_duration")


def location_stays(tables: Tables) -> DataFrame:
    stays = episodes.unit_stays(tables["locations"], KEY, "location", "arrive_datetime", "depart_datetime")
    return stays.withColumnRenamed("length_days", "unit_length_stay")


def _rated(meds: DataFrame) -> DataFrame:
    return meds.filter(F.col("med_rate_units") != "").select(KEY)


def study_funnel(
    tables: Tables, screened: DataFrame, vent: DataFrame, stays: DataFrame, units: StudyUnits = StudyUnits()
) -> funnel.Funnel:
    """Inclusion and exclusion criteria in the order of the study."""
    in_unit = F.col("location") == units.study
    unit_stays = stays.filter(in_unit)
    spark = screened.sparkSession
    spec = codes.lookup_frame(spark, fv.EXCLUSION_CODES, ("disease_state", "type", "code"))
    diagnoses = tables["diagnosis"]
    excluded_codes = codes.expand_codes(spec, tables["ccs_crosswalk"])
    criteria = [
        funnel.Criterion(
            "ventilated at least 24 h", vent.filter(F.col("vent_duration") >= fv.MIN_VENT_HOURS), include=True
        ),
        funnel.Criterion("continuous medication", _rated(tables["meds_continuous"]), include=True),
        funnel.Criterion("admitted to the unit", unit_stays, include=True),
        funnel.Criterion(
            "several unit stays", episodes.keys_with_repeat_stays(stays, KEY, "location", units.study)
        ),
        funnel.Criterion("transferred in", tables["facility"].filter(F.col("admit_type") == fv.DIRECT_ADMISSION)),
        funnel.Criterion(
            "other intensive care first",
            joins.keys_before_reference(
                stays, KEY, "arrive_datetime", F.col("location").isin(*units.other), in_unit
            ),
        ),
        funnel.Criterion("unit stay under a day", unit_stays.filter(F.col("unit_length_stay") < fv.MIN_STAY_DAYS)),
        funnel.Criterion("paralytic infusion", _rated(tables["paralytics"])),
        funnel.Criterion("pregnancy test", tables["labs_preg"].filter(F.col("lab_result") == fv.POSITIVE)),
        funnel.Criterion("excluded diagnosis", codes.keys_with_codes(diagnoses, excluded_codes, KEY, "diag_code")),
        funnel.Criterion("no diagnosis", diagnoses, include=True),
        funnel.Criterion("excluded problem", tables["mpp"].filter(clean.mentions("mpp", fv.PROBLEM_PHRASES))),
        funnel.Criterion(
            "tracheostomy", tables["procedures"].filter(F.col("proc_code").isin(*fv.TRACHEOSTOMY_CODES))
        ),
        funnel.Criterion(
            "ventilated outside the unit",
            joins.keys_outside_span(
                vent, unit_stays, KEY, "start_datetime", "stop_datetime", "arrive_datetime", "depart_datetime"
            ),
        ),
    ]
    return funnel.cohort_funnel(screened, criteria, KEY)


def unit_span(cohort: DataFrame, stays: DataFrame, units: StudyUnits = StudyUnits()) -> DataFrame:
    """``pie_id, arrival, leave`` and length of the one unit stay of each cohort member."""
    kept = joins.keep_in(stays.filter(F.col("location") == units.study), cohort, KEY)
    return kept.select(
        KEY, F.col("arrive_datetime").alias("arrival"), F.col("depart_datetime").alias("leave"), "unit_length_stay"
    )


def during(rows: DataFrame, span: DataFrame, ts: str) -> DataFrame:
    """Rows inside the unit stay."""
    return joins.within_span(rows, span.select(KEY, "arrival", "leave"), KEY, ts, "arrival", "leave")


def first_day(rows: DataFrame, span: DataFrame, ts: str) -> DataFrame:
    """Rows in the first 24 hours of the unit stay."""
    day = span.select(KEY, "arrival", timing.plus_days("arrival", 1).alias("until"))
    return joins.within_span(rows, day, KEY, ts, "arrival", "until")


class StudyCohort:
    """The screened encounters, what was derived to judge them, and who is left. Each table is computed when first asked for, then kept."""

    def __init__(self, tables: Tables, units: StudyUnits = StudyUnits()):
        self.tables, self.units = tables, units

    @cached_property
    def screened(self) -> DataFrame:
        return materialize(screen(self.tables["patients"]), "screened")

    @cached_property
    def vent(self) -> DataFrame:
        return materialize(vent_episodes(self.tables, self.screened), "vent")

    @cached_property
    def stays(self) -> DataFrame:
        return materialize(location_stays(self.tables), "stays")

    @cached_property
    def funnel(self) -> funnel.Funnel:
        judged = study_funnel(self.tables, self.screened, self.vent, self.stays, self.units)
        return replace(judged, status=materialize(judged.status, "status"))

    @cached_property
    def keys(self) -> DataFrame:
        return self.funnel.cohort_keys()

    @cached_property
    def span(self) -> DataFrame:
        return materialize(unit_span(self.keys, self.stays, self.units), "span")


def study_cohort(tables: Tables, units: StudyUnits = StudyUnits()) -> StudyCohort:
    """Screen, include and exclude."""
    return StudyCohort(tables, units)


def first_weight_height(tables: Tables, cohort: DataFrame) -> DataFrame:
    def measured(name: str, unit: str):
        return (F.col("measure") == name) & (F.col("measure_units") == unit)

    rows = joins.keep_in(tables["measures"], cohort, KEY)
    return features.first_measures(
        rows, KEY, "measure_result", ["measure_datetime", "measure_result"],
        {"weight": measured(*fv.WEIGHT), "height": measured(*fv.HEIGHT)},
    )


def liver_flags(tables: Tables, cohort: DataFrame, span: DataFrame) -> DataFrame:
    rows = during(tables["labs"].filter(F.col("lab").isin(*fv.LIVER_LIMITS)), span, "lab_datetime")
    rows = rows.withColumn("result", clean.to_number("result"))
    return features.threshold_flags(rows, cohort, KEY, "lab", "result", fv.LIVER_LIMITS)


def history(tables: Tables, cohort: DataFrame) -> DataFrame:
    """Past medical history: one boolean per disease state."""
    spec = codes.lookup_frame(cohort.sparkSession, fv.HISTORY_CODES, ("disease_state", "type", "code"))
    wanted = codes.expand_codes(spec, tables["ccs_crosswalk"])
    rows = joins.keep_in(tables["diagnosis"], cohort, KEY)
    states = codes.code_states(rows, wanted, KEY, "diag_code", ("diag_type", "Final"))
    return features.indicator_matrix(states, cohort, KEY, "disease_state", fv.HISTORY_STATES)


def home_meds(tables: Tables, cohort: DataFrame) -> DataFrame:
    """Home medications: one boolean per class."""
    members = codes.class_members(tables["drug_class_members"], fv.HOME_MED_TIERS)
    rows = joins.keep_in(tables["home_meds"], cohort, KEY).withColumn("home_med", F.lower("home_med"))
    taken = codes.class_rows(rows, members, KEY, "home_med")
    taken = taken.withColumn("med_class", clean.canonical("med_class", fv.HOME_MED_MERGE))
    return features.indicator_matrix(taken, cohort, KEY, "med_class", fv.HOME_MED_LEVELS)


def severity_inputs(tables: Tables, ages: DataFrame, span: DataFrame) -> DataFrame:
    """Worst values of the first day: min and max of every severity measure.

    Blood gases are added where the labs lack them. That match is on encounter, time and
    name, so both tables are cut down to the first day and the wanted names before it.
    """
    wanted = [*fv.SEVERITY_LABS, *fv.LAB_RELABEL]
    gases = tables["labs_abg"].withColumnRenamed("lab_result", "result")
    labs, gases = (
        first_day(rows.withColumn("lab", F.lower("lab")).filter(F.col("lab").isin(*wanted)), span, "lab_datetime")
        for rows in (tables["labs"], gases)
    )
    day_labs = joins.add_missing(labs, gases, [KEY, "lab_datetime", "lab"]).withColumns(
        {"lab": clean.relabel("lab", fv.LAB_RELABEL), "result": clean.to_number("result")}
    )
    vitals = tables["vitals"].withColumn("vital", clean.canonical("vital", fv.VITAL_RULES))
    day_vitals = first_day(vitals.filter(F.col("vital").isin(*fv.SEVERITY_VITALS)), span, "vital_datetime")
    wide = (
        ages.select(KEY, "age")
        .join(features.worst_values(day_labs, KEY, "lab", "result", fv.SEVERITY_LABS), KEY)
        .join(features.worst_values(day_vitals, KEY, "vital", "result", fv.SEVERITY_VITALS), KEY)
    )
    return sorted_columns(wide, KEY)


def sedatives(tables: Tables, weights: DataFrame, span: DataFrame) -> DataFrame:
    """Continuous and bolus exposure per encounter and drug."""
    cont = tables["meds_cont"].withColumn("med", F.lower("med"))
    bolus = tables["meds_bolus"].withColumn("med", F.lower("med"))
    # The weight rides on the span, one row per encounter, so it costs no join of its own.
    weighed = span.select(KEY, "arrival", "leave").join(weights.select(KEY, "weight"), KEY)
    inside = joins.within_span(cont, weighed, KEY, "med_datetime", "arrival", "leave")
    samples = exposure.not_also_bolus(inside, bolus, "event_id").withColumn(
        "rate", exposure.convert_rate("med", "rate_unit", "rate", "weight")
    )
    running = (
        exposure.rate_exposure(samples, [KEY, "med"], "med_datetime", "rate", "rate_unit", "event_id")
        .join(weights.select(KEY, "weight"), KEY)
        .withColumn("total_cont_dose", exposure.total_dose("med", "dose_auc", "weight"))
    )
    given = exposure.bolus_totals(during(bolus, span, "med_datetime"), [KEY, "med"], "dose")
    return exposure.combine_doses(running, given, [KEY, "med"]).select(
        KEY, "med", "weight", "dose_auc", "cont_duration", "time_wt_avg_rate",
        "total_cont_dose", "total_bolus_dose", "total_dose",
    )


def assessments(tables: Tables, span: DataFrame) -> DataFrame:
    """Daily sedation score range and positive delirium screens."""
    wanted = tables["labs"].filter(F.col("lab").isin(fv.SEDATION_SCORE, fv.DELIRIUM_SCREEN))
    return features.daily_rollup(
        during(wanted, span, "lab_datetime"),
        KEY,
        "lab_datetime",
        is_score=F.col("lab") == fv.SEDATION_SCORE,
        score=clean.to_number("result"),
        is_screen=(F.col("lab") == fv.DELIRIUM_SCREEN) & clean.delirium_positive("result").isNotNull(),
        positive=clean.delirium_positive("result"),
        names=("min_rass", "max_rass", "num_cam_icu_pos"),
    ).withColumnRenamed("day", "lab_date")


def cohort_losses(tables: Tables, chosen: StudyCohort) -> funnel.Funnel:
    """Who of the cohort leaves the demographics, and at which of their inner joins: the first table without a row of theirs."""

    def measured(name: str, unit: str) -> DataFrame:
        return tables["measures"].filter((F.col("measure") == name) & (F.col("measure_units") == unit))

    scored = (F.col("lab") == fv.SEDATION_SCORE) | ((F.col("lab") == fv.DELIRIUM_SCREEN) & clean.delirium_positive("result").isNotNull())
    parts = [
        ("demographics", tables["demographics"]),
        ("unit stay", chosen.span),
        ("ventilation", chosen.vent),
        ("weight", measured(*fv.WEIGHT)),
        ("height", measured(*fv.HEIGHT)),
        ("assessments", during(tables["labs"].filter(scored), chosen.span, "lab_datetime")),
    ]
    return funnel.join_losses(chosen.keys, parts, KEY)


class StudyFeatures:
    """The feature tables of a cohort. Each is computed when first asked for, from no more than it needs, then kept.

    Demographics are inner-joined step by step: an encounter without a weight, height,
    episode or assessment row leaves the demographics, as in the study (:func:`cohort_losses` counts them).
    """

    def __init__(self, tables: Tables, chosen: StudyCohort):
        self.tables, self.chosen = tables, chosen

    @cached_property
    def measured(self) -> DataFrame:
        tables, cohort, span = self.tables, self.chosen.keys, self.chosen.span
        vent_total = self.chosen.vent.withColumnRenamed("vent_duration", "duration_hours")
        vent_total = episodes.total_duration(joins.keep_in(vent_total, cohort, KEY), KEY, "vent_duration")
        people = tables["demographics"]
        if {"visit_type", "facility"} <= set(people.columns):
            people = drop_between(people, "visit_type", "facility")
        return materialize(
            people.join(span.select(KEY, "unit_length_stay"), KEY)
            .join(vent_total, KEY)
            .join(first_weight_height(tables, cohort), KEY)
            .join(liver_flags(tables, cohort, span), KEY),
            "measured",
        )

    @cached_property
    def sedatives(self) -> DataFrame:
        return materialize(sedatives(self.tables, self.measured, self.chosen.span), "sedatives")

    @cached_property
    def assessments(self) -> DataFrame:
        return materialize(assessments(self.tables, self.chosen.span), "assessments")

    @cached_property
    def demographics(self) -> DataFrame:
        delirium = features.any_positive(self.assessments, KEY, "num_cam_icu_pos", "cam_icu_pos")
        members = self.measured.join(delirium, KEY)
        exposed = funnel.exposure_group(
            members, self.sedatives, KEY, funnel.listed_drug_given("med", "cont_duration", fv.EXPOSURE_DRUGS), fv.GROUP_LABELS
        ).select(KEY, F.col("exposed").alias("bzd"))
        return materialize(members.join(exposed, KEY), "demographics")

    @cached_property
    def history(self) -> DataFrame:
        return history(self.tables, self.chosen.keys)

    @cached_property
    def home_meds(self) -> DataFrame:
        return home_meds(self.tables, self.chosen.keys)

    @cached_property
    def severity(self) -> DataFrame:
        return severity_inputs(self.tables, self.measured, self.chosen.span)


def study_features(tables: Tables, chosen: StudyCohort) -> StudyFeatures:
    """All feature tables of a cohort."""
    return StudyFeatures(tables, chosen)


# Review sheet columns that keep or lose their names.
REVIEW_NAMES = {
    "number_of_packs_day": "num_packs_day",
    "number_of_years": "num_years_smk",
    "pak_year": "pack_years",
    "severe_organ_insufficiency_or_immunocompromised": "organ_insuff",
    "if_yes": "organ_insuff_type",
}
REVIEW_NUMBERS = ("num_packs_day", "num_years_smk", "pack_years")
REVIEW_YES_NO = ("alcohol_use", "illicit_drug_use", "arf", "organ_insuff")


def clean_review(sheet: DataFrame, identifiers: DataFrame) -> DataFrame:
    """The hand-entered review sheet, cleaned, keyed by encounter, exclusions applied.

    Any filled ``exclude`` cell excludes. Text is lower-cased and trimmed, null tokens
    become null, yes/no answers become booleans and counts become numbers.
    """
    rows = rename(safe_names(sheet), REVIEW_NAMES).filter("fin IS NOT NULL")
    rows = rows.withColumns({"fin": F.col("fin").cast("string"), "exclude": clean.present("exclude")})
    rows = rows.join(identifiers.select(KEY, F.col("fin").cast("string").alias("fin")), "fin")
    block = ["fin", "exclude"]
    if "disposition" in rows.columns:
        names = rows.columns
        block = names[: names.index("disposition") + 1]
    rows = rows.select(KEY, "exclude", *[c for c in rows.columns if c not in {KEY, "exclude", *block}])
    if "organ_insuff_type" in rows.columns:
        rows = rows.withColumn(
            "organ_insuff_type", F.when(F.lower("organ_insuff_type") != "no", F.col("organ_insuff_type"))
        )
    numbers = [c for c in REVIEW_NUMBERS if c in rows.columns]
    text = [c for c in rows.columns if c not in {KEY, "exclude", "diagnosis", *numbers}]
    rows = map_columns(rows, text, clean.null_tokens)
    rows = map_columns(rows, numbers, clean.to_number)
    rows = map_columns(rows, [c for c in REVIEW_YES_NO if c in rows.columns], clean.yes_no)
    return rows.filter(~F.col("exclude")).drop("exclude", "arf")


def review_tables(review: DataFrame, found: StudyFeatures) -> dict[str, DataFrame]:
    """Analysis tables: every feature table restricted to reviewed patients, with the group."""
    return {name: build() for name, build in review_builders(review, found).items()}


def review_builders(review: DataFrame, found: StudyFeatures) -> dict[str, Callable[[], DataFrame]]:
    """The analysis tables by name, each as a function that computes no more than it needs."""

    def demographics() -> DataFrame:
        grouped = joins.keep_in(found.demographics, review, KEY).withColumn("group", clean.labelled("bzd", *fv.GROUP_LABELS))
        if "diagnosis_categories" in review.columns:
            grouped = grouped.join(review.select(KEY, "diagnosis_categories"), KEY)
        return front(grouped.drop("bzd"), KEY, "group")

    def members() -> DataFrame:
        return demographics().select(KEY, "group")

    def sedative_doses() -> DataFrame:
        doses = keep_between(found.sedatives, "time_wt_avg_rate", "total_dose", also=[KEY, "med"])
        return front(members().join(doses, KEY), KEY, "med", "group")

    return {
        "demographics": demographics,
        "pmh": lambda: members().join(found.history, KEY).join(drop_prefix(review, "diagnosis", "organ"), KEY),
        "home_meds": lambda: members().join(found.home_meds, KEY),
        "apache": lambda: members().join(found.severity, KEY).join(keep_prefix(review, "organ", also=[KEY]), KEY),
        "sedatives": sedative_doses,
    }


def report_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Table 1 with tests for each of the given analysis tables; medications are reported per drug."""
    out = {}
    for name, table in tables.items():
        by = ["med"] if name == "sedatives" else []
        numeric, categorical = _variables(table, {KEY, "group", "diagnosis", *by})
        out[name] = compare.table_one_with_p(table, "group", fv.GROUP_LABELS, numeric, categorical, by)
    return out


def _variables(df: DataFrame, leave_out: set[str]) -> tuple[list[str], list[str]]:
    return (
        [c for c in numeric_columns(df) if c not in leave_out],
        [c for c in other_columns(df) if c not in leave_out],
    )
