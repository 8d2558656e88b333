"""From a directory of extract files to the study's tables, and from its result tables back to files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.columns import safe_names
from cohortline.sources import extracts as ex

# Each table of the study, its layout, and the prefix of its files where that is not the layout's.
STUDY_FILES: dict[str, tuple[ex.ExtractSpec, str | None]] = {
    "patients": (ex.PATIENTS, None),
    "vent_start": (ex.VENT_START, None),
    "meds_continuous": (ex.MEDS_CONTINUOUS, None),
    "paralytics": (ex.MEDS_CONTINUOUS, "paralytics"),
    "locations": (ex.LOCATIONS, None),
    "facility": (ex.FACILITY, None),
    "labs": (ex.LABS, None),
    "labs_preg": (ex.LABS_PREG, None),
    "labs_abg": (ex.LABS_ABG, None),
    "diagnosis": (ex.DIAGNOSIS, None),
    "mpp": (ex.MPP, None),
    "procedures": (ex.PROCEDURES, None),
    "identifiers": (ex.IDENTIFIERS, None),
    "demographics": (ex.DEMOGRAPHICS, None),
    "measures": (ex.MEASURES, None),
    "vitals": (ex.VITALS, None),
    "meds_cont": (ex.MEDS_CONT, None),
    "meds_bolus": (ex.MEDS_BOLUS, None),
    "home_meds": (ex.HOME_MEDS, None),
    "ccs_crosswalk": (ex.CCS_CROSSWALK, None),
    "drug_class_members": (ex.DRUG_CLASS_MEMBERS, None),
}
REVIEW_SHEET = "manual_review"


@dataclass(frozen=True)
class StudyExtracts:
    """The study's tables by name, and all rows of its files that do not fit: ``extract, file, record``."""

    tables: dict[str, DataFrame]
    bad: DataFrame


def read_review_sheet(spark: SparkSession, directory: str, name: str = REVIEW_SHEET) -> DataFrame:
    """The review sheet, saved as CSV: every cell as text, headers as plain names."""
    return safe_names(ex.read_text_csv(spark, f"{directory.rstrip('/')}/{name}*", names="*.csv*"))


def load_study(spark: SparkSession, directory: str) -> StudyExtracts:
    """Every table of the study from the files of one directory, with the bad rows of all of them in one table."""
    loaded = {name: ex.load_extract(spark, directory, spec, pattern) for name, (spec, pattern) in STUDY_FILES.items()}
    tables = {name: one.rows for name, one in loaded.items()}
    bad = [one.bad.select(F.lit(name).alias("extract"), "file", "record") for name, one in loaded.items()]
    merged = bad[0]
    for part in bad[1:]:
        merged = merged.union(part)
    return StudyExtracts(tables | {REVIEW_SHEET: read_review_sheet(spark, directory)}, merged)


def write_analysis_tables(tables: Mapping[str, DataFrame], directory: str, fmt: str = "csv") -> dict[str, str]:
    """Each analysis table under its own name; returns the paths."""
    return {name: ex.write_table(df, directory, name, fmt) for name, df in tables.items()}
