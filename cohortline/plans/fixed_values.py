"""Fixed values of the study: unit names, code lists, classes, limits and labels."""

from __future__ import annotations

# Screening limits.
DISCHARGED_BEFORE = "9/1/2015"
MIN_AGE = 18
MIN_VENT_HOURS = 24
MIN_STAY_DAYS = 1
BATCH_SIZE = 750

# Event names.
VENT_START = "vent start time"
VENT_STOP = "vent stop time"

# The unit studied and the other intensive care units.
STUDY_UNIT = "Cullen 2 E Medical Intensive Care Unit"
OTHER_UNITS = (
    "Hermann 3 Shock Trauma Intensive Care Unit",
    "Hermann 3 Transplant Surgical ICU",
    "HVI Cardiac Care Unit",
    "HVI Cardiovascular Intensive Care Unit",
    "Jones 7 J Elective Neuro ICU",
    "Jones 8 W Burn Unit",
)

# Exclusion markers.
DIRECT_ADMISSION = "Direct"
POSITIVE = "Positive"
PROBLEM_PHRASES = ("Alcohol Withdrawal", "Comfort Care", "Hypothermia")
TRACHEOSTOMY_CODES = ("31.1", "31.21", "31.29", "31.72", "31.74", "97.37")

# Exclusion code set (disease state, type, code).
EXCLUSION_CODES = (
    ("pregnant", "CCS", "177"),
    ("pregnant", "CCS", "178"),
    ("pregnant", "CCS", "179"),
    ("pregnant", "CCS", "180"),
    ("pregnant", "CCS", "181"),
    ("pregnant", "CCS", "182"),
    ("pregnant", "CCS", "183"),
    ("pregnant", "CCS", "184"),
    ("pregnant", "CCS", "185"),
    ("pregnant", "CCS", "186"),
    ("pregnant", "CCS", "187"),
    ("pregnant", "CCS", "188"),
    ("pregnant", "CCS", "189"),
    ("pregnant", "CCS", "190"),
    ("pregnant", "CCS", "191"),
    ("pregnant", "CCS", "192"),
    ("pregnant", "CCS", "193"),
    ("pregnant", "CCS", "194"),
    ("pregnant", "CCS", "195"),
    ("pregnant", "CCS", "196"),
    ("etoh", "ICD9", "291.81"),
    ("arrest", "ICD9", "427.5"),
    ("status.ep", "ICD9", "345.3"),
    ("trach", "ICD9", "V44.0"),
    ("trach", "ICD9", "V55.0"),
    ("trach", "ICD9", "519"),
    ("trach", "ICD9", "519.01"),
    ("trach", "ICD9", "519.02"),
    ("trach", "ICD9", "519.09"),
)

# Past medical history code set (disease state, type, code).
HISTORY_CODES = (
    ("ckd", "ICD9", "585.1"),
    ("ckd", "ICD9", "585.2"),
    ("ckd", "ICD9", "585.3"),
    ("ckd", "ICD9", "585.4"),
    ("ckd", "ICD9", "585.9"),
    ("ckd", "ICD9", "585.5"),
    ("ckd", "ICD9", "585.6"),
    ("ckd", "ICD9", "V45.11"),
    ("arf", "CCS", "157"),
    ("liver", "CCS", "6"),
    ("copd", "CCS", "127"),
    ("hypertension", "CCS", "98"),
    ("hypertension", "CCS", "99"),
    ("diabetes", "CCS", "49"),
    ("diabetes", "CCS", "50"),
    ("heart.failure", "CCS", "108"),
    ("asthma", "CCS", "128"),
    ("liver", "CCS", "151"),
    ("seizure", "CCS", "83"),
    ("dementia", "CCS", "653"),
)
HISTORY_STATES = (
    "arf", "asthma", "ckd", "copd", "dementia", "diabetes", "heart.failure", "hypertension", "liver", "seizure",
)

# Home medication classes; a later tier never claims an earlier tier's member.
HOME_MED_TIERS = {
    "benzodiazepines": 0,
    "narcotic analgesic combinations": 0,
    "narcotic analgesics": 0,
    "antidepressants": 0,
    "antipsychotics": 0,
    "anticonvulsants": 1,
    "gamma-aminobutyric acid analogs": 0,
}
HOME_MED_MERGE = (("combinations", "narcotic analgesics"),)
HOME_MED_LEVELS = (
    "benzodiazepines",
    "narcotic analgesics",
    "antidepressants",
    "antipsychotics",
    "anticonvulsants",
    "gamma-aminobutyric acid analogs",
)

# Measurements and liver test limits.
WEIGHT = ("Weight", "kg")
HEIGHT = ("Height", "cm")
LIVER_LIMITS = {"AST": 75.0, "ALT": 81.0}

# Severity inputs, raw name to output name.
LAB_RELABEL = {"poc a po2": "pao2"}
SEVERITY_LABS = {
    "creatinine lvl": "scr",
    "glasgow coma score": "gcs",
    "pao2": "pao2",
    "poc a ph": "ph",
    "poc a pco2": "pco2",
    "potassium lvl": "k",
    "sodium lvl": "na",
    "wbc": "wbc",
    "hct": "hct",
    "fio2 (%)": "fio2",
}
VITAL_RULES = (("Temperature", "Temperature"), ("Mean Arterial Pressure", "Mean Arterial Pressure"))
SEVERITY_VITALS = {
    "Apical Heart Rate": "hr",
    "Mean Arterial Pressure": "map",
    "Respiratory Rate": "rr",
    "Temperature": "temp",
}

# Assessments and exposure.
SEDATION_SCORE = "RASS Score"
DELIRIUM_SCREEN = "(CAM-ICU) Interpretation"
EXPOSURE_DRUGS = ("midazolam", "lorazepam")
GROUP_LABELS = ("BZD", "No BZD")
