"""Extract files, lookups, landing and result tables."""

from __future__ import annotations

import gzip
from types import SimpleNamespace

import pytest

from cohortline.functions import clean, columns, timing
from cohortline.plans import fixed_values as fv
from cohortline.session import materialize, shared_folder
from cohortline.sources import extracts as ex
from tests.conftest import rows, ts


def test_extract_files_are_read_as_text_and_typed(spark, tmp_path):
    head = "PowerInsight Encounter Id,Clinical Event,Clinical Event End Date/Time,Infusion Rate,Infusion Rate Unit,Event ID,Extra\n"
    (tmp_path / "cont_meds_1.csv").write_text(head + "001,Fentanyl,1/2/2015 3:04:05,0.50,mg/hr,7,x\n")
    with gzip.open(tmp_path / "cont_meds_2.csv.gz", "wt") as f:
        f.write(head + "002,Propofol,01/12/2015 13:04:05,>75,,8,x\n003,Propofol,bad,NaN,mg/hr,9,x\n")
    (tmp_path / "other.csv").write_text("a\n1\n")
    df = ex.read_extract(spark, str(tmp_path), ex.MEDS_CONT)
    assert df.columns == ["pie_id", "med", "med_datetime", "rate", "rate_unit", "event_id"]
    assert rows(df) == [
        ("001", "fentanyl", ts("01-02 03:04:05"), 0.5, "mg/hr", "7"),
        ("002", "propofol", ts("01-12 13:04:05"), None, None, "8"),
        ("003", "propofol", None, None, "mg/hr", "9"),
    ]


def test_one_layout_serves_several_files(spark, tmp_path):
    (tmp_path / "paralytics.csv").write_text("pie.id,med.rate.units\n1,mg/hr\n2,\n")
    df = ex.read_extract(spark, str(tmp_path), ex.MEDS_CONTINUOUS, "paralytics")
    assert df.filter(df.med_rate_units != "").count() == 1


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "mpp.csv").write_text("pie.id,other\n1,x\n")
    with pytest.raises(ValueError, match="mpp"):
        ex.read_extract(spark, str(tmp_path), ex.MPP)


def test_lookup_keeps_codes_as_text(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("disease.state,type,code\ntrach,ICD9,519\ntrach,ICD9,31.10\nckd,ICD9,V45.11\n")
    df = ex.read_lookup(spark, str(path))
    assert df.columns == ["disease_state", "type", "code"]
    assert {r.code for r in df.collect()} == {"519", "31.10", "V45.11"}


def test_tables_go_out_and_come_back(spark, frame, tmp_path):
    df = frame([("a", 1.5), ("b", None)], "k string, v double")
    path = ex.write_table(df, str(tmp_path), "out")
    assert rows(ex.read_text_csv(spark, path)) == [("a", "1.5"), ("b", None)]
    ex.write_table(df, str(tmp_path), "saved", "parquet")
    assert rows(ex.use_or_load(spark, {}, "saved", str(tmp_path))) == rows(df)
    assert ex.use_or_load(spark, {"saved": df}, "saved", "/nowhere") is df
    ex.land(df, str(tmp_path / "landed"), partition_by=["k"], files_by=["k"])
    assert (tmp_path / "landed" / "k=a").is_dir()
    with pytest.raises(ValueError):
        ex.write_table(df, str(tmp_path), "x", "xlsx")


def test_materialized_table_starts_a_new_plan(frame):
    df = frame([(1,), (2,)], "k long").groupBy("k").count()
    kept = materialize(df, "counts")
    assert rows(kept) == rows(df)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_quotes_line_breaks_and_lab_files(spark, tmp_path):
    head = "PowerInsight Encounter Id,Clinical Event,Clinical Event Result,Clinical Event End Date/Time\n"
    for i, name in enumerate(["labs.csv", "labs1.csv", "labs-a.csv", "labs_exclude.csv", "labs.txt"]):
        (tmp_path / name).write_text(head + f'{i},"two\nlines, ""quoted""",1,01/02/2015 03:04:05\n')
    df = ex.read_extract(spark, str(tmp_path), ex.LABS)
    assert sorted((r.pie_id, r.lab) for r in df.collect()) == [(str(i), 'two\nlines, "quoted"') for i in range(3)]
    path = ex.write_table(df.select("pie_id", "lab"), str(tmp_path), "out")
    assert ex.read_text_csv(spark, path).exceptAll(df.select("pie_id", "lab")).count() == 0


def test_shared_folder_follows_the_setting():
    def session(master, **settings):
        conf = SimpleNamespace(get=lambda key, default=None: settings.get("folder", default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("yarn", folder="hdfs://x/named/")) == "hdfs://x/named"
    assert shared_folder(session("local[4]", folder="/named")) == "/named"
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))


def test_numbers_and_nulls(frame):
    texts = ["12.5", " -3e2 ", ">75", "1d", "NaN", "Infinity", "", None, "+.5"]
    df = frame([(t,) for t in texts], "x string")
    assert [r.v for r in df.select(clean.to_number("x").alias("v")).collect()] == [
        12.5, -300.0, None, None, None, None, None, None, 0.5,
    ]
    nan = frame([(float("nan"),), (1.0,)], "x double").select(clean.not_nan("x").alias("v"))
    assert [r.v for r in nan.collect()] == [None, 1.0]


def test_columns(frame):
    df = frame([(1, "x", 2.0, "y")], "id long, `b.c` string, 2nd double, d string")
    assert columns.safe_names(df).columns == ["id", "b_c", "x2nd", "d"]
    assert columns.columns_between(df, "b.c", "2nd") == ["b.c", "2nd"]
    assert columns.numeric_columns(df) == ["id", "2nd"] and columns.other_columns(df) == ["b.c", "d"]
    assert columns.front(df.drop("b.c"), "d").columns == ["d", "id", "2nd"]
    with pytest.raises(ValueError):
        columns.columns_between(df, "d", "id")


def test_dates(frame):
    df = frame([("9/1/2015",), ("13/40/2015",)], "x string").select(timing.parse_date("x").alias("v"))
    assert [r.v for r in df.collect()] == [ts("09-01"), None]


def test_fixed_value_sizes():
    assert len(fv.EXCLUSION_CODES) == 29 and len(fv.HISTORY_CODES) == 20 and len(fv.HOME_MED_TIERS) == 7
    assert set(fv.HISTORY_STATES) == {state for state, _, _ in fv.HISTORY_CODES}


def test_bad_rows_are_set_aside_by_file(spark, tmp_path):
    head = "PowerInsight Encounter Id,Clinical Event,Clinical Event End Date/Time,Infusion Rate,Infusion Rate Unit,Event ID\n"
    (tmp_path / "cont_meds_1.csv").write_text(head + '1,"A ""b"",\nc",1/2/2015 3:04:05,1,mg/hr,7\n2,short,1/2/2015 3:04:05\n3,x,1/2/2015 3:04:05,1,mg/hr,8,more\n')
    with gzip.open(tmp_path / "cont_meds_2.csv.gz", "wt") as f:
        f.write(head + "4,Fentanyl,1/2/2015 3:04:05,2,,9\n5,short\n")
    loaded = ex.load_extract(spark, str(tmp_path), ex.MEDS_CONT)
    assert rows(loaded.rows, "pie_id", "med", "rate", "event_id") == [("1", 'a "b",\nc', 1.0, "7"), ("4", "fentanyl", 2.0, "9")]
    assert {r["record"] for r in loaded.bad.collect()} == {"2,short,1/2/2015 3:04:05", "3,x,1/2/2015 3:04:05,1,mg/hr,8,more", "5,short"}
    counts = {r["file"].rsplit("/", 1)[1]: r["n_bad"] for r in loaded.bad_by_file().collect()}
    assert counts == {"cont_meds_1.csv": 2, "cont_meds_2.csv.gz": 1}
    (tmp_path / "cont_meds_3.csv").write_text("Event ID,Other\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        ex.load_extract(spark, str(tmp_path), ex.MEDS_CONT)


def test_landed_tables_join_without_a_shuffle(spark, frame, tmp_path):
    people = frame([(k % 50, f"p{k}") for k in range(200)], "pie_id int, name string")
    stays = frame([(k % 70, k) for k in range(300)], "pie_id int, stay int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ex.land_table(people, "landed_people", "pie_id", str(tmp_path))
        ex.land_table(stays, "landed_stays", "pie_id", str(tmp_path), sort=["stay"])
        tables = [ex.use_or_load(spark, {}, name, "/nowhere") for name in ("landed_people", "landed_stays")]
        joined = tables[0].join(tables[1], "pie_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == people.join(stays, "pie_id").count()
        assert "Exchange" not in tables[0].groupBy("pie_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS landed_people")
        spark.sql("DROP TABLE IF EXISTS landed_stays")


def test_study_from_files_to_files(spark, frame, tmp_path):
    from cohortline.plans import study_files

    for name, (spec, prefix) in study_files.STUDY_FILES.items():
        header = ",".join(f'"{raw}"' for raw, _, _ in spec.fields)
        file = prefix or {"labs": "labs2015", "meds_cont": "cont_meds", "meds_bolus": "bolus_meds"}.get(name, name)
        (tmp_path / f"{file}.csv").write_text(header + "\n" + ",".join("1" for _ in spec.fields) + "\nbad" + ",x" * len(spec.fields) + "\n")
    (tmp_path / "manual_review.csv").write_text("FIN,Exclude,Number of Packs/day\n1,,2\n")
    loaded = study_files.load_study(spark, str(tmp_path))
    assert {name: df.count() for name, df in loaded.tables.items()} == {**{name: 1 for name in study_files.STUDY_FILES}, "manual_review": 1}
    assert loaded.tables["manual_review"].columns == ["fin", "exclude", "number_of_packs_day"]
    assert {r["extract"] for r in loaded.bad.collect()} == set(study_files.STUDY_FILES)
    paths = study_files.write_analysis_tables({"pmh": loaded.tables["mpp"]}, str(tmp_path / "out"))
    assert ex.read_text_csv(spark, paths["pmh"]).count() == 1


def test_intermediate_folders_go_although_the_session_has_stopped(tmp_path):
    import subprocess
    import sys

    code = (
        "from cohortline.session import local_session, materialize\n"
        f"spark = local_session('gone', '2', **{{'spark.checkpoint.dir': 'file://{tmp_path}/shared'}})\n"
        "materialize(spark.range(5), 'x').count()\nspark.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    assert not list((tmp_path / "shared").rglob("*.parquet"))
