"""Every registered query with an oracle against DuckDB on the given tables."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as driver
from cohortline.queries import clinical

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
BUILDERS, ORACLES = driver.queries(), driver.oracle_sql()


def directory(name):
    # The study needs enough patients to leave some after fourteen criteria, a test per nation enough customers.
    return "/root/testdata/sf0.01" if name.startswith("study_") or name.endswith("_by_nation") else "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connections():
    open_ones = {}

    def get(sf):
        if sf not in open_ones:
            con = duckdb.connect()
            for t in TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
            open_ones[sf] = con
        return open_ones[sf]

    return get


@pytest.fixture(scope="module", autouse=True)
def one_study():
    """The study's steps are taken once per directory, not once per query that reads them."""
    patch, kept = pytest.MonkeyPatch(), {}
    for step in ("_study", "_features"):
        def once(t, step=step, build=getattr(clinical, step)):
            if (step, t.directory) not in kept:
                kept[step, t.directory] = build(t)
            return kept[step, t.directory]

        patch.setattr(clinical, step, once)
    yield
    patch.undo()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, date) and not isinstance(v, datetime):
        return datetime(v.year, v.month, v.day)
    return v


def ordered(names, columns, tuples):
    at = [names.index(c) for c in columns]
    picked = [tuple(plain(r[i]) for i in at) for r in tuples]
    return sorted(picked, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_query(spark, connections, name):
    df = BUILDERS[name](spark, directory(name))
    columns = sorted(df.columns)
    got = ordered(df.columns, columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    result = connections(directory(name)).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == ordered(names, columns, result.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_names_agree():
    assert set(ORACLES) <= set(BUILDERS)
