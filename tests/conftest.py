from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def ts(text: str) -> datetime:
    """'01-05 06:30[:00]' of the year 2015."""
    month_day, _, clock = text.partition(" ")
    parts = [int(x) for x in (clock or "00:00").split(":")]
    month, day = month_day.split("-")
    return datetime(2015, int(month), int(day), *parts)


def rows(df, *cols):
    """Sorted tuples of the frame's rows."""
    picked = [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]
    return sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))
