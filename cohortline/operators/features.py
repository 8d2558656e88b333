"""One row per entity (or entity and day) from long event rows.

Every operator is one hash aggregation with conditional aggregates. Rows are combined on
the map side, so a hot entity reaches the shuffle as one row per input partition, and
wide columns come from a fixed list of levels rather than from a pass over the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.aggregates import any_true, max_strict, min_strict
from cohortline.functions.clean import col
from cohortline.functions.columns import safe_name
from cohortline.functions.timing import day_of
from cohortline.operators.joins import with_members


def _named(levels: Mapping[str, str] | Sequence[str]) -> dict[str, str]:
    return dict(levels) if isinstance(levels, Mapping) else {v: safe_name(v) for v in levels}


def indicator_matrix(
    rows: DataFrame, cohort: DataFrame, key: str, level: str, levels: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """One boolean column per level for every cohort member, false where no row says otherwise.

    ``levels`` is a list of values, or a mapping from value to column name. Levels nobody
    has still get their column; rows of non-members are ignored.
    """
    named = _named(levels)
    return (
        with_members(cohort, rows.select(key, level), key)
        .groupBy(key)
        .agg(
            F.bool_or("__member").alias("__member"),
            *[any_true(F.col(level) == v).alias(n) for v, n in named.items()],
        )
        .filter("__member")
        .drop("__member")
    )


def threshold_flags(
    rows: DataFrame, cohort: DataFrame, key: str, measure: str, value: str, limits: Mapping[str, float]
) -> DataFrame:
    """For every member and measure: was any value above the measure's limit?"""
    over = {m: (F.col(measure) == m) & (F.col(value) > limit) for m, limit in limits.items()}
    return (
        with_members(cohort, rows.select(key, measure, value), key)
        .groupBy(key)
        .agg(
            F.bool_or("__member").alias("__member"),
            *[any_true(test).alias(safe_name(m)) for m, test in over.items()],
        )
        .filter("__member")
        .drop("__member")
    )


def worst_values(
    rows: DataFrame, key: str, measure: str, value: str, measures: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """Smallest and largest value per entity and measure, as ``<name>_min`` and ``<name>_max``."""
    named = _named(measures)
    aggs = []
    for m, name in named.items():
        v = F.when(F.col(measure) == m, F.col(value))
        aggs += [F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]
    known = rows.filter(F.col(measure).isin(*named) & F.col(value).isNotNull())
    return known.groupBy(key).agg(*aggs)


def worst_values_long(rows: DataFrame, key: str, measure: str, value: str) -> DataFrame:
    """The same as rows ``(key, measure, min_value, max_value)``, for open-ended measure sets."""
    return (
        rows.filter(F.col(value).isNotNull())
        .groupBy(key, measure)
        .agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    )


def first_measures(
    rows: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    wanted: Mapping[str, Column],
    require_all: bool = True,
) -> DataFrame:
    """First value per entity for several measures in one scan.

    ``wanted`` maps an output name to the condition that selects its rows. With
    ``require_all`` entities lacking rows for any of them are dropped.
    """
    at = F.struct(*[col(o) for o in order])
    relevant = rows.filter(reduce(lambda a, b: a | b, wanted.values()))
    out = relevant.groupBy(key).agg(
        *[F.min_by(col(value), F.when(test, at)).alias(name) for name, test in wanted.items()],
        *[F.count_if(test).alias(f"__n_{name}") for name, test in wanted.items()],
    )
    if require_all:
        for name in wanted:
            out = out.filter(F.col(f"__n_{name}") > 0)
    return out.select(key, *wanted)


def daily_rollup(
    rows: DataFrame,
    key: str,
    ts: str,
    is_score: Column,
    score: Column,
    is_screen: Column,
    positive: Column,
    names: tuple[str, str, str] = ("min_score", "max_score", "num_positive"),
) -> DataFrame:
    """Per entity and day: score range and number of positive screens.

    Scores and screens are two row kinds of one table, so the two daily summaries and
    their full join are a single aggregation. A day without score rows has a null range,
    and so has one with an unreadable score; a day without screen rows has a null count.
    """
    low, high, count = names
    kinds = rows.select(
        key,
        day_of(ts).alias("day"),
        F.coalesce(is_score, F.lit(False)).alias("__score_row"),
        F.coalesce(is_screen, F.lit(False)).alias("__screen_row"),
        score.alias("__score"),
        positive.alias("__positive"),
    ).filter("__score_row OR __screen_row")
    return kinds.groupBy(key, "day").agg(
        min_strict("__score", F.col("__score_row")).alias(low),
        max_strict("__score", F.col("__score_row")).alias(high),
        F.when(
            F.count_if(F.col("__screen_row")) > 0, F.count_if(F.col("__screen_row") & F.col("__positive"))
        ).alias(count),
    )


def any_positive(daily: DataFrame, key: str, count: str, alias: str) -> DataFrame:
    """Did the entity have a positive screen on any day? Null counts are no."""
    return daily.groupBy(key).agg(any_true(F.col(count) > 0).alias(alias))
