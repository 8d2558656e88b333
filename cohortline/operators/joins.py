"""Key-set joins, interval joins, first row per key, supplements.

Two rules keep these safe when one key holds a large share of the rows. Key sets are
reduced to distinct keys before they are joined, so copies never multiply or pile up. Range conditions are
either folded into per-key minima and maxima, or joined on ``(key, time cell)``, so no
key's rows have to meet in one task and no pairs are built only to be thrown away.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.clean import col
from cohortline.functions.timing import time_slot


def _names(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def distinct_keys(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Distinct keys, combined on the map side.

    Grouping by an extra hash of the keys changes nothing in the result, but makes the
    join that follows shuffle the keys itself, which is what adaptive execution needs to
    split a hot key on the other side.
    """
    keys = _names(on)
    return df.select(*keys, F.xxhash64(*keys).alias("__h")).distinct().select(*keys)


def _key_match(left: DataFrame, right: DataFrame, on: list[str], null_safe: bool) -> Column:
    def eq(k: str) -> Column:
        return left[k].eqNullSafe(right[k]) if null_safe else left[k] == right[k]

    return reduce(lambda a, b: a & b, [eq(k) for k in on])


def _key_join(left: DataFrame, right: DataFrame, on, how: str, null_safe: bool) -> DataFrame:
    names = _names(on)
    keys = distinct_keys(right, names)
    if not null_safe:
        return left.join(keys, names, how)
    return left.join(keys, _key_match(left, keys, names, True), how)


def keep_in(left: DataFrame, right: DataFrame, on: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return _key_join(left, right, on, "left_semi", null_safe)


def drop_in(left: DataFrame, right: DataFrame, on: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``; null keys are kept unless ``null_safe``."""
    return _key_join(left, right, on, "left_anti", null_safe)


def first_row(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The whole first row of each key.

    Spark prunes a ``row_number`` filter to one row per key on the map side, so a hot key
    sends one row per input partition.
    """
    w = Window.partitionBy(*_names(key)).orderBy(*[col(o) for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def span_cells(spans: DataFrame, start: str, end: str, slot_hours: float) -> DataFrame:
    """Spans with ``__level`` and ``__cell``: the one or two cells of ``2^level`` slots that hold the span.

    The level is the least whose cells are as wide as the span, so any span, however long, is two rows at most.
    Spans with an unknown end or one before their start are left out.
    """
    first, last = time_slot(start, slot_hours), time_slot(end, slot_hours)
    apart = F.col("__last") - F.col("__first")
    level = F.when(apart <= 1, F.lit(0)).otherwise(F.length(F.bin(apart - 1)))
    sized = spans.filter(col(start) <= col(end)).withColumns({"__first": first, "__last": last}).withColumn("__level", level)
    cells = F.expr("sequence(shiftright(__first, __level), shiftright(__last, __level))")
    return sized.withColumn("__cell", F.explode(cells)).drop("__first", "__last")


def within_span(
    events: DataFrame,
    spans: DataFrame,
    key: str,
    ts: str,
    start: str,
    end: str,
    slot_hours: float = 1.0,
) -> DataFrame:
    """Each event joined to each span of its key with ``start <= ts <= end``.

    Time is cut into cells of 1, 2, 4 ... slots. A span lies in at most two cells of the width that fits it, from
    minutes to centuries, and an event probes one cell of each width that some span has: the join is on
    ``(key, width, cell)``. A key with a third of all events is spread over its cells, and a span meets at most four times the time it covers;
    a cell that is still too full is split by adaptive execution. The widths in use, some dozens at most, are one scalar subquery.
    """
    cells = span_cells(spans, start, end, slot_hours)
    levels = cells.agg(F.collect_set("__level").alias("levels")).scalar()
    probes = events.withColumn("__levels", levels).withColumn("__level", F.explode("__levels")).drop("__levels")
    probes = probes.withColumn("__slot", time_slot(ts, slot_hours)).withColumn("__cell", F.expr("shiftright(__slot, __level)"))
    return (
        probes.drop("__slot")
        .join(cells, [key, "__level", "__cell"])
        .filter(col(ts).between(col(start), col(end)))
        .drop("__level", "__cell")
    )


def keys_before_reference(df: DataFrame, key: str, ts: str, is_event: Column, is_reference: Column) -> DataFrame:
    """Keys that have some event row earlier than some reference row.

    "Some earlier than some" is "earliest before latest", so one aggregation answers it.
    """
    return (
        df.groupBy(key)
        .agg(
            F.min(F.when(is_event, col(ts))).alias("__first_event"),
            F.max(F.when(is_reference, col(ts))).alias("__last_reference"),
        )
        .filter("__first_event < __last_reference")
        .select(key)
    )


def keys_outside_span(
    episodes: DataFrame, spans: DataFrame, key: str, start: str, stop: str, arrive: str, depart: str
) -> DataFrame:
    """Keys with an episode that ended before a span began or began after a span ended.

    An open stop or depart time is unknown and cannot satisfy its half of the test.
    """
    rows = episodes.select(
        key, col(start).alias("__start"), col(stop).alias("__stop"),
        F.lit(None).cast("timestamp_ntz").alias("__arrive"), F.lit(None).cast("timestamp_ntz").alias("__depart"),
    ).unionByName(
        spans.select(
            key, F.lit(None).cast("timestamp_ntz").alias("__start"), F.lit(None).cast("timestamp_ntz").alias("__stop"),
            col(arrive).alias("__arrive"), col(depart).alias("__depart"),
        )
    )
    return (
        rows.groupBy(key)
        .agg(
            F.min("__stop").alias("__stop"), F.max("__start").alias("__start"),
            F.max("__arrive").alias("__arrive"), F.min("__depart").alias("__depart"),
        )
        .filter("__stop < __arrive OR __start > __depart")
        .select(key)
    )


def add_missing(primary: DataFrame, secondary: DataFrame, on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """All primary rows, and the secondary rows whose composite key the primary lacks."""
    return primary.unionByName(drop_in(secondary, primary, on, null_safe), allowMissingColumns=True)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_members(cohort: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` and one marker row per cohort key, flagged in ``__member``.

    Grouping this by the key and keeping the groups with a marker completes the cohort
    (members without rows stay, rows of non-members go) in one aggregation and no join.
    """
    marks = cohort.select(key, F.lit(True).alias("__member"))
    return rows.withColumn("__member", F.lit(False)).unionByName(marks, allowMissingColumns=True)
