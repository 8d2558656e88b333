"""Runs of equal consecutive events, and unit stays built from location rows.

A plain window over an entity would sort all its rows in one task. Here copies of a row
are merged first, on the map side, and rows are then windowed per ``(entity, time slot)``. Runs that lie wholly inside a slot are finished there; only
the first and the last two runs of each slot, at most three rows, go on to a second,
small window per entity that joins them across slot borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.aggregates import sum_strict
from cohortline.functions.clean import col
from cohortline.functions.timing import days_between, hours_between, time_slot


def collapse_runs(
    rows: DataFrame,
    key: str,
    event: str,
    ts: str,
    tie: Sequence[str] = (),
    slot_hours: float = 1.0,
    maxima: Mapping[str, str] | None = None,
    ends: DataFrame | None = None,
) -> DataFrame:
    """One row per run: its first and last timestamp, those of the run after it, ``maxima``.

    Returns ``key, event, first_ts, last_ts, next_first_ts, next_last_ts`` and the maxima;
    the ``next_`` columns are null on an entity's last run.
    Rows are ordered by ``ts``, then ``tie``, then the event itself; rows with a null
    timestamp or event are dropped. ``maxima`` maps output names to columns whose
    per-run maximum is kept. ``ends``, one row per key, adds its columns to the runs that
    have no following run; the other runs carry nulls there.
    """
    maxima = dict(maxima or {})
    order = [ts, *[t for t in tie if t not in (event, ts)], event]
    in_slot = Window.partitionBy(key, "__slot").orderBy(*order)

    changed = ~F.lag(event).over(in_slot).eqNullSafe(col(event))
    # A row's copies belong to its run and change none of the results.
    merged = (
        rows.filter(col(ts).isNotNull() & col(event).isNotNull())
        .groupBy(key, *order)
        .agg(F.count(F.lit(1)).alias("__copies"), *[F.max(c).alias(name) for name, c in maxima.items()])
    )
    numbered = (
        merged.withColumn("__slot", time_slot(ts, slot_hours))
        .withColumn("__new", changed.cast("int"))
        .withColumn("__run", F.sum("__new").over(in_slot.rowsBetween(Window.unboundedPreceding, 0)))
    )
    pieces = numbered.groupBy(key, "__slot", "__run", event).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[F.max(name).alias(name) for name in maxima],
    )
    by_run = Window.partitionBy(key, "__slot").orderBy("__run")
    whole_slot = by_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pieces = pieces.withColumns(
        {
            "__runs": F.max("__run").over(whole_slot),
            "next_first_ts": F.lead("first_ts").over(by_run),
            "next_last_ts": F.lead("last_ts").over(by_run),
        }
    )
    inside = (F.col("__run") >= 2) & (F.col("__run") <= F.col("__runs") - 2)
    output = [key, event, "first_ts", "last_ts", "next_first_ts", "next_last_ts", *maxima]

    # The following run may go on in the next slot unless it, too, ends inside this one.
    follower_known = F.col("__run") + 1 < F.col("__runs")
    edges = pieces.filter(~inside).withColumns(
        {c: F.when(follower_known, F.col(c)) for c in ("next_first_ts", "next_last_ts")}
    )
    border = _join_edges(edges, key, event, maxima)
    if ends is not None:
        tail = [c for c in ends.columns if c != key]
        looked_up = border.join(ends, key, "left")
        border = looked_up.withColumns({c: F.when(F.col("next_last_ts").isNull(), F.col(c)) for c in tail})
        output = output + tail
    return pieces.filter(inside).unionByName(border, allowMissingColumns=True).select(*output)


def _join_edges(edges: DataFrame, key: str, event: str, maxima: Mapping[str, str]) -> DataFrame:
    in_order = Window.partitionBy(key).orderBy("__slot", "__run")
    # Runs of one slot are apart by construction, so only a slot's first run can continue one.
    goes_on = (F.col("__run") == 1) & F.lag(event).over(in_order).eqNullSafe(col(event))
    grouped = edges.withColumn("__new", (~goes_on).cast("int")).withColumn(
        "__group", F.sum("__new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = grouped.groupBy(key, "__group", event).agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("next_first_ts").alias("next_first_ts"),
        F.max("next_last_ts").alias("next_last_ts"),
        *[F.max(name).alias(name) for name in maxima],
    )
    by_group = Window.partitionBy(key).orderBy("__group")
    return merged.withColumns(
        {
            "next_first_ts": F.coalesce(F.col("next_first_ts"), F.lead("first_ts").over(by_group)),
            "next_last_ts": F.coalesce(F.col("next_last_ts"), F.lead("last_ts").over(by_group)),
        }
    ).drop("__group")


def run_episodes(
    rows: DataFrame,
    key: str,
    event: str,
    ts: str,
    start_event: str,
    end_time: DataFrame | Column | None = None,
    tie: Sequence[str] = (),
    slot_hours: float = 1.0,
    stop_at: str = "last",
) -> DataFrame:
    """Episodes that begin with a run of ``start_event`` and stop with the run after it.

    Returns ``key, start_datetime, stop_datetime, duration_hours``. The stop is the last
    timestamp of the next run, or its first with ``stop_at="first"``. An open episode keeps a null stop; its duration runs to
    ``end_time``: a fixed timestamp column, or a frame ``(key, end_datetime)``.
    """
    if stop_at not in ("first", "last"):
        raise ValueError(f"stop_at must be 'first' or 'last', not {stop_at!r}")
    stop = f"next_{stop_at}_ts"
    per_key = end_time if isinstance(end_time, DataFrame) else None
    if per_key is not None:
        per_key = per_key.select(key, "end_datetime")
    runs = collapse_runs(rows, key, event, ts, tie, slot_hours, ends=per_key)
    if per_key is not None:
        fallback: Column = F.col("end_datetime")
    else:
        fallback = end_time if end_time is not None else F.lit(None).cast("timestamp_ntz")
    return runs.filter(F.col(event) == start_event).select(
        key,
        F.col("first_ts").alias("start_datetime"),
        F.col(stop).alias("stop_datetime"),
        hours_between("first_ts", F.coalesce(F.col(stop), fallback)).alias("duration_hours"),
    )


def keys_with_long_episode(episodes: DataFrame, key: str, min_hours: float) -> DataFrame:
    return episodes.filter(F.col("duration_hours") >= min_hours).select(key).distinct()


def total_duration(episodes: DataFrame, key: str, alias: str = "duration_hours") -> DataFrame:
    """Sum of an entity's episode durations, null if one of them is unknown."""
    return episodes.groupBy(key).agg(sum_strict("duration_hours").alias(alias))


def unit_stays(
    rows: DataFrame,
    key: str,
    location: str,
    arrive: str,
    depart: str,
    tie: Sequence[str] = (),
    slot_hours: float = 1.0,
) -> DataFrame:
    """One row per contiguous stay in a location, with its length in days."""
    runs = collapse_runs(rows, key, location, arrive, tie, slot_hours, maxima={"depart_datetime": depart})
    return runs.select(
        key,
        location,
        F.col("first_ts").alias("arrive_datetime"),
        "depart_datetime",
        days_between("first_ts", "depart_datetime").alias("length_days"),
    )


def keys_with_repeat_stays(stays: DataFrame, key: str, location: str, unit: str) -> DataFrame:
    """Keys with more than one stay in the unit."""
    return (
        stays.filter(F.col(location) == unit)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_stays"))
        .filter("n_stays > 1")
    )
