"""Exposure from irregularly sampled rates: area, active time, averages, doses, units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.aggregates import row_sum, sum_strict
from cohortline.functions.clean import col, ratio
from cohortline.functions.timing import hours_between, time_slot
from cohortline.operators.joins import drop_in

# Fixed values: (drug, unit, factor, power of body weight) applied to a recorded rate.
RATE_CONVERSIONS = (
    ("ketamine", "mg/hr", 1.0, -1),
    ("fentanyl", "mg/hr", 1000.0, 0),
    ("fentanyl", "microgram/kg/min", 60.0, 0),
)

# Fixed values: (drug, factor, power of body weight) turning an area into a total dose.
DOSE_SCALES = (
    ("propofol", 60.0 / 1000.0, 1),
    ("dexmedetomidine", 1.0, 1),
    ("ketamine", 1.0, 1),
)


def _scaled(value: Column, factor: float, weight: Column, power: int) -> Column:
    scaled = value * F.lit(float(factor))
    if power == 0:
        return scaled
    if power > 0:
        return scaled * F.pow(weight, F.lit(float(power)))
    return F.try_divide(scaled, F.pow(weight, F.lit(float(-power))))


def convert_rate(
    drug: Column | str,
    unit: Column | str,
    rate: Column | str,
    weight: Column | str,
    conversions: Sequence[tuple[str, str, float, int]] = RATE_CONVERSIONS,
) -> Column:
    """Rate in the drug's standard unit; unlisted pairs and unknown units are unchanged.

    ``conversions`` is a handful of rows the user can edit, so it becomes one CASE
    expression and no join.
    """
    name, out = F.lower(col(drug)), col(rate)
    for d, u, factor, power in conversions:
        hit = (name == d) & (col(unit) == u)
        out = F.when(hit, _scaled(col(rate), factor, col(weight), power)).otherwise(out)
    return out


def total_dose(
    drug: Column | str,
    area: Column | str,
    weight: Column | str,
    scales: Sequence[tuple[str, float, int]] = DOSE_SCALES,
) -> Column:
    """Total amount given, from the area under the rate curve."""
    name, out = F.lower(col(drug)), col(area)
    for d, factor, power in scales:
        out = F.when(name == d, _scaled(col(area), factor, col(weight), power)).otherwise(out)
    return out


def rate_exposure(
    samples: DataFrame,
    keys: Sequence[str],
    ts: str,
    rate: str,
    unit: str | None = None,
    tie: str | None = None,
    slot_hours: float = 1.0,
) -> DataFrame:
    """Area under a sampled rate and the time it was running, per series.

    Returns ``keys, dose_auc, cont_duration, time_wt_avg_rate`` for series whose area and
    running time are both positive.

    A sample without a unit counts only at the series' last timestamp. Samples at one
    timestamp are averaged for the area; null rates are left out of it. An interval
    counts as running time if the rate at its start was positive; among samples at one
    timestamp the one with the largest ``tie`` decides (any positive one without ``tie``).

    Areas and times add up, so each ``(series, time slot)`` is summed on its own and
    reduced to one row with its border samples. A second window over those rows, at most
    one per slot, adds the intervals that cross slots. No series is sorted in one task.
    """
    keys = list(keys)
    has_unit = col(unit).isNotNull() if unit else F.lit(True)
    start_rate = F.max_by(col(rate), F.when(has_unit, col(tie))) if tie else F.max(F.when(has_unit, col(rate)))
    points = (
        samples.filter(col(ts).isNotNull())
        .groupBy(*keys, col(ts).alias("t"))
        .agg(
            F.bool_or(has_unit).alias("kept"),
            F.avg(F.when(has_unit, col(rate))).alias("r"),
            F.avg(col(rate)).alias("r_if_last"),
            start_rate.alias("start"),
        )
        .withColumn("slot", time_slot("t", slot_hours))
    )
    totals = _add_borders(_sum_slots(points, keys), keys)
    return (
        totals.filter("dose_auc > 0 AND cont_duration > 0")
        .withColumn("time_wt_avg_rate", ratio("dose_auc", "cont_duration"))
    )


def _area(r0: Column, r1: Column, t0: Column, t1: Column) -> Column:
    return F.lit(0.5) * (r0 + r1) * hours_between(t0, t1)


def _previous(value: Column, w) -> Column:
    """Nearest earlier non-null value in the window's order."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def _sum_slots(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row per slot: sums as an inner slot and as the last one, and border samples."""
    w = Window.partitionBy(*keys, "slot").orderBy("t")
    # Only a slot's last sample can be the series' last, so the rest follow the plain rule.
    rows = points.withColumn("tail", F.lead("t").over(w).isNull()).filter("kept OR tail")
    rows = rows.withColumn("r_end", F.when(F.col("tail"), F.col("r_if_last")).otherwise(F.col("r")))
    rows = rows.withColumns(
        {
            "prev_r": _previous(F.when(F.col("r").isNotNull(), F.struct("t", "r")), w),
            "prev_t": F.lag("t").over(w),
            "prev_start": F.lag("start").over(w),
        }
    )
    ran = F.when(F.col("prev_start") > 0, hours_between("prev_t", "t"))
    rows = rows.withColumns(
        {
            "area": _area(F.col("prev_r.r"), F.col("r"), F.col("prev_r.t"), F.col("t")),
            "area_end": _area(F.col("prev_r.r"), F.col("r_end"), F.col("prev_r.t"), F.col("t")),
            "ran": F.when(F.col("kept"), ran),
            "ran_end": ran,
        }
    )
    rated, rated_end = F.when(F.col("r").isNotNull(), F.col("t")), F.when(F.col("r_end").isNotNull(), F.col("t"))
    unit_t = F.when(F.col("kept"), F.col("t"))
    return rows.groupBy(*keys, "slot").agg(
        F.sum("area").alias("area"),
        F.sum("area_end").alias("area_end"),
        F.sum("ran").alias("ran"),
        F.sum("ran_end").alias("ran_end"),
        F.min(rated).alias("first_t"),
        F.min_by("r", rated).alias("first_r"),
        F.min(rated_end).alias("first_t_end"),
        F.min_by("r_end", rated_end).alias("first_r_end"),
        F.max(rated).alias("last_t"),
        F.max_by("r", rated).alias("last_r"),
        F.min(unit_t).alias("begin"),
        F.min("t").alias("begin_end"),
        F.max(unit_t).alias("finish"),
        F.max_by("start", unit_t).alias("finish_start"),
    )


def _add_borders(slots: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("slot")
    final = F.lead("slot").over(w).isNull()
    rows = slots.withColumns(
        {
            "final": final,
            "before": _previous(F.when(F.col("last_t").isNotNull(), F.struct("last_t", "last_r")), w),
            "running": _previous(F.when(F.col("finish").isNotNull(), F.struct("finish", "finish_start")), w),
        }
    )

    def pick(name: str) -> Column:
        return F.when(F.col("final"), F.col(f"{name}_end")).otherwise(F.col(name))

    across = _area(F.col("before.last_r"), pick("first_r"), F.col("before.last_t"), pick("first_t"))
    ran_across = F.when(F.col("running.finish_start") > 0, hours_between(F.col("running.finish"), pick("begin")))
    return rows.groupBy(*keys).agg(
        F.sum(row_sum(pick("area"), across)).alias("dose_auc"),
        F.sum(row_sum(pick("ran"), ran_across)).alias("cont_duration"),
    )


def not_also_bolus(continuous: DataFrame, bolus: DataFrame, event_id: str) -> DataFrame:
    """Continuous rows that were not recorded as a bolus as well."""
    return drop_in(continuous, bolus, event_id)


def bolus_totals(bolus: DataFrame, keys: Sequence[str], dose: str, alias: str = "total_bolus_dose") -> DataFrame:
    """Bolus sum per series, null if one dose is unknown."""
    return bolus.groupBy(*keys).agg(sum_strict(dose).alias(alias))


def combine_doses(continuous: DataFrame, bolus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Continuous and bolus totals side by side; a series may have only one of them."""
    return continuous.join(bolus, list(keys), "full").withColumn(
        "total_dose", row_sum("total_cont_dose", "total_bolus_dose")
    )
