"""Ranks over whole tables without one task ever sorting a whole column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.clean import col
from cohortline.session import materialize


def range_buckets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with ``__bucket``, which never decreases in the order of ``columns``.

    Buckets are the ranges of a range partitioning, so their bounds come from a sample of the rows and hold about
    equally many, whatever the values; ``spark.sql.shuffle.partitions`` sets their number. The table is written to the
    shared folder, as a bucket must not change when it is read twice or an executor is lost.
    """
    ranged = df.repartitionByRange(*columns).withColumn("__bucket", F.spark_partition_id())
    return materialize(ranged, "ranges")


def tie_ranks(
    df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per distinct non-null value: how often it occurs and how many are smaller.

    Returns ``keys, value, ties, below, total`` and one conditional count per entry of
    ``counts``. The ordinary rank of a value is ``below + 1``; the mid-rank is
    ``below + (ties + 1) / 2``.

    Ties are counted first (combined on the map side). Distinct values are then ordered inside
    range buckets, and a bucket's start is the sum of the buckets before it. NaN counts as the largest value.
    """
    keys, counts = list(keys), dict(counts or {})
    tied = (
        df.filter(col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("ties"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    )
    tied = range_buckets(tied, [*keys, value])
    in_bucket = Window.partitionBy(*keys, "__bucket").orderBy(value)
    local = tied.withColumn(
        "__below", F.sum("ties").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")
    )
    placed = local.join(_bucket_starts(tied, keys, F.sum("ties")), [*keys, "__bucket"])
    return placed.select(
        *keys, value, "ties", *counts, (F.col("__below") + F.col("__start")).alias("below"), "total"
    )


def group_ranks(df: DataFrame, keys: Sequence[str], value: str, sides: Mapping[str, Column]) -> DataFrame:
    """One row per distinct non-null value with the ranks of several groups of rows at once.

    For each entry of ``sides``, a condition on the rows: ``n_<side>`` (how often the value occurs in it), ``below_<side>`` (how many of
    its values are smaller) and ``total_<side>``. Everything that ranks need of any group, or of all together, follows from these, so
    the values are dealt out once. See :func:`tie_ranks` for how.
    """
    keys = list(keys)
    tied = df.filter(col(value).isNotNull()).groupBy(*keys, value).agg(*[F.count_if(c).alias(f"n_{s}") for s, c in sides.items()])
    tied = range_buckets(tied, [*keys, value])
    in_bucket = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    by_bucket = Window.partitionBy(*keys).orderBy("__bucket")
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = tied.groupBy(*keys, "__bucket").agg(*[F.sum(f"n_{s}").alias(f"__{s}") for s in sides])
    ahead = {f"__start_{s}": F.sum(f"__{s}").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"__{s}") for s in sides}
    starts = starts.withColumns(ahead | {f"total_{s}": F.sum(f"__{s}").over(whole) for s in sides}).drop(*[f"__{s}" for s in sides])
    local = tied.withColumns({f"__upto_{s}": F.sum(f"n_{s}").over(in_bucket) for s in sides})
    placed = local.join(starts, [*keys, "__bucket"])
    below = [(F.col(f"__start_{s}") + F.col(f"__upto_{s}") - F.col(f"n_{s}")).alias(f"below_{s}") for s in sides]
    return placed.select(*keys, value, *[f"n_{s}" for s in sides], *below, *[f"total_{s}" for s in sides])


def _bucket_starts(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    by_bucket = Window.partitionBy(*keys).orderBy("__bucket")
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        df.groupBy(*keys, "__bucket")
        .agg(size.alias("__size"))
        .withColumns(
            {
                "__start": F.sum("__size").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0))
                - F.col("__size"),
                "total": F.sum("__size").over(whole),
            }
        )
        .drop("__size")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key (the usual ``(n - 1) * p`` rule), as named columns."""
    keys = list(keys)
    ranked = tie_ranks(df, keys, value)
    low, parts = {}, []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (F.col("below") <= pos) & (pos < F.col("below") + F.col("ties"))
            parts.append(F.max(F.when(held, col(value).cast("double"))).alias(f"__{name}_{side}"))
        low[name] = p
    picked = ranked.groupBy(*keys).agg(F.max("total").alias("total"), *parts)
    out = []
    for name, p in low.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return picked.select(*keys, *out)


def row_numbers(keys_df: DataFrame, key: str) -> DataFrame:
    """Distinct keys with a 1-based ordinal, in value order."""
    bucketed = range_buckets(keys_df.select(key).filter(col(key).isNotNull()).distinct(), [key])
    w = Window.partitionBy("__bucket").orderBy(key)
    starts = _bucket_starts(bucketed, [], F.count(F.lit(1)))
    return (
        bucketed.withColumn("__rn", F.row_number().over(w))
        .join(starts, "__bucket")
        .select(key, (F.col("__start") + F.col("__rn")).alias("row_no"))
    )


def id_batches(keys_df: DataFrame, key: str, size: int = 750, sep: str = ";") -> DataFrame:
    """The distinct keys in batches of ``size``, each batch joined into one string."""
    numbered = row_numbers(keys_df, key).withColumn("batch", F.floor((F.col("row_no") - 1) / F.lit(size)))
    ids = F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string"))
    return numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("n_ids"), F.array_join(ids, sep).alias("ids"))
