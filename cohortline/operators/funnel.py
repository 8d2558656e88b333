"""Ordered inclusion and exclusion criteria with attrition, and exposure groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.aggregates import any_true
from cohortline.functions.clean import col, labelled
from cohortline.operators.joins import keep_in, with_members

WORD_BITS = 62


@dataclass(frozen=True)
class Criterion:
    """A key set an entity must be in (``include=True``) or must not be in."""

    reason: str
    keys: DataFrame
    include: bool = False


@dataclass(frozen=True)
class Funnel:
    """``status``: every base key with the first criterion it failed (null if none)."""

    base: DataFrame
    key: str
    status: DataFrame
    criteria: tuple[Criterion, ...]

    def cohort(self) -> DataFrame:
        """Base rows of the entities that passed every criterion."""
        return keep_in(self.base, self.status.filter("failed_step IS NULL"), self.key)

    def cohort_keys(self) -> DataFrame:
        return self.status.filter("failed_step IS NULL").select(self.key)

    def attrition(self) -> DataFrame:
        """``step_no, reason, removed, remaining``, one row per criterion, in order."""
        steps = range(1, len(self.criteria) + 1)
        counts = self.status.agg(
            F.count(F.lit(1)).alias("__base"),
            *[F.count_if(F.col("failed_step") == k).alias(f"__r{k}") for k in steps],
        )
        rows, left = [], F.col("__base")
        for k, criterion in zip(steps, self.criteria):
            left = left - F.col(f"__r{k}")
            rows.append(
                F.struct(
                    F.lit(k).alias("step_no"),
                    F.lit(criterion.reason).alias("reason"),
                    F.col(f"__r{k}").alias("removed"),
                    left.alias("remaining"),
                )
            )
        return counts.select(F.inline(F.array(*rows)))


def cohort_funnel(base: DataFrame, criteria: Sequence[Criterion], key: str) -> Funnel:
    """Apply ordered criteria in one aggregation instead of a chain of joins.

    Base keys and every criterion's keys are tagged with a bit and unioned; a bitwise OR
    per key, combined on the map side, then holds all the memberships of the entity. Beyond 62 criteria the
    bits go on in further columns, so there is no limit.
    """
    criteria = tuple(criteria)
    if not criteria:
        raise ValueError("no criteria given")
    words = [f"__bits{w}" for w in range(1 + len(criteria) // WORD_BITS)]

    def tags(df: DataFrame, number: int) -> DataFrame:
        word, bit = divmod(number, WORD_BITS)
        values = [F.lit(1 << bit if w == word else 0).cast("bigint").alias(name) for w, name in enumerate(words)]
        return df.select(F.col(key).alias(key), *values)

    def has(number: int) -> Column:
        word, bit = divmod(number, WORD_BITS)
        return F.col(words[word]).bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0

    tagged = _union([tags(base, 0), *[tags(c.keys, k) for k, c in enumerate(criteria, start=1)]])
    bits = tagged.groupBy(key).agg(*[F.bit_or(w).alias(w) for w in words])
    failures = [F.when(~has(k) if c.include else has(k), F.lit(k)) for k, c in enumerate(criteria, start=1)]
    status = bits.filter(has(0)).select(key, F.coalesce(*failures).alias("failed_step"))
    return Funnel(base, key, status, criteria)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of the frames, paired up so that plans of very many stay shallow."""
    while len(frames) > 1:
        frames = [a.union(b) for a, b in zip(frames[::2], frames[1::2])] + list(frames[len(frames) // 2 * 2 :])
    return frames[0]


def join_losses(members: DataFrame, parts: Sequence[tuple[str, DataFrame]], key: str) -> Funnel:
    """Who would leave a chain of inner joins, and at which one.

    ``parts`` are the joined tables by name, in order. Every member is tagged with the first part it has no row in, in the one
    aggregation of :func:`cohort_funnel`; :meth:`Funnel.attrition` counts them and :meth:`Funnel.cohort` is who stays.
    """
    return cohort_funnel(members, [Criterion(name, rows, include=True) for name, rows in parts], key)


def exposure_group(
    cohort: DataFrame,
    exposures: DataFrame,
    key: str,
    exposed_when: Column,
    labels: tuple[str, str] = ("exposed", "unexposed"),
) -> DataFrame:
    """Each cohort member with ``exposed`` (any exposure row qualifies) and its ``group`` label."""
    hits = exposures.select(key, exposed_when.alias("__hit"))
    return (
        with_members(cohort, hits, key)
        .groupBy(key)
        .agg(F.bool_or("__member").alias("__member"), any_true("__hit").alias("exposed"))
        .filter("__member")
        .select(key, "exposed", labelled("exposed", *labels).alias("group"))
    )


def listed_drug_given(drug: Column | str, duration: Column | str, drugs: Sequence[str]) -> Column:
    """A listed drug (any case) with a known continuous duration."""
    return F.lower(col(drug)).isin(*drugs) & col(duration).isNotNull()
