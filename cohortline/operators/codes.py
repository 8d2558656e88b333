"""Code sets and drug classes: from a short specification to entity flags.

Code sets and class members carry no broadcast hint. They come from small files, whose
size Spark checks: below its limit they are broadcast and the big side is joined in the
scan, its repeated pairs combined before the only shuffle; above it the join is a sort
merge that adaptive execution splits at a common code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_frame(spark, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A small all-string lookup table given as literals in code."""
    cells = [F.struct(*[F.lit(v).alias(c) for v, c in zip(row, columns)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def expand_codes(spec: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Concrete codes of a specification ``(disease_state, type, code)``.

    ``ICD9`` rows name a code; ``CCS`` rows name a category, resolved through
    ``crosswalk (ccs, icd9_code)``. Codes are text and compared exactly.
    """
    direct = spec.filter("type = 'ICD9'").select("disease_state", F.col("code").alias("icd9_code"))
    grouped = (
        spec.filter("type = 'CCS'")
        .join(crosswalk, F.col("code") == F.col("ccs"))
        .select("disease_state", "icd9_code")
    )
    return direct.unionByName(grouped).distinct()


def code_states(
    diagnoses: DataFrame,
    codes: DataFrame,
    key: str,
    code: str,
    final_only: tuple[str, str] | None = None,
) -> DataFrame:
    """Distinct ``(key, disease_state)`` of the diagnoses whose code is in the expanded set.

    ``final_only`` is ``(column, value)``, such as ``("diag_type", "Final")``.
    """
    rows = diagnoses if final_only is None else diagnoses.filter(F.col(final_only[0]) == final_only[1])
    coded = rows.select(key, F.col(code).alias("icd9_code"))
    return coded.join(codes, "icd9_code").select(key, "disease_state").distinct()


def keys_with_codes(diagnoses: DataFrame, codes: DataFrame, key: str, code: str) -> DataFrame:
    """Distinct keys with at least one diagnosis in the set."""
    return code_states(diagnoses, codes, key, code).select(key).distinct()


def class_members(
    membership: DataFrame,
    tiers: Mapping[str, int],
    cls: str = "med_class",
    member: str = "med_name",
) -> DataFrame:
    """Members of the listed classes, where a later tier never claims a member of an earlier one.

    Classes of one tier may share members. Names are compared as given and lower-cased
    in the result.
    """
    tier = F.coalesce(*[F.when(F.col(cls) == name, F.lit(t)) for name, t in tiers.items()])
    ranked = (
        membership.select(cls, member).distinct().withColumn("__tier", tier).filter("__tier IS NOT NULL")
    )
    best = F.min("__tier").over(Window.partitionBy(member))
    return (
        ranked.withColumn("__best", best)
        .filter("__tier = __best")
        .select(cls, F.lower(member).alias(member))
        .distinct()
    )


def class_rows(rows: DataFrame, members: DataFrame, key: str, name: str, member: str = "med_name") -> DataFrame:
    """Distinct ``(key, class)`` of the rows whose name belongs to a class."""
    classes = [c for c in members.columns if c != member]
    named = rows.select(key, F.col(name).alias(member))
    return named.join(members, member).select(key, *classes).distinct()
