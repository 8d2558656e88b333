"""Value mapping and unit conversion from tables that users keep as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS = 1000


def _patterns(rules: DataFrame) -> list[tuple]:
    """The regex rules in order. They become one expression, so there may be no more than ``MAX_PATTERNS``; more is an error."""
    rows = rules.filter("kind = 'regex'").select("position", "pattern", "name").orderBy("position", "pattern", "name").limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} regular expressions in a mapping table")
    return [tuple(r) for r in rows]


def canonical_by_table(df: DataFrame, column: str, rules: DataFrame, alias: str) -> DataFrame:
    """Adds ``alias``: the name of the first rule, by ``position``, that matches the column; values without a rule pass through.

    ``rules`` has (position, kind, pattern, name). Rows of kind ``exact`` match equal values, by a join, so there may be
    any number of them; rows of kind ``regex`` match anywhere in the value, by one alternation that most values fail at once,
    then by a chain in order. Positions must differ, or the lesser pattern wins. Null stays null. Every distinct value is mapped once.
    """
    first = F.min(F.struct("position", "pattern", "name"))
    exact = rules.filter("kind = 'exact'").groupBy(F.col("pattern").alias("__value")).agg(first.alias("__exact"))
    rule_type = exact.schema["__exact"].dataType
    regex = F.lit(None).cast(rule_type)
    patterns = _patterns(rules)
    if patterns:
        chain = F
        for position, pattern, name in patterns:
            rule = F.struct(F.lit(position).alias("position"), F.lit(pattern).alias("pattern"), F.lit(name).alias("name")).cast(rule_type)
            chain = chain.when(F.col("__value").rlike(pattern), rule)
        regex = F.when(F.col("__value").rlike("|".join(f"(?:{p})" for _, p, _ in patterns)), chain)

    # Grouping by a hash beside the value leaves the join to shuffle by the value, so that a hot value can be split.
    values = df.select(F.col(column).alias("__value")).filter("__value IS NOT NULL").groupBy("__value", F.xxhash64("__value")).count().select("__value")
    # The least of two rules skips the one that is null.
    best = F.least("__exact", "__regex")["name"].alias("__name")
    mapped = values.join(exact, "__value", "left").withColumn("__regex", regex).select("__value", best).filter("__name IS NOT NULL")
    joined = df.withColumn("__value", F.col(column)).join(mapped, "__value", "left")
    return joined.withColumn(alias, F.coalesce("__name", F.col(column))).drop("__value", "__name")


def convert_by_table(df: DataFrame, drug: str, unit: str, rate: str, weight: str, units: DataFrame, alias: str) -> DataFrame:
    """Adds ``alias``: the rate times the factor and the power of body weight that ``units`` lists for drug and unit.

    ``units`` has (drug, unit, factor, weight_power); drugs match in any case. Pairs that are not listed and unknown units leave the rate as
    it is. A pair listed twice ends the query with an error, as it would double rows. A weight of zero under a negative power gives null.
    """
    listed = units.groupBy(F.lower("drug").alias("__drug"), F.col("unit").alias("__unit")).agg(
        F.count(F.lit(1)).alias("n"), F.min("factor").cast("double").alias("__factor"), F.min("weight_power").alias("__power")
    )
    twice = F.raise_error(F.concat(F.lit("listed twice in the unit table: "), "__drug", F.lit(", "), "__unit"))
    listed = listed.withColumn("__factor", F.when(F.col("n") > 1, twice.cast("double")).otherwise(F.col("__factor"))).drop("n")
    found = df.withColumn("__name", F.lower(drug)).join(listed, (F.col("__name") == F.col("__drug")) & (F.col(unit) == F.col("__unit")), "left")
    scaled, power = F.col(rate) * F.coalesce("__factor", F.lit(1.0)), F.coalesce("__power", F.lit(0))
    heavy = F.pow(F.col(weight), F.abs(power).cast("double"))
    standard = F.when(power == 0, scaled).when(power > 0, scaled * heavy).otherwise(F.try_divide(scaled, heavy))
    return found.withColumn(alias, standard).drop("__name", "__drug", "__unit", "__factor", "__power")
