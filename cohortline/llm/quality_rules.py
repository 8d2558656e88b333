"""Quality rules as a short-circuit cascade, on DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.text import NO_SPACE, whole_text, word_array
from cohortline.session import materialize

WINDOW = 8
SAMPLE_ROWS, PLACES, LEAST_SECONDS = 4000, 10_000_000, 1e-3


@dataclass(frozen=True)
class Rule:
    """``rejects``: whether it rejects a row (null counts as no). ``cost``: what its time grows with, such as characters read."""

    name: str
    rejects: Column
    cost: Column


def add_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``words``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines`` and ``n_repeat_words``.

    ``n_repeat_words`` counts the words covered by 8-word windows that occur twice or more. Window hashes are built by
    doubling (1, 2, 4, 8 words); only texts in which two hashes are equal pay for the sort that finds the covered words.
    Null text has no words. Columns of the input with these names are replaced.
    """
    body = whole_text(text)
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(NO_SPACE))
    counted = docs.withColumns({"words": word_array(body), "_lines": lines}).withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_run": F.transform("words", lambda w: F.xxhash64(w)),
        }
    )
    length = 1
    while length < WINDOW:
        ahead = F.slice(F.col("_run"), F.lit(length + 1), F.size("_run"))
        counted = counted.withColumn("_run", F.zip_with("_run", ahead, lambda a, b: F.xxhash64(a, b)))
        length *= 2
    whole = F.greatest(F.size("words") - F.lit(WINDOW - 1), F.lit(0))
    counted = counted.withColumn("_run", F.slice(F.col("_run"), F.lit(1), whole))
    repeated = F.size(F.array_distinct("_run")) < F.size("_run")
    placed = F.transform("_run", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    counted = counted.withColumn("_placed", F.when(repeated, F.sort_array(placed)))
    after = F.slice(F.col("_placed"), F.lit(2), F.size("_placed"))
    starts = F.flatten(F.zip_with("_placed", after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array())))
    counted = counted.withColumn("_starts", F.sort_array(F.array_distinct(starts)))
    next_start = F.slice(F.col("_starts"), F.lit(2), F.size("_starts"))
    covered = F.zip_with("_starts", next_start, lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda sum_, x: sum_ + x.cast("long"))
    return counted.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_lines", "_run", "_placed", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules on the counts (cheap) and on words and characters (dearer). Limits are shares, so they hold for any length."""
    body, words, n = whole_text(text), F.col("words"), F.col("n_words")
    chars = F.length(body).cast("double")
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(body, r"[^\p{Lu}]+", ""))
    stutter = F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: a == b), lambda same: same))
    one = F.lit(1.0)
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n, one),
        Rule("repeated_lines", (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")), one),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n), one),
        Rule("stutter", 10 * stutter > 3 * n, 3.0 * n.cast("double")),
        Rule("shouting", 10 * capitals > 4 * letters, 2.0 * chars),
        Rule("letters", 2 * letters < F.col("word_chars"), chars),
    ]


def measured_rates(sample: DataFrame, rules: list[Rule]) -> list[float]:
    """Seconds per unit of each rule's cost: the faster of two runs over the sample, less those of a rule that does nothing."""

    def seconds(condition: Column) -> float:
        taken = []
        for _ in range(2):
            start = time.perf_counter()
            sample.agg(F.count_if(condition)).collect()
            taken.append(time.perf_counter() - start)
        return min(taken)

    idle = seconds(F.col("n_words") < 0)
    units = sample.agg(*[F.sum(r.cost).alias(f"c{i}") for i, r in enumerate(rules)]).first()
    return [max(seconds(r.rejects) - idle, LEAST_SECONDS) / (units[f"c{i}"] or 1.0) for i, r in enumerate(rules)]


def order_rules(sample: DataFrame, rules: list[Rule], rates: list[float] | None = None) -> list[Rule]:
    """The rules in the order of rejections per cost, each judged on what the ones before it let pass.

    A rule's cost on a row is its units times its rate (1 without ``rates``). One aggregation over the sample: a row for each
    combination of verdicts (2^rules at most) with each rule's total
    cost there; rows that fail the base are left out. An empty sample keeps the given order, which also breaks ties.
    """
    rates = rates or [1.0] * len(rules)
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    costs = [r.cost.alias(f"c{i}") for i, r in enumerate(rules)]
    groups = (
        sample.select(base_failed().alias("base"), *flags, *costs)
        .groupBy("base", *[f"r{i}" for i in range(len(rules))])
        .agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))])
        .collect()
    )
    groups = [g for g in groups if not g["base"]]
    left, order = list(range(len(rules))), []
    while left:
        def gain(i):
            cost = rates[i] * sum(g[f"c{i}"] or 0.0 for g in groups)
            return sum(g["n"] for g in groups if g[f"r{i}"]) / cost if cost else 0.0

        best = max(left, key=lambda i: (gain(i), -i))
        order.append(rules[best])
        left.remove(best)
        groups = [g for g in groups if not g[f"r{best}"]]
    return order


def first_failure(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, else null; later rules are not evaluated for it."""
    chain = F
    for rule in rules:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return chain.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``kept`` and ``failed_rule`` (null if kept).

    The sample that orders the rules holds about ``sample_rows`` rows, those whose keys hash lowest; each rule's time is taken on
    it. It only sets the order, so the verdicts do not depend on it, nor on the times. A row that fails the base is not shown to the rules (``failed_rule`` is ``base``).
    Null or empty text has no words and fails the base. Each of several equal rows is judged alike. An empty table
    gives an empty result. Columns of the input with the added names are replaced.
    """
    rules = standard_rules(text) if rules is None else rules
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(PLACES)) < int(share * PLACES))
    sample = materialize(add_counts(sample, text), "sample")
    ordered = order_rules(sample, rules, measured_rates(sample, rules))
    judged = add_counts(docs, text).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(first_failure(ordered))
    return judged.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull()).drop("words")


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that pass, with the columns of the input.

    A filter on ``kept`` would be pushed below the counts, each count written out in it many times; exploding an array of
    one row or none is evaluated after them.
    """
    judged = judge(docs.withColumn("__all", F.struct(*docs.columns)), text, key)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("__all"))).alias("__all")).select("__all.*")
