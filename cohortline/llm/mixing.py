"""Mixing sources to target weights by hierarchical budgets.

The budget flows down a tree (domain, language, source). Among the children of a node it is shared by weight; a child
that cannot use its share (its subtree has too few tokens) takes all it has and its siblings share the rest by weight.
Capacities are those of whole subtrees, so a shortage is made up by siblings first, and reaches the next level up only
when a whole subtree is exhausted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.text import uniform_hash, whole_text, word_array
from cohortline.session import materialize

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 4096
ADDED = ["domain", "n_tokens", "epoch", "take_tokens"]


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    chain = F
    for name, weight in weights.get(level, {}).items():
        chain = chain.when(F.col(level) == name, F.lit(weight).cast("long"))
    one = F.lit(1).cast("long")
    return one if chain is F else chain.otherwise(one)


def share_among_siblings(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``share`` to children with ``weight``, ``capacity`` and their parent's ``budget``; whole tokens, none lost.

    Children are taken by capacity per weight. One is exhausted if its capacity is at most its share of what those
    before it leave; then so were all before it. The rest is cut at rounded cumulative weights.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight")).otherwise(F.lit(float("inf")))
    family = Window.partitionBy(*parent)
    before = family.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    upto = family.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")

    def when(flag: str, value: str) -> Column:
        return F.when(F.col(flag), F.col(value)).otherwise(zero)

    shared = (
        nodes.withColumn("ratio", ratio)
        .withColumns(
            {
                "w_left": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), zero),
                "b_left": F.col("budget") - F.coalesce(F.sum("capacity").over(before), zero),
            }
        )
        .withColumn("short", (F.col("weight") > 0) & (F.col("capacity") * F.col("w_left") <= F.col("weight") * F.col("b_left")))
        .withColumn("open", ~F.col("short"))
        .withColumns(
            {
                "b_rest": F.col("budget") - F.sum(when("short", "capacity")).over(family),
                "w_rest": F.sum(when("open", "weight")).over(family),
                "w_upto": F.sum(when("open", "weight")).over(upto),
            }
        )
        .withColumn("share", F.expr(
            "CASE WHEN short THEN capacity WHEN w_rest = 0 THEN 0L "
            "ELSE (b_rest * w_upto) div w_rest - (b_rest * (w_upto - weight)) div w_rest END"
        ))
    )
    return shared.drop("ratio", "w_left", "b_left", "short", "open", "b_rest", "w_rest", "w_upto")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (the levels, n_docs, tokens) with ``share``: each leaf's tokens. One row per leaf."""
    given = None
    for depth in range(1, len(LEVELS) + 1):
        path, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(path[-1], weights))
        if given is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(budget).cast("long"), F.sum("capacity").over(Window.partitionBy())))
        else:
            nodes = nodes.join(given, parent)
        given = share_among_siblings(nodes, parent, path[-1]).select(*path, F.col("share").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "share"), list(LEVELS))


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows chosen, once per epoch, with ``domain``, ``n_tokens`` (words), ``epoch`` and ``take_tokens``.

    ``weights`` gives whole-number weights by level and node name; others weigh 1, weight 0 gets nothing. ``budget``
    counts tokens; by default it is the number of tokens of the input. A leaf repeats whole epochs while its share
    lasts, then takes a prefix of one more epoch, whose order is a hash of seed, epoch and key. The last document
    of the prefix gives its first ``take_tokens`` tokens only. Null levels are a node named ''. Documents without tokens
    come with whole epochs or inside a prefix. Rows with equal keys are ordered by their length. An empty table
    gives an empty result. Input columns with the added names are replaced.

    A prefix needs no sort of a leaf: token sums of hash ranges (about 4096 rows each) tell which range it ends in, and
    only that range's rows are ordered.
    """
    named = docs.drop("epoch", "take_tokens", "n_tokens").withColumns(
        {
            "domain": F.coalesce(domain, F.lit("")),
            "__lang": F.coalesce("lang", F.lit("")),
            "__source": F.coalesce("source", F.lit("")),
            "n_tokens": F.size(word_array(whole_text(text))).cast("long"),
        }
    )
    slim = materialize(named.select("domain", F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col(key).alias("key"), "n_tokens"), "tokens")
    stats = slim.groupBy(*LEVELS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    leaves = materialize(stats, "leaves")
    if budget is None:
        budget = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, weights, budget, max_epochs).select(
        *LEVELS,
        F.expr("CASE WHEN tokens = 0 THEN 0L ELSE share div tokens END").alias("full"),
        F.expr("CASE WHEN tokens = 0 THEN 0L ELSE share % tokens END").alias("rest"),
        F.expr(f"1 + n_docs div {BUCKET_ROWS}").alias("n_ranges"),
    )
    plan = materialize(plan, "plan")

    def ranged(rows: DataFrame, id_: str) -> DataFrame:
        place = uniform_hash(F.col("full"), F.col(id_), seed=seed)
        return rows.withColumn("place", place).withColumn("range", F.shiftright(F.shiftright("place", 30) * F.col("n_ranges"), 30))

    in_range = ranged(slim.join(plan.filter("rest > 0"), list(LEVELS)), "key").groupBy(*LEVELS, "range")
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    ends = (
        in_range.agg(F.sum("n_tokens").alias("range_tokens"), F.max("rest").alias("rest"))
        .withColumn("before", F.sum("range_tokens").over(upto) - F.col("range_tokens"))
        .filter("before < rest AND before + range_tokens >= rest")
        .groupBy(*LEVELS)
        .agg(F.min(F.struct("range", "before")).alias("end"))
        .select(*LEVELS, F.col("end.range").alias("end_range"), F.col("end.before").alias("end_before"))
    )
    plan = materialize(plan.join(ends, list(LEVELS), "left"), "plan").withColumnsRenamed({"lang": "__lang", "source": "__source"})

    rows = ranged(named.join(plan, ["domain", "__lang", "__source"]), key)
    inside = F.col("range") == F.col("end_range")
    order = Window.partitionBy("domain", "__lang", "__source").orderBy("place", "n_tokens")
    cut = rows.filter(inside).withColumn("place_before", F.col("end_before") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    cut = cut.withColumn("taken", F.expr("CASE WHEN place_before < rest THEN least(n_tokens, rest - place_before) END"))
    whole = rows.filter(~F.coalesce(inside, F.lit(False))).withColumns(
        {"place_before": F.lit(0).cast("long"), "taken": F.when(F.col("range") < F.col("end_range"), F.col("n_tokens"))}
    )
    epochs = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("take_tokens"))))
    last = F.when(F.col("taken").isNotNull(), F.array(F.struct(F.col("full").alias("epoch"), F.col("taken").alias("take_tokens"))))
    none = F.array().cast("array<struct<epoch:bigint,take_tokens:bigint>>")
    chosen = whole.unionByName(cut).withColumn("use", F.explode(F.concat(F.coalesce(epochs, none), F.coalesce(last, none))))
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    return chosen.select(*kept, "domain", "n_tokens", "use.epoch", "use.take_tokens")


def cut_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The text of a document at the end of a prefix, cut to the tokens taken; others are left as they are."""
    prefix = F.array_join(F.slice(word_array(whole_text(text)), F.lit(1), F.col("take_tokens").cast("int")), " ")
    return mixed.withColumn(text, F.when(F.col("take_tokens") < F.col("n_tokens"), prefix).otherwise(F.col(text)))
