"""What the plans must and must not contain, and how hot keys are spread."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cohortline.operators import episodes, exposure, features, joins, ranks
from cohortline.queries import REGISTRY

SF = "/root/testdata/sf0.001"
EAGER = {n for n in REGISTRY if n.startswith("study_")}
WITH_P_VALUES = {"mannwhitney_exact", "ttest_intervals", "group_compare_by_nation", "normality", "ttest_p", "ftest_p", "compare_categorical", "group_compare", "group_compare_by_slice", "table_one_with_p"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def heavy_exchanges(text):
    """Hash exchanges of a plan, without the ones that only read a reused subtree."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", text)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - EAGER))
def test_no_cross_join_and_no_row_udf(spark, name):
    text = plan(REGISTRY[name].build(spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "MapInPandas" not in text
    if name not in WITH_P_VALUES:
        assert "ArrowEvalPython" not in text


def test_exposure_shuffles_by_slot(events):
    text = plan(exposure.rate_exposure(events, ["user_id", "event_type"], "ts", "value"))
    keys = [re.sub(r"#\d+L?", "", k) for k in heavy_exchanges(text)]
    # Ties, slots, and one row per slot: the last one carries summaries only.
    assert keys == ["user_id, event_type", "user_id, event_type, slot", "user_id, event_type, ts"]


def test_episode_windows_never_take_a_whole_entity(events):
    text = plan(episodes.collapse_runs(events, "user_id", "event_type", "ts"))
    keys = {re.sub(r"#\d+L?", "", k) for k in heavy_exchanges(text)}
    assert keys == {"user_id, ts, event_type", "user_id, __slot", "user_id"}


def test_first_row_is_pruned_before_the_shuffle(events):
    text = plan(joins.first_row(events, "user_id", ["ts", "event_id"]))
    assert re.search(r"WindowGroupLimit.*Partial", text)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_wide_features_need_one_shuffle(spark, events):
    wide = features.worst_values(events, "user_id", "event_type", "value", ["click", "view"])
    cohort = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    matrix = features.indicator_matrix(events, cohort, "user_id", "event_type", ["click", "view"])
    for df in (wide, matrix):
        text = plan(df)
        assert len(heavy_exchanges(text)) == 1 and "Join" not in text and "partial_" in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(REGISTRY["semi_join_cohort"].build(spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value), EqualTo(event_type,purchase)" in text
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text


@pytest.fixture
def small_skew_limits(spark):
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed_frame(spark, n=20000, parts=8):
    """A third of all rows belong to key 0; every slice of the range holds some of them."""
    ids = spark.range(0, n, 1, parts)
    return ids.select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        (F.lit("2015-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, CAST(id AS INT))")).alias("t"),
    )


@pytest.mark.parametrize("join", [joins.keep_in, joins.drop_in])
def test_hot_key_is_split_in_key_joins(spark, small_skew_limits, join):
    df = skewed_frame(spark)
    right = df.filter("id < 15000").select("k")
    out = join(df, right, "k").groupBy("k").agg(F.max("payload").alias("p"))
    n = out.count()
    out.collect()
    assert "SortMergeJoin(skew=true)" in plan(out)
    assert n == df.select("k").distinct().join(right.distinct(), "k", "semi" if join is joins.keep_in else "anti").count()


def test_interval_join_spreads_a_hot_key(spark):
    df = skewed_frame(spark)
    spans = spark.range(1).select(
        F.lit(0).cast("long").alias("k"),
        F.lit("2015-01-02").cast("timestamp_ntz").alias("a"),
        F.lit("2015-01-09").cast("timestamp_ntz").alias("b"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joins.within_span(df, spans, "k", "t", "a", "b"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("__cell" in k for k in heavy_exchanges(text))


def test_ranks_shuffle_by_bucket(events):
    text = plan(ranks.tie_ranks(events, ["event_type"], "value"))
    keys = [re.sub(r"#\d+L?", "", k) for k in heavy_exchanges(text)]
    # Only the table of bucket sizes is gathered per key.
    assert keys.count("event_type") == 1
    assert set(keys) == {"event_type, __bucket", "event_type"}


UNUSUAL = "CASE id WHEN 0 THEN double('-Infinity') WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') ELSE double(id) END"


@pytest.mark.parametrize("value", ["1e9D + id", "98 + id / 1e5D", "id * 1e300D", "IF(id % 3 = 0, 5D, double(id))", UNUSUAL])
def test_ranks_spread_over_buckets(spark, value):
    df = spark.range(0, 100_000, 1, 8).select(F.expr(value).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tied = df.groupBy("v").count()
        sizes = [r["count"] for r in ranks.range_buckets(tied, ["v"]).groupBy("__bucket").count().collect()]
        ranked = ranks.tie_ranks(df, [], "v").orderBy("v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 2 * sum(sizes) / int(spark.conf.get("spark.sql.shuffle.partitions")) + 10
    below = 0
    for r in ranked:
        assert r["below"] == below and r["total"] == 100_000
        below += r["ties"]
