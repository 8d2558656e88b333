"""The training-data pipeline: quality rules, exact and near duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. ``run`` writes every stage's
result as Parquet to the shared folder and reads it back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from cohortline.llm.queries import MAX_EPOCHS, SEED, VOCABULARY, WEIGHTS, domain
from cohortline.session import materialize, small_batches

def _whole(docs: DataFrame) -> DataFrame:
    """The rows with a copy of all their columns, which no added column can replace."""
    return docs.withColumn("__all", F.struct(*docs.columns))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chosen documents once per epoch; the last of a leaf's prefix is cut to the tokens taken."""
    mixed = mixing.cut_texts(mixing.mix(_whole(docs), domain(), WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED))
    cut = F.col("take_tokens") < F.col("n_tokens")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [F.when(cut, new[c]).otherwise(F.col(f"__all.{c}")).alias(c) if c in new else F.col(f"__all.{c}") for c in docs.columns]
    return mixed.select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):  # the stages before it leave their workers large
        return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# Token ids, fingerprint exchange and best-fit packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
