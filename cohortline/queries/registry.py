"""Name, DataFrame builder and oracle SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """The given Parquet tables of one scale directory, opened on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        setattr(self, name, table)
        return table


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` as a query."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Doubles rounded, since two engines add them up in different orders."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
