"""Column expressions and small helpers that several corpus operators share.

White space is ``[\\x20\\x09-\\x0D]`` throughout; a word is a run of other characters; null text is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text in order; an empty array if it has none."""
    return F.array_remove(F.split(text, SPACES), "")


def one_space(text: Column) -> Column:
    """Every run of white space as one space: what makes two texts equal."""
    return F.regexp_replace(text, SPACES, " ")


def uniform_hash(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 2^60) that DuckDB computes alike: the first 15 hex digits of an MD5."""
    joined = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def map_rows(df: DataFrame, keep: list[str], work: Callable[[dict], Iterator[tuple]], added: str) -> DataFrame:
    """The columns ``keep`` of ``df``, passed on as they are, beside new columns made in Python.

    ``work`` gets a batch's other columns as Arrow arrays by name and yields (places, columns): the batch's rows that the
    new rows belong to (None: all, in order) and a list of values or an Arrow array per new column. The kept columns never become
    pandas columns, so 64-bit ids beside nulls do not change.
    """
    kept = StructType([df.schema[c] for c in keep])
    schema = StructType([*kept.fields, *StructType.fromDDL(added).fields])
    new = to_arrow_schema(StructType(schema.fields[len(keep) :]))

    def run(batches):
        for batch in batches:
            rest = {n: batch.column(n) for n in batch.schema.names if n not in keep}
            for places, columns in work(rest):
                same = [batch.column(c) for c in keep]
                if places is not None:
                    at = pa.array(places, pa.int64())
                    same = [c.take(at) for c in same]
                arrays = [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in new]
                yield pa.RecordBatch.from_arrays(same + arrays, names=schema.names)

    return df.mapInArrow(run, schema)
