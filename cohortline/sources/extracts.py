"""Extract files: every column read as text, then renamed and cast by a declared spec.

Codes such as ``427.5``, ``V44.0`` or ``31.10`` must never be taken for numbers, so no
schema is inferred. Gzipped files are read as they are, but one file is one task; landing
them once as Parquet makes later scans splittable, column-pruned and filtered at the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.clean import empty_to_null, to_number
from cohortline.functions.columns import safe_name
from cohortline.functions.timing import parse_datetime
from cohortline.session import materialize


def as_text(c: Column) -> Column:
    return c


def as_lower(c: Column) -> Column:
    return F.lower(c)


def as_level(c: Column) -> Column:
    """Text whose empty string means unknown."""
    return empty_to_null(c)


CASTS: dict[str, Callable[[Column], Column]] = {
    "text": as_text,
    "lower": as_lower,
    "level": as_level,
    "number": to_number,
    "datetime": parse_datetime,
}


_BAD_RECORD, _FILE = "__bad_record", "__file"


@dataclass(frozen=True)
class ExtractSpec:
    """``fields``: ``(raw header, tidy name, cast)``, the cast being a key of ``CASTS``.

    Headers match however their words are separated: ``Event.ID`` is ``Event ID``.
    ``prefix`` is the glob that file names start with (the spec's name by default).
    ``raw_columns`` is the whole header in file order, if it should be enforced.
    """

    name: str
    fields: tuple[tuple[str, str, str], ...]
    prefix: str | None = None
    raw_columns: tuple[str, ...] | None = None

    def text_schema(self) -> T.StructType | None:
        if self.raw_columns is None:
            return None
        return T.StructType([T.StructField(c, T.StringType()) for c in self.raw_columns])

    def project(self, raw: DataFrame) -> DataFrame:
        found = {safe_name(c): c for c in raw.columns}
        missing = [src for src, _, _ in self.fields if safe_name(src) not in found]
        if missing:
            raise ValueError(f"extract {self.name!r} lacks columns {missing}")
        return raw.select(
            *[CASTS[cast](F.col(f"`{found[safe_name(src)]}`")).alias(dst) for src, dst, cast in self.fields]
        )


# Raw headers and file prefixes of the extracts.
_ID = ("PowerInsight.Encounter.Id", "pie_id", "text")
_EVENT = "Clinical.Event"
_RESULT = "Clinical.Event.Result"
_END = "Clinical.Event.End.Date.Time"

HOME_MEDS = ExtractSpec(
    "home_meds",
    (
        _ID,
        ("Order.Catalog.Short.Description", "home_med", "lower"),
        ("Order.Catalog.Mnemonic", "home_med_order", "text"),
    ),
)
LABS = ExtractSpec(
    "labs",
    (_ID, (_EVENT, "lab", "text"), (_RESULT, "result", "text"), (_END, "lab_datetime", "datetime")),
    prefix="labs[^_]",
)
MEDS_CONT = ExtractSpec(
    "meds_cont",
    (
        _ID,
        (_EVENT, "med", "lower"),
        (_END, "med_datetime", "datetime"),
        ("Infusion.Rate", "rate", "number"),
        ("Infusion.Rate.Unit", "rate_unit", "level"),
        ("Event.ID", "event_id", "text"),
    ),
    prefix="cont_meds",
)
MEDS_BOLUS = ExtractSpec(
    "meds_bolus",
    (
        _ID,
        (_EVENT, "med", "lower"),
        (_END, "med_datetime", "datetime"),
        (_RESULT, "dose", "number"),
        ("Clinical.Event.Result.Units", "dose_unit", "level"),
        ("Route.of.Administration...Short", "route", "level"),
        ("Event.ID", "event_id", "text"),
    ),
    prefix="bolus_meds",
)
VITALS = ExtractSpec(
    "vitals",
    (_ID, (_EVENT, "vital", "text"), (_RESULT, "result", "number"), (_END, "vital_datetime", "datetime")),
)


def tidy_spec(name: str, **casts: str) -> ExtractSpec:
    """Spec for an extract whose headers already are the tidy names."""
    return ExtractSpec(name, tuple((c, c, cast) for c, cast in casts.items()))


# The remaining extracts, with the tidy schema they are used with.
PATIENTS = tidy_spec("patients", pie_id="text", age="number", discharge_datetime="datetime")
VENT_START = tidy_spec("vent_start", pie_id="text", vent_event="text", vent_datetime="datetime")
MEDS_CONTINUOUS = tidy_spec("meds_continuous", pie_id="text", med_rate_units="text")
LOCATIONS = tidy_spec(
    "locations", pie_id="text", location="text", arrive_datetime="datetime", depart_datetime="datetime"
)
FACILITY = tidy_spec("facility", pie_id="text", admit_type="text")
LABS_PREG = tidy_spec("labs_preg", pie_id="text", lab="text", lab_result="text", lab_datetime="datetime")
LABS_ABG = tidy_spec("labs_abg", pie_id="text", lab="text", lab_result="text", lab_datetime="datetime")
DIAGNOSIS = tidy_spec("diagnosis", pie_id="text", diag_type="text", diag_code="text")
MPP = tidy_spec("mpp", pie_id="text", mpp="text")
PROCEDURES = tidy_spec("procedures", pie_id="text", proc_code="text")
IDENTIFIERS = tidy_spec("identifiers", pie_id="text", fin="text")
DEMOGRAPHICS = tidy_spec("demographics", pie_id="text", age="number", visit_type="text", facility="text", diagnosis="text")
CCS_CROSSWALK = tidy_spec("ccs_crosswalk", ccs="text", icd9_code="text")
DRUG_CLASS_MEMBERS = tidy_spec("drug_class_members", med_class="text", med_name="text")
MEASURES = tidy_spec(
    "measures",
    pie_id="text", measure="text", measure_units="text", measure_datetime="datetime", measure_result="number",
)


def read_text_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, names: str | None = None) -> DataFrame:
    """CSV files (plain or gzipped) with a header, every column as text.

    Values may hold line breaks and doubled quotes, so a file is read by one task: land large ones once as Parquet.
    A row that does not fit the header ends the read with an error; :func:`load_extract` sets such rows aside instead.
    """
    reader = _csv_reader(spark, names).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path if isinstance(path, str) else list(path))


def _csv_reader(spark: SparkSession, names: str | None) -> DataFrameReader:
    reader = spark.read.option("header", True).option("inferSchema", False)
    reader = reader.option("multiLine", True).option("quote", '"').option("escape", '"')
    return reader if names is None else reader.option("pathGlobFilter", names)


def _extract_path(directory: str, spec: ExtractSpec, pattern: str | None) -> str:
    return f"{directory.rstrip('/')}/{pattern or spec.prefix or spec.name}*"


def read_extract(spark: SparkSession, directory: str, spec: ExtractSpec, pattern: str | None = None) -> DataFrame:
    """All files of one kind in a directory as one typed table.

    ``pattern`` overrides the spec's file name prefix when one layout serves several files.
    """
    return spec.project(read_text_csv(spark, _extract_path(directory, spec, pattern), spec.text_schema(), "*.csv*"))


@dataclass(frozen=True)
class Loaded:
    """An extract after loading: its typed ``rows``, and the rows that do not fit its header as ``bad`` (file, record)."""

    rows: DataFrame
    bad: DataFrame

    def bad_by_file(self) -> DataFrame:
        """``file`` and ``n_bad`` of every file with a bad row."""
        return self.bad.groupBy("file").agg(F.count(F.lit(1)).alias("n_bad"))


def load_extract(spark: SparkSession, directory: str, spec: ExtractSpec, pattern: str | None = None) -> Loaded:
    """All files of one kind, read once and written to the shared folder, with the rows that do not fit set aside.

    A row with too few or too many values, or with a quote that never ends, is kept as it stands beside the file's name. So one bad row in
    thousands of files neither ends the load nor gets lost. A file whose header differs from the first one's still ends it.
    """
    path = _extract_path(directory, spec, pattern)
    schema = spec.text_schema() or _csv_reader(spark, "*.csv*").csv(path).schema
    wide = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema], T.StructField(_BAD_RECORD, T.StringType())])
    reader = _csv_reader(spark, "*.csv*").schema(wide).option("enforceSchema", False).option("mode", "PERMISSIVE")
    raw = reader.option("columnNameOfCorruptRecord", _BAD_RECORD).csv(path)
    parsed = raw.select(
        F.col("_metadata.file_path").alias(_FILE), F.col(_BAD_RECORD),
        *[F.col(f"`{f.name}`").alias(f"__{i}") for i, f in enumerate(schema)],
    )
    stored = materialize(parsed, spec.name)
    good = stored.filter(F.col(_BAD_RECORD).isNull()).select(*[F.col(f"__{i}").alias(f.name) for i, f in enumerate(schema)])
    bad = stored.filter(F.col(_BAD_RECORD).isNotNull()).select(F.col(_FILE).alias("file"), F.col(_BAD_RECORD).alias("record"))
    return Loaded(spec.project(good), bad)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A lookup CSV, all text, with dots in its header turned into underscores."""
    raw = read_text_csv(spark, path)
    return raw.toDF(*[c.strip().replace(".", "_") for c in raw.columns])


def land(df: DataFrame, path: str, partition_by: Sequence[str] = (), files_by: Sequence[str] = ()) -> None:
    """Write a table once as Parquet, optionally partitioned; ``files_by`` clusters rows by key."""
    out = df.repartition(*files_by) if files_by else df
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def land_table(df: DataFrame, name: str, key: str, directory: str, buckets: int | None = None, sort: Sequence[str] = ()) -> DataFrame:
    """Write a table once, dealt into buckets by ``key`` and sorted by it (then by ``sort``), under a catalog name.

    Tables landed on the same key with as many buckets (by default as there are shuffle partitions) meet in a join without a shuffle of
    either. Rows are dealt by one shuffle, so a bucket is one file; a key with very many rows makes one large file, which scans still split.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *sort)
    writer.option("path", f"{directory.rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def use_or_load(spark: SparkSession, tables: Mapping[str, DataFrame], name: str, directory: str) -> DataFrame:
    """The table if the caller already has it, else the landed table of that name, else the saved Parquet files."""
    if name in tables:
        return tables[name]
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}")


def write_table(df: DataFrame, directory: str, name: str, fmt: str = "csv") -> str:
    """Write a result table as CSV with header, or as Parquet, and return its path."""
    path = f"{directory.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path
