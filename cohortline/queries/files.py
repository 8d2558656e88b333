"""Extract files that are written from the given tables, with bad rows among them, then loaded, landed and joined."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions import clean, columns
from cohortline.queries.registry import Tables, query, rounded
from cohortline.session import materialize, new_folder
from cohortline.sources import extracts as ex

HEADER = "PowerInsight Encounter Id,Clinical Event,Clinical Event End Date/Time,Infusion Rate,Infusion Rate Unit,Event ID,Extra"
RAW_MED = 'Drip ""slow"", first'
# Of fifty events one is cut after three values and one has a value too many; odd ones go to gzipped files.
TOO_SHORT, TOO_LONG = "event_id % 50 = 7", "event_id % 50 = 8"


def _write_lines(lines: DataFrame, folder: str, compression: str) -> None:
    """Text lines as CSV files that each begin with the header; nothing is quoted on the way."""
    writer = lines.select(F.col("line").alias(HEADER)).write.option("header", True).option("sep", "\u0001").option("quote", "")
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("escapeQuotes", False).option("compression", compression).csv(folder)


def _cont_meds_files(t: Tables) -> str:
    """A directory of plain and gzipped files of continuous medications: errors have quotes, commas and a line break in their names."""
    folder = new_folder(t.spark, "files")
    broken = F.col("event_type") == "error"
    begin = F.concat(F.col("user_id").cast("string"), F.lit(","))
    date = F.date_format("ts", "M/d/yyyy H:mm:ss")
    unit = F.when(F.col("event_type") == "view", "").otherwise("mg/hr")
    rest = F.concat_ws(",", date, F.col("value").cast("string"), unit, F.col("event_id").cast("string"), F.lit("x"))
    rest = F.when(F.expr(TOO_SHORT), date).when(F.expr(TOO_LONG), F.concat(rest, F.lit(",more"))).otherwise(rest)
    two_lines = F.array(F.concat(begin, F.lit(f'"{RAW_MED}')), F.concat(F.lit('second",'), rest))
    one_line = F.array(F.concat(begin, F.initcap("event_type"), F.lit(","), rest))
    lines = t.events.select("event_id", F.explode(F.when(broken, two_lines).otherwise(one_line)).alias("line"))
    for kind, compression, rows in (("plain", "none", "event_id % 2 = 0"), ("packed", "gzip", "event_id % 2 = 1")):
        _write_lines(lines.filter(rows), f"{folder}/cont_meds_{kind}", compression)
    return folder


@query("extract_rows", f"""
SELECT user_id::VARCHAR AS pie_id, CASE event_type WHEN 'error' THEN 'drip "slow", first' || chr(10) || 'second' ELSE event_type END AS med,
  date_trunc('second', ts)::TIMESTAMP AS med_datetime, value AS rate, CASE WHEN event_type <> 'view' THEN 'mg/hr' END AS rate_unit,
  event_id::VARCHAR AS event_id
FROM events WHERE NOT ({TOO_SHORT}) AND NOT ({TOO_LONG})
""")
def extract_rows(t: Tables):
    """Loaded by spec: typed, with line breaks and quotes inside values, without the rows that do not fit."""
    return ex.load_extract(t.spark, _cont_meds_files(t), ex.MEDS_CONT).rows


@query("extract_bad_rows", f"""
SELECT CASE WHEN event_id % 2 = 0 THEN 'plain' ELSE 'packed' END AS kind, count(*) FILTER ({TOO_SHORT}) AS too_short,
  count(*) FILTER ({TOO_LONG}) AS too_long
FROM events GROUP BY 1
""")
def extract_bad_rows(t: Tables):
    """The bad rows by kind of file, all of them as they stood."""
    loaded = ex.load_extract(t.spark, _cont_meds_files(t), ex.MEDS_CONT)
    kind = F.regexp_extract("file", "cont_meds_([a-z]+)", 1)
    long = F.col("record").endswith(",more")
    every = t.spark.createDataFrame([("plain",), ("packed",)], "kind string")
    counted = loaded.bad.groupBy(kind.alias("kind")).agg(F.count_if(~long).alias("too_short"), F.count_if(long).alias("too_long"))
    return every.join(counted, "kind", "left").na.fill(0)


def _landed(spark: SparkSession, frames: dict[str, tuple[DataFrame, str]], build) -> DataFrame:
    """``build`` on the frames as landed tables; its result is written before the tables go."""
    folder = new_folder(spark, "landed")
    mark = folder.split("/")[-2]
    names = {name: f"{name}_{mark}" for name in frames}
    try:
        for name, (df, key) in frames.items():
            ex.land_table(df, names[name], key, folder)
        tables = {name: ex.use_or_load(spark, {}, names[name], folder) for name in frames}
        return materialize(build(tables), "result")
    finally:
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def stays_per_patient(tables: dict[str, DataFrame]) -> DataFrame:
    """Two landed tables joined on their key: no shuffle of either."""
    joined = tables["people"].join(tables["stays"], "pie_id")
    return joined.groupBy("pie_id").agg(F.first("segment").alias("segment"), F.count(F.lit(1)).alias("n_stays"), F.sum("price").alias("price"))


@query("landed_join", """
SELECT c_custkey AS pie_id, c_mktsegment AS segment, count(*) AS n_stays, round(sum(o_totalprice), 2) AS price
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL
""")
def landed_join(t: Tables):
    people = t.customer.select(F.col("c_custkey").alias("pie_id"), F.col("c_mktsegment").alias("segment"))
    stays = t.orders.select(F.col("o_custkey").alias("pie_id"), F.col("o_totalprice").alias("price"))
    return rounded(_landed(t.spark, {"people": (people, "pie_id"), "stays": (stays, "pie_id")}, stays_per_patient), 2, "price")


@query("lookup_and_results", """
SELECT n_nationkey::VARCHAR AS nation_key, n_name AS nation_name, r_name || ', "' || r_name || '"' AS region
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def lookup_and_results(t: Tables):
    """A result table written as CSV, read back as a lookup: all text, quotes and commas kept."""
    folder = new_folder(t.spark, "lookup")
    region = F.concat("r_name", F.lit(', "'), "r_name", F.lit('"'))
    out = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = out.select(F.col("n_nationkey").alias("nation.key"), F.col("n_name").alias("nation.name"), region.alias("region"))
    return ex.read_lookup(t.spark, ex.write_table(out, folder, "nations"))


@query("select_helpers", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS closed
FROM orders
""")
def select_helpers(t: Tables):
    """Columns chosen and dropped by prefix, the key first, and text as boolean."""
    kept = columns.keep_prefix(t.orders, "o_order", also=["o_custkey"])
    kept = columns.drop_prefix(kept, "o_orderd")
    answer = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "no").otherwise("perhaps")
    kept = kept.withColumn("closed", clean.to_boolean(answer))
    return columns.front(kept, "o_orderkey", "o_custkey")
