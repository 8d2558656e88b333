"""Text, number, time and null rules, and column-set helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import aggregates, clean, columns, timing
from cohortline.operators import mapping
from cohortline.queries.registry import Tables, query, rounded

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


@query("clean_text_numeric", f"""
SELECT event_id,
  CASE WHEN regexp_matches(txt, '{NUMBER}') THEN try_cast(trim(txt) AS DOUBLE) END AS k,
  CASE WHEN regexp_matches(props, '{NUMBER}') THEN try_cast(trim(props) AS DOUBLE) END AS not_number,
  nullif(lower(trim(event_type)), 'view') AS event,
  CASE answer WHEN 'yes' THEN true WHEN 'no' THEN false END AS agreed,
  txt IS NOT NULL AND txt <> '' AS filled
FROM (SELECT event_id, props, event_type, regexp_extract(props, '([0-9]+)', 1) AS txt,
             CASE WHEN event_type = 'purchase' THEN 'yes' WHEN event_type = 'error' THEN 'no'
                  ELSE event_type END AS answer FROM events)
""")
def clean_text_numeric(t: Tables):
    answer = clean.relabel("event_type", {"purchase": "yes", "error": "no"})
    return t.events.select(
        "event_id",
        clean.to_number(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"),
        clean.to_number("props").alias("not_number"),
        clean.null_tokens("event_type", ["view"]).alias("event"),
        clean.yes_no(answer).alias("agreed"),
        clean.present(clean.empty_to_null(F.regexp_extract("props", "([0-9]+)", 1))).alias("filled"),
    )


@query("canonicalise", """
SELECT p_partkey,
  CASE WHEN regexp_matches(p_name, 'ring') THEN 'ring' WHEN regexp_matches(p_name, '^(hot|large) ') THEN 'hot or large'
       ELSE p_name END AS name,
  CASE WHEN p_type = 'PROMO' THEN 'SMALL' ELSE p_type END AS type,
  CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_type END AS size_class,
  regexp_matches(p_name, 'bolt|hot') AS mentioned
FROM part
""")
def canonicalise(t: Tables):
    return t.part.select(
        "p_partkey",
        clean.canonical("p_name", [("ring", "ring"), ("^(hot|large) ", "hot or large")]).alias("name"),
        clean.relabel("p_type", {"PROMO": "SMALL"}).alias("type"),
        clean.category("p_type", ["SMALL", "LARGE"]).alias("size_class"),
        clean.mentions("p_name", ["bolt", "hot"]).alias("mentioned"),
    )


@query("mapping_table", """
SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, 'ring$') THEN 'a ring' WHEN regexp_matches(p_name, '^hot ') THEN 'hot thing'
  WHEN p_name LIKE 'large%' THEN 'kind ' || p_name WHEN regexp_matches(p_name, '[aeiou]{2}|bolt') THEN 'other' ELSE p_name END AS name
FROM part
""")
def mapping_table(t: Tables):
    """Names by a table of exact and regular rules: the exact ones come from the data, one for every large thing."""
    regular = [(1, "regex", "ring$", "a ring"), (2, "regex", "^hot ", "hot thing"), (4, "regex", "[aeiou]{2}|bolt", "other")]
    rules = t.spark.createDataFrame(regular, "position int, kind string, pattern string, name string")
    large = t.part.filter("p_name LIKE 'large%'").select(
        F.lit(3).alias("position"), F.lit("exact").alias("kind"), F.col("p_name").alias("pattern"), F.concat(F.lit("kind "), "p_name").alias("name")
    )
    rows = t.part.select("p_partkey", "p_name")
    return mapping.canonical_by_table(rows, "p_name", rules.unionByName(large.distinct()), "name")


@query("unit_table", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_type,
  round(CASE WHEN l_linestatus = 'F' AND n = 1 THEN l_quantity * factor
             WHEN l_linestatus = 'F' AND n = 2 THEN l_quantity * factor * p_size
             WHEN l_linestatus = 'F' THEN l_quantity * factor / p_size ELSE l_quantity END, 5) AS standard
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN (SELECT p_type, count(*) % 97 + 1 AS factor, length(p_type) % 3 + 1 AS n FROM part GROUP BY p_type) USING (p_type)
""")
def unit_table(t: Tables):
    """Conversions from a table made of the parts: a factor and a power of the size for every type in unit F."""
    power = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(-1)), (F.length("p_type") % 3 + 1).cast("int"))
    units = t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    units = units.select(F.lower("p_type").alias("drug"), F.lit("F").alias("unit"), (F.col("n") % 97 + 1).alias("factor"), power.alias("weight_power"))
    rows = t.lineitem.join(t.part.select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    out = mapping.convert_by_table(rows, "p_type", "l_linestatus", "l_quantity", "p_size", units, "standard")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_type", "standard"), 5, "standard")


@query("time_functions", """
SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day, o_orderdate + INTERVAL 3 DAY AS later,
  round(date_diff('microsecond', o_orderdate, TIMESTAMP '1998-07-01 06:30:00') / 3.6e9, 6) AS hours,
  round(date_diff('microsecond', o_orderdate, TIMESTAMP '1998-07-01 06:30:00') / 8.64e10, 6) AS days,
  o_orderdate::TIMESTAMP AS parsed
FROM orders
""")
def time_functions(t: Tables):
    at = F.lit("1998-07-01 06:30:00").cast("timestamp_ntz")
    text = F.date_format("o_orderdate", "M/d/yyyy H:mm:ss")
    out = t.orders.select(
        "o_orderkey",
        timing.day_of("o_orderdate").alias("day"),
        timing.plus_days("o_orderdate", 3).alias("later"),
        timing.hours_between("o_orderdate", at).alias("hours"),
        timing.days_between("o_orderdate", at).alias("days"),
        timing.parse_datetime(text).alias("parsed"),
    )
    return rounded(out, 6, "hours", "days")


@query("null_semantics", """
WITH v AS (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS x,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS level FROM orders)
SELECT o_custkey, count(*) AS n_rows, count(x) AS n_known,
  round(CASE WHEN count(x) = count(*) THEN sum(x) END, 2) AS strict_sum,
  CASE WHEN count(x) = count(*) THEN min(x) END AS strict_min,
  CASE WHEN count(x) = count(*) THEN max(x) END AS strict_max,
  round(coalesce(sum(x), 0), 2) AS tolerant_sum,
  count(*) FILTER (level <> '1-URGENT') AS not_urgent,
  count(*) FILTER (level IS NULL OR level NOT IN ('1-URGENT', '2-HIGH')) AS not_listed,
  coalesce(bool_or(x > 400000), false) AS any_big,
  arg_min_null(x, row(o_orderkey)) AS first_x
FROM v GROUP BY o_custkey
""")
def null_semantics(t: Tables):
    v = t.orders.select(
        "o_custkey",
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("x"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("level"),
    )
    out = v.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("x").alias("n_known"),
        aggregates.sum_strict("x").alias("strict_sum"),
        aggregates.min_strict("x").alias("strict_min"),
        aggregates.max_strict("x").alias("strict_max"),
        aggregates.sum_or_zero("x").alias("tolerant_sum"),
        aggregates.count_true(F.col("level") != "1-URGENT").alias("not_urgent"),
        aggregates.count_true(F.coalesce(~F.col("level").isin("1-URGENT", "2-HIGH"), F.lit(True))).alias("not_listed"),
        aggregates.any_true(F.col("x") > 400000).alias("any_big"),
        aggregates.first_by("x", "o_orderkey").alias("first_x"),
    )
    return rounded(out, 2, "strict_sum", "tolerant_sum")


@query("column_sets", """
SELECT o_orderkey, lower(trim(o_orderpriority)) AS order_priority, lower(trim(o_orderstatus)) AS order_status,
       o_custkey AS order_custkey
FROM orders
""")
def column_sets(t: Tables):
    """Range keep and drop, rename by pattern, one function over many columns, sorted columns."""
    df = columns.keep_between(t.orders, "o_orderkey", "o_orderpriority")
    df = columns.drop_between(df, "o_totalprice", "o_orderdate")
    df = columns.map_columns(df, columns.other_columns(df), clean.lower_trim)
    df = columns.rename_pattern(df, [("^o_order(?=[sp])", "order_"), ("^o_cust", "order_cust")])
    return columns.sorted_columns(columns.safe_names(df), "o_orderkey")


@query("row_sums", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  round(coalesce(nullif(l_discount, 0.0), 0) + coalesce(nullif(l_tax, 0.0), 0), 6) AS total,
  round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 6) AS quotient,
  CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_returnflag = 'A' THEN 'kept' END AS label
FROM lineitem
""")
def row_sums(t: Tables):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    out = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        aggregates.row_sum(F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))).alias("total"),
        clean.ratio("l_discount", "l_tax").alias("quotient"),
        clean.labelled(flag, "returned", "kept").alias("label"),
    )
    return rounded(out, 6, "total", "quotient")
