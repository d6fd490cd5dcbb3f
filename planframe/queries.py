"""The catalogue: each query runs a plan on a table, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profile as P
from .functions import values as V
from .operators import groups
from .plans.engine import Context, run_plan
from .privacy import PATTERNS, personal_data
from .sheet import sheet_of
from .sqlgate import run_sql

KEYS = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "events": ["event_id"], "documents": ["doc_id"]}
TODAY = "1998-08-02"

CATALOGUE: dict[str, tuple[Callable, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, dates and times as text: what a sheet shows."""
    out = []
    for f in df.schema:
        c, t = V.col(f.name), f.dataType.simpleString()
        out.append((F.round(c, digits) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd") if t in ("date", "timestamp", "timestamp_ntz") else c).alias(f.name))
    return df.select(*out)


def add(name: str, source: str, plan: list[dict], sql: str, files: dict[str, str] | None = None, before: Callable | None = None, digits: int = 4, after: Callable | None = None) -> None:
    """A query: ``before`` changes the table first; ``after`` makes rows of the resulting sheet (else its visible columns)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        df = before(df) if before else df
        others = {k: sheet_of(table(spark, sf_dir, t), KEYS[t]) for k, t in (files or {}).items()}
        out = run_plan(sheet_of(df, KEYS[source]), plan, others, TODAY)
        return _shown(after(out) if after else out.output(ordered=False), digits)

    CATALOGUE[name] = (query, sql)


def where(column: str, operator: str, value=None, **more) -> dict:
    return {"op": "filter", "conditions": [{"column": column, "operator": operator, "value": value, **more}]}


def select(*columns: str) -> dict:
    return {"op": "select_columns", "columns": list(columns)}


LINE = select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
L = "l_orderkey, l_linenumber, l_quantity, l_extendedprice"
CUST = select("c_custkey", "c_name", "c_mktsegment")
C = "c_custkey, c_name, c_mktsegment"
N = lambda c: f"lower(trim({c}))"

# --- filters
add("filter_gt", "lineitem", [where("l_quantity", "gt", 45), LINE], f"SELECT {L} FROM lineitem WHERE l_quantity > 45")
add("filter_between", "lineitem", [{"op": "filter", "conditions": [{"column": "l_discount", "operator": "gte", "value": 0.05}, {"column": "l_discount", "operator": "lte", "value": 0.07}]}, LINE], f"SELECT {L} FROM lineitem WHERE l_discount >= 0.05::DOUBLE AND l_discount <= 0.07::DOUBLE")
add("filter_equals_text", "customer", [where("c_mktsegment", "equals", " building "), CUST], f"SELECT {C} FROM customer WHERE {N('c_mktsegment')} = 'building'")
add("filter_not_equals", "customer", [where("c_mktsegment", "not_equals", "Building"), CUST], f"SELECT {C} FROM customer WHERE NOT coalesce({N('c_mktsegment')} = 'building', false)")
add("filter_in", "customer", [where("c_nationkey", "in", values=["1", "2.0", 3]), CUST], f"SELECT {C} FROM customer WHERE c_nationkey IN (1, 2, 3)")
add("filter_not_in", "customer", [where("c_mktsegment", "not_in", values=["building", "MACHINERY"]), CUST], f"SELECT {C} FROM customer WHERE NOT coalesce({N('c_mktsegment')} IN ('building', 'machinery'), false)")
add("filter_contains", "part", [where("p_type", "contains", "BRASS"), select("p_partkey", "p_type")], "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'brass')")
add("filter_not_contains", "part", [where("p_type", "not_contains", "brass"), select("p_partkey", "p_type")], "SELECT p_partkey, p_type FROM part WHERE NOT coalesce(contains(lower(p_type), 'brass'), false)")
DIRTY = lambda df: df.withColumn("segment", F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 7 == 0, "  ").when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("  x "))).otherwise(F.col("c_mktsegment"))).withColumn("money", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Rs. "), F.format_number(F.abs("c_acctbal"), 2))).otherwise(F.round(F.abs("c_acctbal"), 2).cast("decimal(18,2)").cast("string")))
DIRTY_SQL = "(SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 3 = 0 THEN '  ' || lower(c_mktsegment) || '  x ' ELSE c_mktsegment END AS segment FROM customer)"
add("filter_is_empty", "customer", [where("segment", "is_empty"), CUST], f"SELECT {C} FROM {DIRTY_SQL} WHERE segment IS NULL OR trim(segment) = ''", before=DIRTY)
add("filter_not_empty", "customer", [where("segment", "not_empty"), CUST], f"SELECT {C} FROM {DIRTY_SQL} WHERE trim(segment) <> ''", before=DIRTY)
add("filter_any", "lineitem", [{"op": "filter", "match": "any", "conditions": [{"column": "l_quantity", "operator": "lt", "value": 2}, {"column": "l_returnflag", "operator": "equals", "value": "r"}]}, LINE], f"SELECT {L} FROM lineitem WHERE l_quantity < 2 OR lower(l_returnflag) = 'r'")
add("filter_date_range", "orders", [{"op": "filter", "conditions": [{"column": "o_orderdate", "operator": "gte", "value": "1/3/1995"}, {"column": "o_orderdate", "operator": "lt", "value": "1995-06-01"}]}, select("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate::DATE >= DATE '1995-03-01' AND o_orderdate::DATE < DATE '1995-06-01'")
add("filter_older_than", "orders", [where("o_orderdate", "older_than_days", 900), select("o_orderkey")], f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE < DATE '{TODAY}' - 900")
add("filter_within_last", "orders", [where("o_orderdate", "within_last_days", 900), select("o_orderkey")], f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '{TODAY}' - 900")
add("filter_formula", "lineitem", [{"op": "filter_formula", "formula": "=AND([l_quantity]>40, OR([l_returnflag]=\"a\", [l_discount]>=9%))"}, LINE], f"SELECT {L} FROM lineitem WHERE l_quantity > 40 AND (lower(l_returnflag) = 'a' OR l_discount >= 0.09::DOUBLE)")
add("filter_two_columns", "lineitem", [{"op": "filter_formula", "formula": "=[l_tax]<=[l_discount]"}, LINE], f"SELECT {L} FROM lineitem WHERE l_tax <= l_discount")

#: Numbers with NaN and NULL, whole numbers beyond the doubles, text amid tabs and no-break spaces.
ODD = lambda df: df.withColumns({"v": F.when(F.col("c_custkey") % 4 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_acctbal")), "big": F.col("c_custkey") + 9007199254740000, "wide": F.concat(F.lit("\t"), F.col("c_mktsegment"), F.lit("\xa0"))})
ODD_SQL = "(SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'NaN'::DOUBLE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS v, c_custkey + 9007199254740000 AS big, c_mktsegment AS wide FROM customer)"
for _name, _where, _sql in [
    ("gt_odd", where("v", "gt", 0), "v > 0 AND NOT isnan(v)"), ("lte_odd", where("v", "lte", 1000), "v <= 1000 AND NOT isnan(v)"), ("in_odd", where("v", "in", values=["0", "nan"]), "v = 0"),
    ("is_empty_odd", where("v", "is_empty"), "v IS NULL OR isnan(v)"), ("not_empty_odd", where("v", "not_empty"), "v IS NOT NULL AND NOT isnan(v)"),
    ("gt_opposite", where("v", "gt", 0, negate=True), "v <= 0 AND NOT isnan(v)"), ("contains_opposite", where("wide", "contains", "build", negate=True), "NOT contains(wide, 'BUILD')"),
    ("equals_big", where("big", "equals", 9007199254740993), "big = 9007199254740993"), ("not_equals_big", where("big", "not_equals", "9,007,199,254,740,993"), "big <> 9007199254740993"), ("gte_fraction", where("c_nationkey", "gte", 3.5), "c_nationkey >= 4"),
    ("equals_number", where("c_nationkey", "equals", "7.0"), "c_nationkey = 7"), ("equals_fraction", where("c_nationkey", "equals", 7.5), "false"), ("equals_wide", where("wide", "equals", "building"), "wide = 'BUILDING'"),
    ("in_text", where("c_mktsegment", "in", values=[" building", "Machinery "]), "c_mktsegment IN ('BUILDING', 'MACHINERY')"), ("lt_text_number", where("c_name", "lt", 5), "false"),
]:
    add(f"filter_{_name}", "customer", [_where, CUST], f"SELECT {C} FROM {ODD_SQL} WHERE {_sql}", before=ODD)
add("filter_equals_day", "orders", [where("o_orderdate", "equals", "2/3/1995"), select("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE = DATE '1995-03-02'")
add("filter_gt_day", "orders", [where("o_orderdate", "gt", "1998-07-01"), select("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '1998-07-01'")

# --- columns
add("select_columns", "lineitem", [LINE], f"SELECT {L} FROM lineitem")
add("drop_columns", "nation", [{"op": "drop_columns", "columns": ["n_regionkey"]}], "SELECT n_nationkey, n_name FROM nation")
add("rename", "nation", [{"op": "rename", "mapping": {"n_name": "n_nationkey", "n_nationkey": "n_name"}}], "SELECT n_name AS n_nationkey, n_nationkey AS n_name, n_regionkey FROM nation")
add("compute_tax", "lineitem", [{"op": "compute", "name": "taxed", "expr": "round([l_extendedprice] * (1 - [l_discount]) * (1 + [l_tax]), 2)"}, select("l_orderkey", "l_linenumber", "taxed")], "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * (1.0::DOUBLE - l_discount) * (1.0::DOUBLE + l_tax), 2) AS taxed FROM lineitem", digits=2)
add("compute_div_zero", "lineitem", [{"op": "compute", "name": "ratio", "expr": "[l_tax] / [l_discount]"}, select("l_orderkey", "l_linenumber", "ratio")], "SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 4) AS ratio FROM lineitem")
add("days_between", "lineitem", [{"op": "compute", "name": "age", "expr": "days([l_shipdate], today())"}, {"op": "compute", "name": "w", "expr": "weeks([l_shipdate], today())"}, select("l_orderkey", "l_linenumber", "age", "w")], f"SELECT l_orderkey, l_linenumber, (DATE '{TODAY}' - l_shipdate::DATE)::DOUBLE AS age, floor((DATE '{TODAY}' - l_shipdate::DATE) / 7.0)::DOUBLE AS w FROM lineitem")
_M = f"(year(DATE '{TODAY}') - year(o_orderdate)) * 12 + month(DATE '{TODAY}') - month(o_orderdate) - CASE WHEN day(DATE '{TODAY}') < day(o_orderdate) THEN 1 ELSE 0 END"
add("months_between", "orders", [{"op": "compute", "name": "m", "expr": "months([o_orderdate], today())"}, {"op": "compute", "name": "y", "expr": "years([o_orderdate], today())"}, select("o_orderkey", "m", "y")], f"SELECT o_orderkey, ({_M})::DOUBLE AS m, floor(({_M}) / 12.0)::DOUBLE AS y FROM orders")
for _part, _sql in {"year": "year(o_orderdate)::BIGINT", "quarter": "year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate)", "month": "strftime(o_orderdate, '%Y-%m')", "week": "strftime(o_orderdate, '%G-W%V')", "weekday": "dayname(o_orderdate)", "day": "strftime(o_orderdate, '%Y-%m-%d')"}.items():
    add(f"date_part_{_part}", "orders", [{"op": "date_part", "column": "o_orderdate", "part": _part, "name": "p"}, select("o_orderkey", "p")], f"SELECT o_orderkey, {_sql} AS p FROM orders")

# --- order
add("sort_multi", "supplier", [{"op": "sort", "columns": ["s_nationkey", "s_acctbal"], "ascending": False}, {"op": "top_n", "n": 40}, select("s_suppkey", "s_nationkey")], "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey DESC NULLS LAST, s_acctbal DESC NULLS LAST, s_suppkey LIMIT 40")
add("sort_all", "supplier", [{"op": "sort", "columns": ["s_nationkey", "s_acctbal"], "ascending": False}, {"op": "compute", "name": "one", "expr": "1"}, {"op": "calculate", "kind": "running_total", "column": "one", "name": "place"}, select("s_suppkey", "place")], "SELECT s_suppkey, (row_number() OVER (ORDER BY s_nationkey DESC, s_acctbal DESC, s_suppkey))::DOUBLE AS place FROM supplier")
add("sort_full", "lineitem", [{"op": "sort", "columns": ["l_extendedprice"], "ascending": False}, LINE], f"SELECT {L} FROM lineitem", after=lambda sheet: sheet.output())
add("sort_blanks_last", "customer", [{"op": "sort", "columns": ["segment"]}, {"op": "compute", "name": "one", "expr": "1"}, {"op": "calculate", "kind": "running_total", "column": "one", "name": "place"}, select("c_custkey", "place")], f"SELECT c_custkey, (row_number() OVER (ORDER BY CASE WHEN trim(segment) <> '' THEN segment END NULLS LAST, c_custkey))::DOUBLE AS place FROM {DIRTY_SQL}", before=DIRTY)
add("top_n", "lineitem", [{"op": "top_n", "n": 25, "column": "l_extendedprice"}, LINE], f"SELECT {L} FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
add("bottom_n", "lineitem", [{"op": "top_n", "n": 25, "column": "l_extendedprice", "largest": False}, LINE], f"SELECT {L} FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 25")
add("top_n_per_group", "lineitem", [{"op": "top_n", "n": 3, "column": "l_extendedprice", "per": "l_returnflag"}, LINE], f"SELECT {L} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
add("first_n", "orders", [{"op": "top_n", "n": 30}, select("o_orderkey")], "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30")
add("last_n", "orders", [{"op": "top_n", "n": 30, "largest": False}, select("o_orderkey")], "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 30")
_E = select("event_id", "user_id", "event_type")
add("dedupe_first", "events", [{"op": "dedupe", "columns": ["user_id", "event_type"]}, _E], "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
add("dedupe_last", "events", [{"op": "dedupe", "columns": ["user_id", "event_type"], "keep": "last"}, _E], "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
add("dedupe_rows", "customer", [select("c_nationkey", "c_mktsegment"), {"op": "dedupe"}], "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
add("split_by", "customer", [{"op": "split_by", "column": "segment"}], f"SELECT c_custkey, coalesce(nullif(trim(segment), ''), '(blank)') AS sheet FROM {DIRTY_SQL}", before=DIRTY, after=lambda sheet: sheet.df.select("c_custkey", F.col(sheet.split[0]).alias("sheet")))

# --- groups
add("group_sum", "lineitem", [where("l_quantity", "gt", 25), {"op": "group_by", "columns": ["l_returnflag"], "aggregations": [{"column": "l_extendedprice", "func": "sum"}, {"column": "l_returnflag", "func": "count"}]}, {"op": "sort", "columns": ["sum_l_extendedprice"], "ascending": False}], "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, count(*) AS count_l_returnflag FROM lineitem WHERE l_quantity > 25 GROUP BY 1", digits=2)
add("group_mean_max", "lineitem", [{"op": "group_by", "columns": ["l_returnflag", "l_linestatus"], "aggregations": [{"column": "l_quantity", "func": "mean"}, {"column": "l_quantity", "func": "max"}, {"column": "l_discount", "func": "min"}]}], "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean_l_quantity, max(l_quantity) AS max_l_quantity, min(l_discount) AS min_l_discount FROM lineitem GROUP BY 1, 2")
add("group_count", "customer", [{"op": "group_by", "columns": ["c_nationkey"], "aggregations": [{"column": "segment", "func": "count"}]}], f"SELECT c_nationkey, count(nullif(trim(segment), '')) AS count_segment FROM {DIRTY_SQL} GROUP BY 1", before=DIRTY)
add("group_nunique", "events", [{"op": "group_by", "columns": ["event_type"], "aggregations": [{"column": "user_id", "func": "nunique"}]}], "SELECT event_type, count(DISTINCT user_id) AS nunique_user_id FROM events GROUP BY 1")
add("group_calculated", "lineitem", [{"op": "group_by", "columns": ["l_returnflag"], "calculated": {"rate": "[l_discount] / [l_quantity] * 100"}}], "SELECT l_returnflag, round(sum(l_discount) / nullif(sum(l_quantity), 0) * 100, 4) AS rate FROM lineitem GROUP BY 1")
add("group_global", "orders", [{"op": "group_by", "aggregations": [{"column": "o_totalprice", "func": "sum"}, {"column": "o_orderkey", "func": "count"}]}], "SELECT round(sum(o_totalprice), 2) AS sum_o_totalprice, count(o_orderkey) AS count_o_orderkey FROM orders", digits=2)
_RATE = "count(*) AS \"rows\", coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0)::BIGINT AS \"matching rows\", floor(sum(CASE WHEN {c} THEN 1 ELSE 0 END)::DOUBLE / count(*) * 10000 + 0.5) / 100 AS \"% matching\""
add("rate_by", "orders", [{"op": "rate", "columns": ["o_orderpriority"], "when": {"conditions": [{"column": "o_totalprice", "operator": "gt", "value": 150000}]}}], f"SELECT o_orderpriority, {_RATE.format(c='o_totalprice > 150000')} FROM orders GROUP BY 1")
add("rate_overall", "lineitem", [{"op": "rate", "formula": "=[l_discount]>[l_tax]"}], f"SELECT {_RATE.format(c='l_discount > l_tax')} FROM lineitem")


def _pivot_sql(value: str, source: str = "lineitem", fill: bool = True) -> str:
    cell = lambda f: f"coalesce({value.format(f=f)}, 0)" if fill else value.format(f=f)
    body = ", ".join(f"{cell(f' FILTER (WHERE l_linestatus = {s!r})')} AS \"{s}\"" for s in ("F", "O"))
    return f"SELECT l_returnflag, {body}, {cell('')} AS \"Total\" FROM {source} GROUP BY 1 UNION ALL SELECT 'Total', {body}, {cell('')} FROM {source}"


_P = {"op": "pivot", "rows": ["l_returnflag"], "columns": ["l_linestatus"]}
add("pivot_sum", "lineitem", [_P | {"values": "l_quantity", "func": "sum"}], _pivot_sql("round(sum(l_quantity){f}, 2)"), digits=2)
add("pivot_count", "lineitem", [_P], _pivot_sql("count(*){f}"))
add("pivot_mean_totals", "lineitem", [_P | {"values": "l_quantity", "func": "mean"}], _pivot_sql("round(avg(l_quantity){f}, 4)", fill=False))
add("pivot_max", "lineitem", [_P | {"values": "l_extendedprice", "func": "max"}], _pivot_sql("max(l_extendedprice){f}", fill=False))
add("pivot_nunique", "lineitem", [_P | {"values": "l_suppkey", "func": "nunique"}], _pivot_sql("count(DISTINCT l_suppkey){f}"))
add("pivot_calculated", "lineitem", [{"op": "pivot", "rows": ["l_returnflag"], "calculated": {"rate": "[l_tax] / [l_quantity]"}}], "SELECT l_returnflag, round(sum(l_tax) / sum(l_quantity), 6) AS rate FROM lineitem GROUP BY 1 UNION ALL SELECT 'Total', round(sum(l_tax) / sum(l_quantity), 6) FROM lineitem", digits=6)

add("pivot_blank", "customer", [{"op": "pivot", "rows": ["segment"], "columns": ["flag"], "totals": False}], f"SELECT coalesce(nullif(trim(segment), ''), '(blank)') AS segment, count(*) FILTER (WHERE c_custkey % 2 = 0) AS \"(blank)\", count(*) FILTER (WHERE c_custkey % 2 = 1) AS \"odd\" FROM {DIRTY_SQL} GROUP BY 1", before=lambda df: DIRTY(df).withColumn("flag", F.when(F.col("c_custkey") % 2 == 1, "odd")))

# --- windows
O = select("o_orderkey", "v")
add("percent_of_total", "orders", [{"op": "calculate", "kind": "percent_of_total", "column": "o_totalprice", "name": "v"}, O], "SELECT o_orderkey, round_even(o_totalprice / sum(o_totalprice) OVER () * 100, 2) AS v FROM orders", digits=2)
_SHARE = {"op": "calculate", "kind": "percent_of_total", "column": "o_totalprice", "per": "o_orderpriority", "name": "v"}
add("percent_of_total_all", "orders", [_SHARE, O], "SELECT o_orderkey, round_even(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority) * 100, 2) AS v FROM orders", digits=2)
add("percent_of_total_groups", "orders", [{"op": "group_by", "columns": ["o_orderpriority", "o_orderstatus"], "aggregations": [{"column": "o_totalprice", "func": "sum"}]}, _SHARE | {"column": "sum_o_totalprice"}, select("o_orderpriority", "o_orderstatus", "v")], "SELECT o_orderpriority, o_orderstatus, round_even(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority) * 100, 2) AS v FROM orders GROUP BY 1, 2", digits=2)
add("running_total", "orders", [{"op": "calculate", "kind": "running_total", "column": "o_custkey", "name": "v"}, O], "SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey))::DOUBLE AS v FROM orders")
add("running_total_per", "orders", [{"op": "calculate", "kind": "running_total", "column": "o_custkey", "per": "o_orderpriority", "name": "v"}, O], "SELECT o_orderkey, (sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey))::DOUBLE AS v FROM orders")
add("rank", "lineitem", [{"op": "calculate", "kind": "rank", "column": "l_quantity", "name": "v"}, select("l_orderkey", "l_linenumber", "v")], "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity DESC) AS v FROM lineitem")
add("rank_per", "lineitem", [{"op": "calculate", "kind": "rank", "column": "l_extendedprice", "per": "l_returnflag", "descending": False, "name": "v"}, select("l_orderkey", "l_linenumber", "v")], "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS v FROM lineitem")
add("rank_groups", "orders", [{"op": "group_by", "columns": ["o_orderpriority"], "aggregations": [{"column": "o_orderkey", "func": "count"}]}, {"op": "calculate", "kind": "rank", "column": "count_o_orderkey", "name": "v"}], "SELECT o_orderpriority, count(*) AS count_o_orderkey, rank() OVER (ORDER BY count(*) DESC) AS v FROM orders GROUP BY 1")

# --- cleaning
S = select("c_custkey", "segment")
add("clean_trim", "customer", [{"op": "clean_text", "action": "trim", "columns": ["segment"]}, S], f"SELECT c_custkey, nullif(trim(regexp_replace(segment, '\\s+', ' ', 'g')), '') AS segment FROM {DIRTY_SQL}", before=DIRTY)
add("clean_upper", "customer", [{"op": "clean_text", "action": "upper", "columns": ["segment"]}, S], f"SELECT c_custkey, upper(segment) AS segment FROM {DIRTY_SQL}", before=DIRTY)
add("clean_lower", "customer", [{"op": "clean_text", "action": "lower"}, select("c_custkey", "c_name")], "SELECT c_custkey, lower(c_name) AS c_name FROM customer")
add("clean_title", "part", [{"op": "clean_text", "action": "title", "columns": ["p_type"]}, select("p_partkey", "p_type")], "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_type FROM part")
add("fill_value", "customer", [{"op": "fill_blanks", "columns": ["segment"], "value": "none"}, S], f"SELECT c_custkey, CASE WHEN segment IS NULL OR trim(segment) = '' THEN 'none' ELSE segment END AS segment FROM {DIRTY_SQL}", before=DIRTY)
_KEPT = "CASE WHEN trim(segment) <> '' THEN segment END"
add("fill_down", "customer", [{"op": "fill_blanks", "columns": ["segment"], "method": "down"}, S], f"SELECT c_custkey, last_value({_KEPT} IGNORE NULLS) OVER (ORDER BY c_custkey) AS segment FROM {DIRTY_SQL}", before=DIRTY)
add("fill_up", "customer", [{"op": "fill_blanks", "columns": ["segment"], "method": "up"}, S], f"SELECT c_custkey, last_value({_KEPT} IGNORE NULLS) OVER (ORDER BY c_custkey DESC) AS segment FROM {DIRTY_SQL}", before=DIRTY)
add("drop_blank_any", "customer", [{"op": "drop_blank_rows", "how": "any"}, S], f"SELECT c_custkey, segment FROM {DIRTY_SQL} WHERE trim(segment) <> ''", before=DIRTY)
add("drop_blank_all", "customer", [select("segment", "empty"), {"op": "drop_blank_rows"}, select("segment")], f"SELECT segment FROM {DIRTY_SQL} WHERE trim(segment) <> ''", before=lambda df: DIRTY(df).withColumn("empty", F.lit(" ")))
add("replace_text", "part", [{"op": "replace", "columns": ["p_type"], "find": "steel", "replace": "$1 iron"}, select("p_partkey", "p_type")], "SELECT p_partkey, nullif(regexp_replace(p_type, 'steel', '$1 iron', 'gi'), '') AS p_type FROM part")
add("replace_number", "part", [{"op": "replace", "columns": ["p_size"], "find": "7", "replace": "70"}, select("p_partkey", "p_size")], "SELECT p_partkey, CASE WHEN p_size = 7 THEN 70 ELSE p_size END AS p_size FROM part")
add("split_column", "part", [{"op": "split_column", "column": "p_type", "delimiter": " ", "names": ["a", "b"]}, select("p_partkey", "a", "b")], "SELECT p_partkey, nullif(trim(split_part(p_type, ' ', 1)), '') AS a, nullif(trim(p_type[length(split_part(p_type, ' ', 1)) + 2:]), '') AS b FROM part")
add("merge_columns", "customer", [{"op": "merge_columns", "columns": ["c_name", "segment"], "separator": " / ", "name": "m"}, select("c_custkey", "m")], f"SELECT c_custkey, concat_ws(' / ', nullif(trim(c_name), ''), nullif(trim(segment), '')) AS m FROM {DIRTY_SQL}", before=DIRTY)
add("convert_number", "customer", [{"op": "convert", "columns": ["money"], "to": "number"}, select("c_custkey", "money")], "SELECT c_custkey, round(abs(c_acctbal), 2) AS money FROM customer", before=DIRTY, digits=2)
add("convert_date", "orders", [{"op": "convert", "columns": ["d"], "to": "date"}, select("o_orderkey", "d")], "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders", before=lambda df: df.withColumn("d", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d-M-yyyy")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))))
add("convert_text", "lineitem", [{"op": "convert", "columns": ["l_quantity"], "to": "text"}, select("l_orderkey", "l_linenumber", "l_quantity")], "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR AS l_quantity FROM lineitem")
_case = lambda op, v, out: {"when": {"conditions": [{"column": "p_size", "operator": op, "value": v}]}, "value": out}
add("label_bands", "part", [{"op": "label", "name": "band", "cases": [_case("lt", 10, "small"), _case("lt", 30, "middle")], "default": "large", "ordered": True}, {"op": "group_by", "columns": ["band"], "aggregations": [{"column": "p_partkey", "func": "count"}]}], "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS band, count(*) AS count_p_partkey FROM part GROUP BY 1")
add("label_replace", "part", [{"op": "label", "name": "p_size", "cases": [_case("gte", 40, "99")], "replace": True}, select("p_partkey", "p_size")], "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 99.0 ELSE p_size END::DOUBLE AS p_size FROM part")

# --- second tables
add("lookup_first", "orders", [{"op": "lookup", "file": "c", "left_on": "o_custkey", "right_on": "c_custkey", "columns": ["c_name", "c_acctbal"]}, select("o_orderkey", "c_name", "c_acctbal")], "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey", {"c": "customer"})
add("lookup_repeated_keys", "nation", [{"op": "lookup", "file": "s", "left_on": "n_nationkey", "right_on": "s_nationkey", "columns": ["s_name"]}], "SELECT n.*, s_name FROM nation n LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey", {"s": "supplier"})
add("lookup_clash", "nation", [{"op": "rename", "mapping": {"n_name": "r_name"}}, {"op": "lookup", "file": "r", "left_on": "n_regionkey", "right_on": "r_regionkey"}], "SELECT n_nationkey, n_name AS r_name, n_regionkey, r.r_name AS \"r_name (r)\" FROM nation LEFT JOIN region r ON n_regionkey = r_regionkey", {"r": "region"})
add("append_union", "nation", [{"op": "rename", "mapping": {"n_nationkey": "R RegionKey", "n_name": "R_Name"}}, {"op": "append", "file": "r"}], "SELECT n_nationkey AS \"R RegionKey\", n_name AS \"R_Name\", n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region", {"r": "region"})
_CMP = lambda keep: [{"op": "compare", "file": "o", "left_on": "c_custkey", "right_on": "o_custkey", "keep": keep}]
add("compare_both", "customer", [*_CMP("both"), select("c_custkey")], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", {"o": "orders"})
add("compare_only_here", "customer", [*_CMP("only_here"), select("c_custkey")], "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", {"o": "orders"})
add("compare_only_there", "customer", [where("c_mktsegment", "equals", "BUILDING"), *_CMP("only_there"), select("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", {"o": "orders"})
add("compare_only_there_all", "customer", [where("c_acctbal", "gt", 0), *_CMP("only_there"), select("o_orderkey")], "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", {"o": "orders"})
add("compare_blank_keys", "customer", [{"op": "compare", "file": "r", "left_on": "segment", "right_on": "r_name", "keep": "only_here"}, CUST], f"SELECT {C} FROM {DIRTY_SQL}", {"r": "region"}, before=DIRTY)
add("compare_blank_keys_both", "customer", [{"op": "compare", "file": "n", "left_on": "key", "right_on": "n_nationkey", "keep": "both"}, select("c_custkey")], "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0", {"n": "nation"}, before=lambda df: df.withColumn("key", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(".0"))).when(F.col("c_custkey") % 3 == 1, " ")))
add("append_big", "customer", [select("big"), {"op": "append", "file": "o"}, select("big")], f"SELECT big FROM {ODD_SQL} UNION ALL SELECT NULL FROM nation", {"o": "nation"}, before=ODD)
add("compare_rows", "supplier", [select("s_nationkey"), {"op": "rename", "mapping": {"s_nationkey": "n_nationkey"}}, {"op": "compare", "file": "n", "keep": "both"}], "SELECT s_nationkey AS n_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)", {"n": "nation"})


# --- spreadsheet formulas
def add_formula(name: str, source: str, text: str, sql: str, digits: int = 4, before: Callable | None = None, rows: str = "") -> None:
    keys = KEYS[source]
    add(f"formula_{name}", source, [{"op": "formula", "name": "v", "formula": text}, select(*keys, "v")], f"SELECT {', '.join(keys)}, {sql} AS v FROM {rows or source}", digits=digits, before=before)


add_formula("if", "lineitem", "=IF([l_quantity]>25,\"big\",\"small\")", "CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END")
add_formula("ifs", "part", "=IFS([p_size]<10,1,[p_size]<30,2,TRUE,3)", "CASE WHEN p_size < 10 THEN 1.0 WHEN p_size < 30 THEN 2.0 ELSE 3.0 END::DOUBLE")
add_formula("iferror", "lineitem", "=IFERROR([l_tax]/[l_discount],-1)", "round(CASE WHEN l_discount = 0 THEN -1 ELSE l_tax / l_discount END, 4)")
add_formula("switch", "lineitem", "=SWITCH([l_returnflag],\"A\",\"accepted\",\"r\",\"returned\",\"other\")", "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'other' END")
add_formula("text", "part", "=UPPER(LEFT([p_name],3))&\"-\"&RIGHT([p_brand],2)&\"/\"&LEN([p_type])", "upper(left(p_name, 3)) || '-' || right(p_brand, 2) || '/' || length(p_type)")
add_formula("text_number", "part", "=TEXT([p_retailprice],\"#,##0.0\")", "format('{:,.1f}', floor(p_retailprice * 10 + 0.5) / 10)")
add_formula("text_date", "orders", "=TEXT([o_orderdate],\"dd/mm/yyyy\")", "strftime(o_orderdate, '%d/%m/%Y')")
add_formula("find", "part", "=IFERROR(FIND(\"B\",[p_type]),0)", "instr(p_type, 'B')::DOUBLE")
add_formula("substitute", "part", "=SUBSTITUTE([p_type],\" \",\"_\")", "replace(p_type, ' ', '_')")
add_formula("eomonth", "orders", "=EOMONTH([o_orderdate],1)", "strftime(last_day(o_orderdate::DATE + INTERVAL 1 MONTH), '%Y-%m-%d')")
add_formula("datedif", "orders", f"=DATEDIF([o_orderdate],DATE(1998,8,2),\"M\")", f"CASE WHEN o_orderdate::DATE <= DATE '{TODAY}' THEN ({_M})::DOUBLE END")
add_formula("networkdays", "orders", "=NETWORKDAYS([o_orderdate],DATE(1998,8,2))", f"CASE WHEN o_orderdate::DATE <= DATE '{TODAY}' THEN len(list_filter(range(o_orderdate::DATE, DATE '1998-08-03', INTERVAL 1 DAY), lambda d: isodow(d) < 6)) ELSE -len(list_filter(range(DATE '{TODAY}', o_orderdate::DATE + 1, INTERVAL 1 DAY), lambda d: isodow(d) < 6)) END::DOUBLE")
add_formula("round", "lineitem", "=ROUNDUP([l_extendedprice]/1000,0)+ROUNDDOWN([l_quantity]/7,0)+MOD([l_linenumber],3)", "(ceil(l_extendedprice / 1000) + floor(l_quantity / 7) + l_linenumber % 3)::DOUBLE")
add_formula("share_of_sum", "orders", "=ROUND([o_totalprice]/SUM([o_totalprice])*1000000,1)", "floor(o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 1000000 * 10 + 0.5) / 10", digits=1)
add_formula("median", "part", "=[p_retailprice]>MEDIAN([p_retailprice])", "p_retailprice > (SELECT median(p_retailprice) FROM part)")
add_formula("countif", "customer", "=COUNTIF([c_mktsegment],[c_mktsegment])", "(count(*) OVER (PARTITION BY lower(c_mktsegment)))::DOUBLE")
add_formula("countif_other", "nation", "=COUNTIF([n_regionkey],[n_nationkey])", "(SELECT count(*) FROM nation x WHERE x.n_regionkey = nation.n_nationkey)::DOUBLE")
add_formula("countifs", "customer", "=COUNTIFS([c_mktsegment],\"b*\",[c_acctbal],\">0\")", "(SELECT count(*) FROM customer WHERE lower(c_mktsegment) LIKE 'b%' AND c_acctbal > 0)::DOUBLE")
add_formula("sumif", "supplier", "=SUMIF([s_nationkey],[s_nationkey],[s_acctbal])", "round(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 2)", digits=2)
add_formula("sumifs", "lineitem", "=SUMIFS([l_quantity],[l_returnflag],\"R\",[l_discount],\">=0.05\")", "(SELECT sum(l_quantity) FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05::DOUBLE)")
add_formula("averageif", "part", "=AVERAGEIF([p_brand],[p_brand],[p_retailprice])", "round(avg(p_retailprice) OVER (PARTITION BY p_brand), 3)", digits=3)


_FILLED = "CASE WHEN trim(segment) <> '' THEN segment END"
for _name, _text, _sql in [
    ("ifna", '=IFNA(SWITCH([c_mktsegment],"BUILDING",1),0)', "CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END::DOUBLE"), ("not", "=NOT([c_acctbal]>0)", "NOT c_acctbal > 0"),
    ("xor", "=XOR([c_acctbal]>0,[c_nationkey]>10,[c_custkey]>100)", "((c_acctbal > 0)::INT + (c_nationkey > 10)::INT + (c_custkey > 100)::INT) % 2 = 1"),
    ("isblank", "=ISBLANK([segment])", f"{_FILLED} IS NULL"), ("istext", "=ISTEXT([segment])", f"{_FILLED} IS NOT NULL"), ("isnumber", "=ISNUMBER([c_acctbal]/[c_nationkey])", "c_nationkey <> 0"),
    ("iserror", "=ISERROR(1/[c_nationkey])", "c_nationkey = 0"), ("isna", "=ISNA(IFS([c_nationkey]>5,1))", "c_nationkey <= 5"),
    ("abs", "=ABS([c_acctbal])", "round(abs(c_acctbal), 4)"), ("int", "=INT([c_acctbal])", "floor(c_acctbal)"), ("sign", "=SIGN([c_acctbal])", "sign(c_acctbal)::DOUBLE"), ("sqrt", "=IFERROR(SQRT([c_acctbal]),-1)", "CASE WHEN c_acctbal < 0 THEN -1 ELSE round(sqrt(abs(c_acctbal)), 4) END"),
    ("power", "=POWER([c_nationkey],2)+[c_nationkey]^0.5", "round(c_nationkey ** 2 + sqrt(c_nationkey), 4)"), ("ceiling", "=CEILING([c_acctbal],5)", "ceil(c_acctbal / 5) * 5"), ("floor", "=FLOOR([c_acctbal],5)", "floor(c_acctbal / 5) * 5"), ("trunc", "=TRUNC([c_acctbal],1)", "trunc(round(c_acctbal * 10, 6)) / 10"),
    ("mid", "=MID([c_name],3,5)", "substr(c_name, 3, 5)"), ("lower", "=LOWER([c_mktsegment])", "lower(c_mktsegment)"), ("proper", "=PROPER([c_mktsegment])", "left(c_mktsegment, 1) || lower(substr(c_mktsegment, 2))"), ("trim", "=TRIM([segment])", f"coalesce(trim(regexp_replace({_FILLED}, '\\s+', ' ', 'g')), '')"),
    ("clean", "=CLEAN([control])", "c_name || 'x'"), ("concat", '=CONCAT([c_name],"-",[c_nationkey])', "c_name || '-' || c_nationkey"), ("concatenate", '=CONCATENATE([segment],"/",[c_nationkey])', f"coalesce({_FILLED}, '') || '/' || c_nationkey"), ("textjoin", '=TEXTJOIN("/",TRUE,[segment],[c_name],"")', f"concat_ws('/', {_FILLED}, c_name)"),
    ("replace", '=REPLACE([c_name],1,3,"X")', "'X' || substr(c_name, 4)"), ("search", '=IFERROR(SEARCH("b",[c_mktsegment]),0)', "instr(lower(c_mktsegment), 'b')::DOUBLE"), ("exact", '=EXACT([c_mktsegment],"BUILDING")', "c_mktsegment = 'BUILDING'"), ("rept", '=REPT("ab",[c_nationkey])', "repeat('ab', c_nationkey)"), ("value", "=VALUE([money])", "round(abs(c_acctbal), 2)"),
    ("average", "=ROUND([c_acctbal]-AVERAGE([c_acctbal]),2)", "floor(abs(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) * 100 + 0.5) / 100 * sign(c_acctbal - (SELECT avg(c_acctbal) FROM customer))"), ("max_min", "=MAX([c_acctbal])-MIN([c_acctbal])", "(SELECT round(max(c_acctbal) - min(c_acctbal), 4) FROM customer)"),
    ("counts", "=COUNT([c_acctbal])*1000+COUNTA([segment])", f"(SELECT count(c_acctbal) * 1000.0 + count({_FILLED}) FROM {DIRTY_SQL})::DOUBLE"), ("averageif_text", '=AVERAGEIF([c_mktsegment],"m*",[c_acctbal])', "(SELECT round(avg(c_acctbal), 4) FROM customer WHERE c_mktsegment LIKE 'M%')"),
]:
    add_formula(_name, "customer", _text, _sql, before=lambda df: DIRTY(df).withColumn("control", F.concat(F.col("c_name"), F.lit("\t"), F.lit("x\x07"))), rows=DIRTY_SQL)
_DAY = "o_orderdate::DATE"
_SAME = f"(make_date(1998, month({_DAY}), 1) + day({_DAY})::INT - 1)"
for _name, _text, _sql in [
    ("today", "=TODAY()-[o_orderdate]", f"(DATE '{TODAY}' - {_DAY})::DOUBLE"), ("now", "=YEAR(NOW())*100+MONTH(NOW())", "199808.0::DOUBLE"), ("year_month_day", "=YEAR([o_orderdate])*10000+MONTH([o_orderdate])*100+DAY([o_orderdate])", "strftime(o_orderdate, '%Y%m%d')::DOUBLE"),
    ("weekday", "=WEEKDAY([o_orderdate])*100+WEEKDAY([o_orderdate],2)*10+WEEKDAY([o_orderdate],3)", f"((dayofweek({_DAY}) + 1) * 100 + isodow({_DAY}) * 10 + isodow({_DAY}) - 1)::DOUBLE"), ("edate", "=EDATE([o_orderdate],1)", f"strftime({_DAY} + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    ("days", "=DAYS(DATE(1998,8,2),[o_orderdate])", f"(DATE '{TODAY}' - {_DAY})::DOUBLE"), ("datedif_yd", '=DATEDIF([o_orderdate],DATE(1998,8,2),"YD")', f"CASE WHEN {_DAY} <= DATE '{TODAY}' THEN (DATE '{TODAY}' - CASE WHEN {_SAME} <= DATE '{TODAY}' THEN {_SAME} ELSE make_date(1997, month({_DAY}), 1) + day({_DAY})::INT - 1 END)::DOUBLE END"),
    ("datedif_md", '=DATEDIF([o_orderdate],DATE(1998,3,2),"MD")', f"CASE WHEN {_DAY} <= DATE '1998-03-02' THEN (2 - day({_DAY}) + CASE WHEN day({_DAY}) > 2 THEN 28 ELSE 0 END)::DOUBLE END"), ("datedif_ym", '=DATEDIF([o_orderdate],DATE(1998,8,2),"YM")', f"CASE WHEN {_DAY} <= DATE '{TODAY}' THEN (({_M}) % 12)::DOUBLE END"),
]:
    add_formula(_name, "orders", _text, _sql)


# --- sql, profile, formats
def add_sql(name: str, sql: str, names: list[str]) -> None:
    CATALOGUE[name] = (lambda spark, sf_dir: run_sql(spark, sql, {n: table(spark, sf_dir, n) for n in names}), sql)


add_sql("sql_join", "SELECT n_name, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", ["orders", "customer", "nation"])
add_sql("sql_cte_union", "WITH a AS (SELECT n_name AS name FROM nation), b AS (SELECT r_name AS name FROM region) SELECT name FROM a UNION SELECT name FROM b", ["nation", "region"])
add_sql("sql_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS m FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", ["lineitem"])


def add_query(name: str, query: Callable, sql: str) -> None:
    CATALOGUE[name] = (query, sql)


add_query("sample_rows", lambda s, d: P.sample(table(s, d, "orders"), 500), "")
add_query("value_counts", lambda s, d: P.value_counts(table(s, d, "events"), "event_type"), "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
_PROFILED = ["c_mktsegment", "c_acctbal", "segment"]
add_query("profile_columns", lambda s, d: P.profile(DIRTY(table(s, d, "customer")).select(*_PROFILED)), " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL OR trim({c}::VARCHAR) = '') AS n_blank, count(DISTINCT CASE WHEN trim({c}::VARCHAR) <> '' THEN {c} END) AS n_distinct FROM {DIRTY_SQL}" for c in _PROFILED))
add_query("findings", lambda s, d: P.findings(DIRTY(table(s, d, "customer")).select("segment")), f"SELECT 'blanks' AS finding, 'segment' AS name, count(*) AS n FROM {DIRTY_SQL} WHERE segment IS NULL OR trim(segment) = '' UNION ALL SELECT 'stray spaces', 'segment', count(*) FROM {DIRTY_SQL} WHERE trim(segment) <> '' AND segment <> trim(regexp_replace(segment, '\\s+', ' ', 'g')) UNION ALL SELECT 'empty rows', NULL, count(*) FROM {DIRTY_SQL} WHERE segment IS NULL OR trim(segment) = '' UNION ALL SELECT 'repeated rows', NULL, (sum(n) - count(*))::BIGINT FROM (SELECT count(*) AS n FROM {DIRTY_SQL} GROUP BY segment)")
add_query("personal_data", lambda s, d: table(s, d, "documents").select(F.explode(personal_data(F.col("text"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for k, p in PATTERNS.items()))
add_query("highlight_duplicates", lambda s, d: _highlighted(table(s, d, "customer")), "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 AS marked FROM customer")
add_query("chart_data", lambda s, d: _shown(groups.chart_data(sheet_of(table(s, d, "orders"), ["o_orderkey"]), {"x": "o_orderdate", "x_part": "year", "y": "o_totalprice", "func": "sum"}, Context()), 2), "SELECT year(o_orderdate)::BIGINT AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")


def _highlighted(df: DataFrame) -> DataFrame:
    both = df.withColumn("k", F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    marked = run_plan(sheet_of(both, ["c_custkey"]), [{"op": "highlight", "duplicates_in": "k"}])
    return marked.df.select("c_custkey", F.col("__hl0").alias("marked"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
