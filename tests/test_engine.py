"""Plans on small dirty tables, and refusals."""

import pytest
from pyspark.sql import functions as F

from planframe import profile
from planframe.plans.engine import Session, run_plan
from planframe.sheet import PlanError, safe_name, sheet_of
from planframe.sqlgate import run_sql


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, " Ann ", 10.0, "₹1,200", "5/3/2025"), (2, None, float("nan"), "Rs. 5", "2025-03-31"), (3, "", None, "7", "29 Feb 2024"), (4, "ann", 30.0, None, None), (5, "o'neil abc1def", 0.0, "", "31/01/2025")]
    return sheet_of(spark.createDataFrame(data, "id int, name string, x double, money string, day string").repartition(3), ["id"])


def values(sheet, *names):
    return [tuple(r[n] for n in names) for r in sheet.output().collect()]


def test_blanks_are_kept_by_negations(rows):
    keep = lambda op, v: [i for (i,) in values(run_plan(rows, [{"op": "filter", "conditions": [{"column": "name", "operator": op, "value": v}]}]), "id")]
    assert keep("equals", "ANN") == [1, 4] and keep("not_equals", "ann") == [2, 3, 5]
    assert keep("is_empty", None) == [2, 3] and keep("contains", "ANN") == [1, 4] and keep("not_contains", "ann") == [2, 3, 5]


def test_order_windows_and_fill(rows):
    out = run_plan(rows, [{"op": "fill_blanks", "columns": ["name"], "method": "down"}, {"op": "calculate", "kind": "running_total", "column": "x", "name": "run"}, {"op": "calculate", "kind": "rank", "column": "x", "name": "r"}])
    assert values(out, "id", "name", "run", "r") == [(1, " Ann ", 10.0, 2), (2, " Ann ", None, None), (3, " Ann ", None, None), (4, "ann", 40.0, 1), (5, "o'neil abc1def", 40.0, 3)]


def test_cleaning_and_conversion(rows):
    out = run_plan(rows, [{"op": "clean_text", "action": "title", "columns": ["name"]}, {"op": "convert", "columns": ["money"], "to": "number"}, {"op": "convert", "columns": ["day"], "to": "date"}])
    got = values(out, "name", "money", "day")
    assert got[4][0] == "O'Neil Abc1Def" and [m for _, m, _ in got] == [1200.0, 5.0, 7.0, None, None]
    assert [str(d) for _, _, d in got] == ["2025-03-05", "2025-03-31", "2024-02-29", "None", "2025-01-31"]
    with pytest.raises(PlanError, match="are no number"):
        run_plan(rows, [{"op": "convert", "columns": ["name"], "to": "number"}])


def test_months_follow_the_calendar(spark):
    s = sheet_of(spark.createDataFrame([("29 Feb 2024", "28 Feb 2025"), ("31/1/2025", "28/2/2025")], "a string, b string"))
    out = run_plan(s, [{"op": "compute", "name": "m", "expr": "months([a],[b])"}])
    assert sorted(m for (m,) in values(out, "m")) == [0.0, 11.0]


def test_formulas(rows):
    f = lambda text: [v for (v,) in values(run_plan(rows, [{"op": "formula", "name": "v", "formula": text}]), "v")]
    assert f("=IFERROR(10/[x],\"none\")") == ["1", "none", "none", "0.3333333333333333", "none"]
    assert f("=IF([x]>5,1/0,2)") == [None, 2.0, 2.0, None, 2.0]
    assert f("=SUM([x])-MAX([x])") == [10.0] * 5 and f("=COUNTIF([name],\"*n*\")") == [3.0] * 5
    assert f("=SUBSTITUTE(\"a-b-c\",\"-\",\"+\",2)") == ["a-b+c"] * 5 and f("=-2^2") == [4.0] * 5
    assert f("=ROUND(-2.5)&TEXT(0.256,\"0.0%\")") == ["-325.6%"] * 5 and f("=TEXTJOIN(\"-\",TRUE,\"a\",\"\",\"b\")") == ["a-b"] * 5


def test_groups_and_totals(spark, rows):
    g = run_plan(rows, [{"op": "group_by", "columns": ["name"], "aggregations": [{"column": "x", "func": "sum"}], "calculated": {"r": "[x] / [id]"}}])
    assert {n: (s, r) for n, s, r in values(g, "name", "sum_x", "r")}[None] == (0.0, None)
    assert run_plan(rows, [{"op": "dedupe", "columns": ["name"], "keep": "last"}]).df.count() == 4


def test_refusals(rows):
    for plan in ([{"op": "nothing"}], [{"op": "sort"}], [{"op": "select_columns", "columns": ["no"]}], [{"op": "rename", "mapping": {"x": "id"}}], [{"op": "compute", "name": "v", "expr": "[name]+1"}], [{"op": "sort", "columns": ["x"], "odd": 1}]):
        with pytest.raises(ValueError):
            run_plan(rows, plan)


def test_session_and_names(rows):
    s = Session(rows)
    s.execute([{"op": "top_n", "n": 2}])
    assert s.sheet().df.count() == 2 and s.undo().df.count() == 5 and s.redo().df.count() == 2
    taken = set()
    assert safe_name("a/b", taken) == "a b" and safe_name("A?B", taken) == "A B (2)"


@pytest.mark.parametrize("sql", ["DROP TABLE t", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/x`", "SELECT reflect('a','b')", "SELECT * FROM other", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM t WHERE id IN (SELECT id FROM other)", "SELECT * FROM t a ASOF JOIN t b"])
def test_gate_refuses(spark, rows, sql):
    with pytest.raises(Exception):
        run_sql(spark, sql, {"t": rows.output()}).collect()


def test_gate_and_profile(spark, rows):
    assert run_sql(spark, 'SELECT "id" AS n FROM t WHERE id < 3', {"t": rows.output()}).count() == 2
    got = {r["name"]: r for r in profile.profile(rows.output()).collect()}
    assert got["name"]["n_blank"] == 2 and got["x"]["n_blank"] == 2 and got["id"]["n_distinct"] == 5


def test_shares_and_comparisons_over_whole_tables(spark):
    from planframe import queries

    data, made = "/root/testdata/sf0.001", queries.queries()
    orders = spark.read.parquet(f"{data}/orders.parquet")
    assert made["percent_of_total_all"](spark, data).count() == orders.count()
    shares = made["percent_of_total_groups"](spark, data).collect()
    assert len(shares) == orders.select("o_orderpriority", "o_orderstatus").distinct().count()
    assert abs(sum(r["v"] for r in shares) - 100 * len({r["o_orderpriority"] for r in shares})) < 0.1
    rich = spark.read.parquet(f"{data}/customer.parquet").filter("c_acctbal > 0")
    assert made["compare_only_there_all"](spark, data).count() == orders.join(rich, orders.o_custkey == rich.c_custkey, "left_anti").count() > 0


def test_notes_tell_what_steps_found(spark, rows):
    there = sheet_of(spark.createDataFrame([(1, "a", "u"), (2, "a", "v"), (3, "zz", "w")], "n int, key string, extra string"), ["n"])
    here = sheet_of(spark.createDataFrame([(1, "A "), (2, None), (3, "b")], "i int, key string"), ["i"])
    out = run_plan(here, [{"op": "lookup", "file": "t", "left_on": "key", "right_on": "key", "columns": ["extra"]}, {"op": "formula", "name": "f", "formula": "=1/([i]-1)"}, {"op": "highlight", "when": {"conditions": [{"column": "i", "operator": "gt", "value": 1}]}}], {"t": there})
    assert out.told() == ["t repeats 1 keys of key; the first row counts", "1 of 3 rows found a match in t; 2 had none", "f: 1 x #DIV/0!", "2 rows highlighted"]
    assert run_plan(here, [{"op": "append", "file": "t"}], {"t": there}).told() == ["only t has: n, extra", "t lacks: i", "3 rows of t added"]
    assert run_plan(here, [{"op": "compare", "file": "t", "left_on": "key", "right_on": "key", "keep": "only_here"}], {"t": there}).told() == ["1 rows have a blank key and match nothing", "2 rows of this data are not in t"]


def test_missing_columns_are_refused_before_anything_runs(spark, rows):
    steps = [{"op": "convert", "columns": ["name"], "to": "number"}, {"op": "rename", "mapping": {"x": "y"}}, {"op": "sort", "columns": ["x"]}]
    with pytest.raises(ValueError, match="'sort'.*'x'"):  # the conversion, which would fail first, has not run
        run_plan(rows, steps)
    with pytest.raises(ValueError, match="no table 'f'"):
        run_plan(rows, [{"op": "convert", "columns": ["name"], "to": "number"}, {"op": "append", "file": "f"}])


def test_descriptions_and_what_may_be_shared(spark):
    df = spark.createDataFrame([(i, f"p{i}", "x" if i % 3 else " y ", i % 2, float(i), None if i % 4 else "d", f"2024-01-{i % 28 + 1:02d}") for i in range(100)], "order_id int, phone string, state string, active int, amt double, note string, day string").withColumn("day", F.col("day").cast("date"))
    got = {c["name"]: c for c in profile.describe_columns(df)}
    assert [got[c]["role"] for c in ("order_id", "phone", "state", "active", "amt", "note", "day")] == ["id", "text", "category", "flag", "amount", "category", "date"]
    assert got["order_id"]["withheld"] == "an identifier" and got["phone"]["withheld"] == "looks like personal data" and "low" not in got["order_id"]
    assert got["state"]["values"] == [("x", 0.66), ("y", 0.34)] and got["active"]["values"] == [("0", 0.5), ("1", 0.5)] and (got["amt"]["low"], got["amt"]["high"], got["amt"]["mean"]) == (0, 99, 49.5)
    assert got["note"]["blank"] == 0.75 and str(got["day"]["low"]) == "2024-01-01" and "values" not in got["amt"]
    assert profile.not_shared(df) == "it has more than 60 rows" and "phone" in profile.not_shared(df.limit(5).select("phone", "amt")) and profile.not_shared(df.groupBy("state").sum("amt")) is None


def test_findings_come_with_the_step_that_mends_them(spark):
    df = spark.createDataFrame([("2024-01-05", "Rs. 1,000", "New  York", 1), ("5/1/2024", "20", "new york", 2), ("6/1/2024", "30", "Pune", None), ("6/1/2024", "30", "Pune", None), (None, None, " ", None)], "d string, amt string, city string, n int")
    got = {(r["finding"], r["name"]): r for r in profile.mends(df)}
    assert {("mixed dates", "d"), ("dates as text", "d"), ("amounts as text", "amt"), ("spellings apart", "city"), ("stray spaces", "city"), ("empty rows", None), ("repeated rows", None), ("blanks", "n")} <= set(got)
    plan = "[" + ",".join(got[k]["step"] for k in [("empty rows", None), ("repeated rows", None), ("stray spaces", "city"), ("spellings apart", "city"), ("amounts as text", "amt"), ("mixed dates", "d"), ("blanks", "n")]) + "]"
    out = run_plan(sheet_of(df, ["d"]), plan).output(ordered=False)
    assert sorted(tuple(map(str, r)) for r in out.collect()) == [("2024-01-05", "1000.0", "New York", "1"), ("2024-01-05", "20.0", "New York", "2"), ("2024-01-06", "30.0", "Pune", "0")]
