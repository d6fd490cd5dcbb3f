"""Conditions reach the Parquet scan."""

import re

import pytest
from pyspark.sql import functions as F

from planframe import queries as Q
from planframe.plans.engine import run_plan
from planframe.sheet import sheet_of


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("typed") / "t.parquet")
    rows = spark.range(20).select(
        F.col("id"), F.col("id").cast("int").alias("i"), F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 5 == 1, None).otherwise(F.col("id") / 2).alias("d"),
        F.col("id").cast("decimal(9,2)").alias("m"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(cast(id as int))").alias("at"), F.concat(F.lit(" T"), F.col("id")).alias("t"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def pushed(df) -> str:
    return re.search(r"PushedFilters: \[(.*?)\]\n", df._jdf.queryExecution().executedPlan().toString().replace(", ReadSchema", "]\n") + "]\n")[1]


def filtered(df, *conditions, match="all", today="2024-01-15"):
    return run_plan(sheet_of(df, ["id"]), [{"op": "filter", "conditions": list(conditions), "match": match}], today=today).output(ordered=False)


def where(column, operator, value=None, **more):
    return {"column": column, "operator": operator, "value": value, **more}


@pytest.mark.parametrize(
    ("conditions", "match", "parts", "ids"),
    [
        ([where("i", "gt", 15.5)], "all", ["GreaterThan(i,15)"], [16, 17, 18, 19]),
        ([where("d", "gte", 8)], "all", ["GreaterThanOrEqual(d,8.0)"], [17, 18, 19]),
        ([where("d", "lt", 2)], "all", ["LessThan(d,2.0)"], [2, 3]),
        ([where("d", "gt", 1, negate=True)], "all", ["LessThanOrEqual(d,1.0)"], [2]),
        ([where("m", "lte", 1)], "all", ["m,1"], [0, 1]),
        ([where("i", "in", values=[1, "2.0", 2.5, "x"])], "all", ["In(i, [1,2])"], [1, 2]),
        ([where("day", "gte", "18/1/2024"), where("i", "lt", 19)], "all", ["GreaterThanOrEqual(day,2024-01-18)", "LessThan(i,19)"], [17, 18]),
        ([where("at", "gt", "2024-01-18")], "all", ["GreaterThanOrEqual(at,2024-01-19T00:00)"], [18, 19]),
        ([where("at", "equals", "2024-01-18")], "all", ["GreaterThanOrEqual(at,2024-01-18T00:00)", "LessThan(at,2024-01-19T00:00)"], [17]),
        ([where("day", "within_last_days", -3)], "all", ["GreaterThanOrEqual(day,2024-01-18)"], [17, 18, 19]),
        ([where("at", "older_than_days", 12)], "all", ["LessThan(at,2024-01-03T00:00)"], [0, 1]),
        ([where("t", "equals", "t7 ")], "all", ["IsNotNull(t)"], [7]),
        ([where("i", "equals", 3), where("d", "gt", 8)], "any", ["Or(EqualTo(i,3),And(GreaterThan(d,8.0),LessThanOrEqual(d,Infinity)))"], [3, 17, 18, 19]),
        ([where("d", "is_empty")], "all", [], [0, 1, 5, 6, 10, 11, 15, 16]),
        ([where("d", "not_empty"), where("i", "lt", 5)], "all", ["IsNotNull(d)", "LessThan(i,5)"], [2, 3, 4]),
    ],
)
def test_conditions_reach_the_scan(typed, conditions, match, parts, ids):
    out = filtered(typed, *conditions, match=match)
    plan = pushed(out)
    assert all(p in plan for p in parts), plan
    assert sorted(r["id"] for r in out.collect()) == ids


@pytest.mark.parametrize("name", ["filter_gt", "filter_between", "filter_in", "filter_date_range", "filter_older_than", "filter_within_last", "filter_equals_text", "group_sum", "filter_gt_day"])
def test_queries_push_their_filters(spark, name):
    assert pushed(Q.queries()[name](spark, "/root/testdata/sf0.001"))


def test_filters_out_of_range(typed):
    count = lambda *a, **k: filtered(typed, where(*a, **k)).count()
    assert count("i", "lt", 1e30) == 20 and count("i", "gt", 1e30) == 0 and count("i", "gte", -1e30) == 20 and count("i", "lt", 3_000_000_000) == 20
    assert count("i", "equals", 1e30) == 0 and count("d", "equals", "nan") == 0 and count("d", "gt", "no date") == 0
