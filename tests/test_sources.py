"""Files in and out."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from planframe.plans.engine import run_plan
from planframe.profile import sample
from planframe.sheet import PlanError, sheet_of
from planframe.sources.delimited import clean_header, read_delimited, sniff, write_delimited
from planframe.sources.workbook import read_workbook, rows_of, write_workbook


def test_header_and_delimiter():
    assert clean_header(["a", "", "A", "a", " b  c "]) == ["a", "Column 2", "A (2)", "a (3)", "b c"]
    assert [sniff(x) for x in ("a,b;c,d", "a;b;c", "a\tb", "a|b", '"x;y;z",b', "one")] == [",", ";", "\t", "|", ",", ","]


def test_delimited_types_and_order(spark, tmp_path):
    path = tmp_path / "in.csv"
    lines = [f'0{i % 7},{i},{i / 4},"x, ""{i}""",' for i in range(5000)]
    path.write_text("﻿\n\nid,n,x,text,none\n".lstrip("\n") + "\n".join(lines) + "\n", encoding="utf-8")
    sheet = read_delimited(spark, str(path))
    kinds = dict(sheet.output().dtypes)
    assert kinds == {"id": "string", "n": "bigint", "x": "double", "text": "string", "none": "string"}
    rows = sheet.output().collect()
    assert [r["n"] for r in rows] == list(range(5000))
    assert rows[7]["text"] == 'x, "7"' and rows[7]["id"] == "00" and rows[7]["none"] is None
    assert read_delimited(spark, str(path), ["x"]).columns == ["x"]


def test_delimited_empty_and_multiline(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert read_delimited(spark, str(tmp_path / "e.csv")).columns == []
    (tmp_path / "m.csv").write_text('a;b\n"one\ntwo";3\n')
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "m.csv"), multiline=True).output().collect()] == [("one\ntwo", 3)]


def test_delimited_round_trip_and_split(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("k"), F.concat(F.lit('say "'), "id", F.lit('", ok')).alias("t"))
    sheet = run_plan(sheet_of(df, ["id"]), [{"op": "sort", "columns": ["id"], "ascending": False}])
    write_delimited(sheet, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"')
    assert sorted(map(tuple, back.collect())) == sorted((str(r[0]), r[1], r[2]) for r in df.collect())
    write_delimited(run_plan(sheet, [{"op": "split_by", "column": "k"}]), str(tmp_path / "parts"))
    assert sorted(p.name for p in (tmp_path / "parts").glob("sheet=*")) == ["sheet=0", "sheet=1", "sheet=2"]


def test_workbook_round_trip(spark, tmp_path):
    rows = [(1, "a <b> & \"c\"", 2.5, datetime.date(2024, 2, 29), True), (2, None, None, None, False), (3, " lead", -1e-7, datetime.date(1999, 12, 31), None)]
    df = spark.createDataFrame(rows, "id long, `te xt` string, x double, d date, b boolean")
    path = str(tmp_path / "book.xlsx")
    assert write_workbook(sheet_of(df, ["id"]), path) == ["Sheet1"]
    sheet = read_workbook(spark, path)["Sheet1"]
    assert dict(sheet.output().dtypes) == {"id": "bigint", "te xt": "string", "x": "double", "d": "date", "b": "boolean"}
    assert [tuple(r) for r in sheet.output().collect()] == rows


def test_workbook_split_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b", 5), (2, "A:B", 6), (3, " ", 7)], "id long, k string, v long")
    sheet = run_plan(sheet_of(df, ["id"]), [{"op": "number_format", "columns": ["v"], "style": "commas"}, {"op": "split_by", "column": "k"}])
    path = str(tmp_path / "s.xlsx")
    names = write_workbook(sheet, path)
    assert sorted(names) == ["(blank)", "A B", "a b (2)"]
    with zipfile.ZipFile(path) as book:
        assert "#,##0" in book.read("xl/styles.xml").decode()
    assert set(read_workbook(spark, path)) == set(names)
    assert len(list(rows_of((tmp_path / "s.xlsx").read_bytes()))) == 6


def test_workbook_refuses_too_many_rows(spark, tmp_path):
    with pytest.raises(PlanError):
        write_workbook(sheet_of(spark.range(1_048_576).toDF("id"), ["id"]), str(tmp_path / "big.xlsx"))


def test_date_text_sorts_as_dates(spark):
    df = spark.createDataFrame([(1, "02/01/2025"), (2, "01/12/2024"), (3, ""), (4, "15 Mar 2024")], "id long, d string")
    out = run_plan(sheet_of(df, ["id"]), [{"op": "sort", "columns": ["d"]}]).output().collect()
    assert [r["id"] for r in out] == [4, 2, 1, 3]


def test_sample_is_repeatable(spark):
    df = spark.range(1000).toDF("id")
    a, b = ({r["id"] for r in sample(d, 50).collect()} for d in (df, df.repartition(7)))
    assert a == b and len(a) == 50 and sample(df, 2000).count() == 1000


@pytest.mark.parametrize("plan", [[{"op": "dedupe", "columns": ["k"]}], [{"op": "top_n", "n": 2, "column": "v", "per": "k"}]])
def test_groups_are_cut_before_the_shuffle(spark, plan):
    """A key with most rows leaves each task with the few that may stay."""
    df = spark.range(1000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), (F.col("id") % 10).alias("v"))
    shown = run_plan(sheet_of(df, ["id"]), plan).df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in shown and "Partial" in shown


def test_head_of_delimited_text_and_sql_over_files(spark, tmp_path):
    from planframe.sheet import main_sheet, sheet_of
    from planframe.sources.delimited import head_of, run_sql_on_files

    path, other = tmp_path / "big.csv", tmp_path / "p.parquet"
    path.write_text("\ufeffId; Name ;Name\n" + "".join(f"{i};n{i % 7};x\n" for i in range(5000)))
    head = head_of(spark, str(path))
    assert head["headers"] == ["Id", "Name", "Name (2)"] and head["delimiter"] == ";" and abs(head["rows"] - 5000) < 1000
    few = tmp_path / "few.csv"
    few.write_text("a,b\n1,2\n\n3,4\n")
    (tmp_path / "none.csv").write_text("")
    assert head_of(spark, str(few))["rows"] == 2 and head_of(spark, str(tmp_path / "none.csv"))["headers"] == []
    spark.createDataFrame([("n1", 5)], "name string, w int").write.parquet(str(other))
    out = run_sql_on_files(spark, "SELECT sum(Id) AS s, max(w) AS w FROM big JOIN p ON big.Name = p.name", {"big": str(path), "p": str(other)})
    assert tuple(out.first()) == (sum(i for i in range(5000) if i % 7 == 1), 5)
    assert main_sheet({"a": sheet_of(spark.range(2).toDF("x"), ["x"]), "b": sheet_of(spark.range(5).toDF("x"), ["x"])}) == "b"
