"""Reports, definitions, highlights, privacy, and both ways of walking an order."""

import zipfile

import pytest
from pyspark.sql import functions as F

from planframe import lineage, privacy, profile
from planframe.plans.engine import run_plan
from planframe.report import HOW, Definition, Dictionary, Result, write_report
from planframe.sheet import PlanError, sheet_of
from planframe.sources.workbook import read_workbook, write_workbook


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7 % 50).cast("double")).alias("v"))
    return sheet_of(df, ["id"])


@pytest.mark.parametrize("per", [None, "k"])
@pytest.mark.parametrize("down", [True, False])
def test_long_groups_agree_with_windows(rows, monkeypatch, per, down):
    plan = [{"op": "calculate", "kind": "running_total", "column": "v", "name": "run"} | ({"per": per} if per else {}), {"op": "calculate", "kind": "rank", "column": "v", "name": "r", "descending": down} | ({"per": per} if per else {}), {"op": "fill_blanks", "columns": ["v"], "method": "down" if down else "up"}]
    short = run_plan(rows, plan).output().collect()
    monkeypatch.setattr(lineage, "WINDOW_ROWS", 10)
    assert run_plan(rows, plan).output().collect() == short
    assert short[0]["v"] == (None if down else 7.0) and short[1]["run"] == 7.0


@pytest.mark.parametrize("size", [10, 1_000_000])
def test_medians_of_many_values(spark, rows, monkeypatch, size):
    from planframe.functions.formula import median

    monkeypatch.setattr(lineage, "WINDOW_ROWS", size)
    assert median(rows.df, F.col("id").cast("double")) == 199.5 and median(rows.df.filter("id < 7"), F.col("id").cast("double")) == 3 and median(rows.df.limit(0), F.col("v")) is None
    assert median(rows.df, F.col("v")) == rows.df.agg(F.median("v")).first()[0]


def test_pivot_totals_come_from_rows(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0, "2/1/2025"), (2, "a", "y", 2.0, "1/12/2024"), (3, "b", "x", 6.0, None), (4, "b", "x", 1.0, "2/1/2025")], "id int, r string, c string, v double, d string")
    made = lambda func, v: [tuple(x) for x in run_plan(sheet_of(df, ["id"]), [{"op": "pivot", "rows": ["r"], "columns": ["c"], "values": v, "func": func}]).output().collect()]
    assert made("mean", "v") == [("a", 1.0, 2.0, 1.5), ("b", 3.5, None, 3.5), ("Total", pytest.approx(8 / 3), 2.0, 2.5)]
    assert made("nunique", "v") == [("a", 1, 1, 2), ("b", 2, 0, 2), ("Total", 2, 1, 3)]
    assert made("min", "d") == [("a", "2/1/2025", "1/12/2024", "1/12/2024"), ("b", "2/1/2025", None, "2/1/2025"), ("Total", "2/1/2025", "1/12/2024", "1/12/2024")]
    assert made("count", "d")[1] == ("b", 1, 0, 1) and made("sum", "v")[2] == ("Total", 8.0, 2.0, 10.0)


def test_number_formats_keep_decimals_and_patterns(spark, tmp_path):
    """The formats that a plan asks for stand in the file, each at its column."""
    import re

    df = spark.createDataFrame([(1, 1234567.5, 2.25, 3.5)], "id int, a double, b double, c double").withColumn("d", F.lit("2025-01-02").cast("date"))
    steps = [{"op": "number_format", "columns": ["a"], "style": "rupees"}, {"op": "number_format", "columns": ["b"], "style": "decimals", "decimals": 3}, {"op": "number_format", "columns": ["c"], "style": "decimals", "decimals": 0}, {"op": "number_format", "columns": ["d"], "style": "date", "date_pattern": "yyyy-mm"}]
    path = str(tmp_path / "f.xlsx")
    write_workbook(run_plan(sheet_of(df, ["id"]), steps), path)
    with zipfile.ZipFile(path) as book:
        page, styles = (book.read(f"xl/{n}.xml").decode() for n in ("worksheets/sheet1", "styles"))
    codes = [re.sub("&quot;|&gt;", lambda m: {"&quot;": '"', "&gt;": ">"}[m[0]], c) for c in re.findall(r"""formatCode=["'](.*?)["']/>""", styles)]
    of = {c: codes[int(s) - 2] for c, s in re.findall(r'<c r="([A-E])2" s="(\d+)"', page)}
    assert of == {"B": '[>=10000000]"₹"##\\,##\\,##\\,##0.00;[>=100000]"₹"##\\,##\\,##0.00;"₹"#,##0.00', "C": "#,##0.000", "D": "#,##0", "E": "yyyy-mm"}


def test_highlights_fill_cells(rows, tmp_path):
    out = run_plan(rows, [{"op": "top_n", "n": 3}, {"op": "highlight", "when": {"conditions": [{"column": "id", "operator": "equals", "value": 1}]}, "color": "dark green", "column": "v"}])
    path = str(tmp_path / "h.xlsx")
    write_workbook(out, path)
    with zipfile.ZipFile(path) as book:
        page, styles = (book.read(f"xl/{n}.xml").decode() for n in ("worksheets/sheet1", "styles"))
    assert "FF93C47D" in styles and page.count(' s="7"') == 1 and '<c r="C3" s="7">' in page
    with pytest.raises(PlanError, match="no colour"):
        write_workbook(run_plan(rows, [{"op": "highlight", "duplicates_in": "k", "color": "beige"}]), path)


def test_report_tells_how(spark, rows, tmp_path):
    plan, path = [{"op": "top_n", "n": 2, "column": "v"}], str(tmp_path / "r.xlsx")
    assert write_report(spark, [Result("Best", run_plan(rows, plan), "rows", "the best", plan), Result("best", rows, "rows", sql="SELECT 1")], path) == ["Best", "best (2)", HOW]
    told = read_workbook(spark, path)[HOW].output().collect()
    assert told[0]["Steps (run on every row)"] == "top n n=2 column=v" and told[1]["Steps (run on every row)"].endswith("SELECT 1")


def test_definitions_follow_columns(rows, tmp_path):
    kept = Dictionary(str(tmp_path / "d.json"))
    kept.define(rows.columns, "user type", Definition("v", "gt", "40", "Old", "New"))
    step = Dictionary(kept.path).of(rows.columns)["user type"].step("type")
    assert {r["type"] for r in run_plan(rows, [step]).output().filter("v > 40").collect()} == {"Old"}
    assert kept.of(["other"]) == {}


def test_privacy(spark):
    df = spark.createDataFrame([(1, "Mira Kapoor", 4711, "north"), (2, "Al", 12, None), (3, None, None, "")], "id int, owner string, account int, region string")
    secret = privacy.secrets(df, ["owner", "account"], allowed=["kapoor"])
    assert {r["secret"] for r in secret.collect()} == {"mira kapoor", "mira", "4711"}
    texts = spark.createDataFrame([(1, "ask MIRA now"), (2, "owner of north"), (3, "write a.b@c.org, 9876543210"), (4, None), (5, "no 4711"), (6, "éABCDE1234Fé")], "id int, t string")
    got = {r["id"]: r["found"] for r in privacy.leaks(texts, "id", "t", secret).collect()}
    assert got == {1: ["a value from your file"], 3: ["a phone number", "an e-mail address"], 5: ["a value from your file"], 6: ["a PAN number"]}


def test_findings_of_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (" ", None), ("a", 1)], "k string, v int")
    assert {(r["finding"], r["n"]) for r in profile.findings(df).collect() if r["name"] is None} == {("empty rows", 1), ("repeated rows", 2)}
