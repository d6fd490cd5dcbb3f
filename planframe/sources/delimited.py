"""Delimited text: read as text and typed by all its values, written in row order."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..sheet import HIDDEN, Sheet
from ..sqlgate import MOST_ROWS, run_sql

#: Delimiters that are tried.
DELIMITERS = ",;\t|"
#: A plain decimal of 15 characters at most; one with leading zeros is an identifier.
PLAIN = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
LONGEST = 15


def clean_header(names: list[str | None]) -> list[str]:
    """Names for blank headers, numbers behind those that occur twice, whatever their case."""
    out, taken = [], set()
    for i, name in enumerate(names):
        stem = " ".join((name or "").split()) or f"Column {i + 1}"
        new, n = stem, 2
        while new.lower() in taken:
            new, n = f"{stem} ({n})", n + 1
        taken.add(new.lower())
        out.append(new)
    return out


def typed(df: DataFrame) -> DataFrame:
    """Text columns as numbers where every value is one; blanks are NULL. One aggregate for all columns."""
    names = [c for c in df.columns if not c.startswith(HIDDEN)]
    if not names:
        return df
    marks = []
    for i, c in enumerate(names):
        x = F.when(~V.is_blank(V.col(c)), V.strip(V.col(c)))
        marks += [F.bool_and(x.rlike(PLAIN) & (F.length(x) <= LONGEST)).alias(f"n{i}"), F.bool_or(x.contains(".")).alias(f"f{i}")]
    seen = df.agg(*marks).first()
    out = []
    for i, c in enumerate(names):
        x = F.nullif(V.col(c), F.lit(""))
        if seen[f"n{i}"]:
            x = V.strip(x).try_cast("double" if seen[f"f{i}"] else "bigint")
        out.append(x.alias(c))
    return df.select(*out, *[c for c in df.columns if c.startswith(HIDDEN)])


def sniff(line: str) -> str:
    """The delimiter that occurs most in a line outside quotes."""
    bare = "".join(line.split('"')[::2])
    return max(DELIMITERS, key=bare.count)


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str | None = None, multiline: bool = False) -> Sheet:
    """Rows in file order. ``multiline`` allows line ends inside quotes; Spark then reads each file in one task.

    An empty file: no columns, no rows. Short rows: NULL. Only ``columns`` are parsed where given.
    """
    first = spark.read.text(path).filter(F.length(V.strip(F.col("value"))) > 0).first()
    if first is None:
        return Sheet(spark.range(0).select(F.lit("").alias("__o0"), F.lit(0).alias("__o1"), F.lit(0).alias("__o2")), [("__o0", True), ("__o1", True), ("__o2", True)])
    line = first[0].lstrip("﻿")
    delimiter = delimiter or sniff(line)
    names = clean_header(next(csv.reader([line], delimiter=delimiter)))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    raw = spark.read.csv(path, schema=schema, header=True, sep=delimiter, quote='"', escape='"', mode="PERMISSIVE", multiLine=multiline, enforceSchema=True)
    places = [F.col("_metadata.file_path").alias("__o0"), F.col("_metadata.file_block_start").alias("__o1"), F.monotonically_increasing_id().alias("__o2")]
    rows = raw.select(*[V.col(c) for c in columns or names], *places)
    return Sheet(typed(rows), [("__o0", True), ("__o1", True), ("__o2", True)])


def head_of(spark: SparkSession, path: str, lines: int = 200) -> dict:
    """Headers, delimiter and about how many rows: the bytes of the files over the mean length of the first ``lines`` lines. Only the first lines are read."""
    some = [r[0] for r in spark.read.text(path).filter(F.length(V.strip(F.col("value"))) > 0).limit(lines + 1).collect()]
    if not some:
        return {"headers": [], "delimiter": ",", "rows": 0}
    line = some[0].lstrip("\ufeff")
    delimiter = sniff(line)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    mean = sum(len(x.encode()) + 1 for x in some[1:]) / max(1, len(some) - 1)
    rows = len(some) - 1 if len(some) <= lines else max(0, round((size - len(line.encode()) - 1) / mean))
    return {"headers": clean_header(next(csv.reader([line], delimiter=delimiter))), "delimiter": delimiter, "rows": rows}


def run_sql_on_files(spark: SparkSession, sql: str, paths: dict[str, str], most: int | None = MOST_ROWS) -> DataFrame:
    """One checked SELECT over delimited and Parquet files by name; nothing is loaded beforehand."""
    tables = {n: spark.read.parquet(p) if p.rstrip("/").endswith(".parquet") else read_delimited(spark, p).output(ordered=False) for n, p in paths.items()}
    return run_sql(spark, sql, tables, most)


def write_delimited(sheet: Sheet, path: str, delimiter: str = ",") -> None:
    """Part files in row order; a sheet that is split gets a folder for each value."""
    out = sheet.df.repartitionByRange(*[F.col(s) for s in sheet.split], *sheet.by_order()) if sheet.split or sheet.order else sheet.df
    out = out.sortWithinPartitions(*sheet.split, *sheet.by_order()) if sheet.split or sheet.order else out
    marks = {s: f"sheet{i or ''}" for i, s in enumerate(sheet.split)}
    shown = out.select(*[V.col(c) for c in sheet.columns], *[F.col(s).alias(n) for s, n in marks.items()])
    writer = shown.write.mode("errorifexists").option("header", True).option("sep", delimiter).option("escape", '"')
    (writer.partitionBy(*marks.values()) if marks else writer).csv(path)
