"""Steps that never change data: highlights and number formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..sheet import PlanError, Sheet
from .filters import all_of


def highlight(sheet: Sheet, step: dict, ctx) -> Sheet:
    """A hidden flag beside the rows: those of a filter, or those whose value occurs more than once."""
    mark = sheet.fresh("hl")
    if step.get("duplicates_in"):
        name = step["duplicates_in"]
        sheet.need(name)
        key = V.match_key(V.col(name), sheet.kind(name))
        twice = sheet.df.select(key.alias("__d")).filter("__d is not null").groupBy("__d").count().filter("count > 1").select("__d", F.lit(True).alias(mark))
        df = sheet.df.withColumn("__key", key).join(twice, F.col("__key") == F.col("__d"), "left").drop("__key", "__d")
        df = df.withColumn(mark, F.coalesce(mark, F.lit(False)))
    else:
        df = sheet.df.withColumn(mark, all_of(sheet, step["when"], ctx.today))
    return sheet.noting(lambda: f"{df.filter(mark).count():,} rows highlighted").with_df(df, formats=sheet.formats | {mark: {"highlight": step.get("color", "yellow"), "column": step.get("column")}})


def number_format(sheet: Sheet, step: dict, ctx) -> Sheet:
    sheet.need(*step["columns"])
    for c in step["columns"]:
        wrong = sheet.kind(c) == "text" if step["style"] != "date" else sheet.kind(c) not in ("date", "text")
        if wrong:
            raise PlanError(f"{c!r} cannot be shown as {step['style']}: convert it first")
    new = {c: {k: step.get(k) for k in ("style", "decimals", "date_pattern")} for c in step["columns"]}
    return sheet.with_df(sheet.df, formats=sheet.formats | new)
