"""Projections, computed columns and cleaning."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.formula import arithmetic, formula
from ..sheet import PlanError, Sheet


def _texts(sheet: Sheet, names) -> list[str]:
    if names:
        sheet.need(*names)
        return list(names)
    return [c for c in sheet.columns if sheet.kind(c) == "text"]


def _after(sheet: Sheet, source: str, new: dict) -> Sheet:
    """New columns right after their source; existing ones stay where they are."""
    out = {}
    for c in sheet.columns:
        out[c] = new.get(c, V.col(c))
        if c == source:
            out |= {n: e for n, e in new.items() if n not in sheet.columns}
    return sheet.project(out)


def select_columns(sheet: Sheet, step: dict, ctx) -> Sheet:
    sheet.need(*step["columns"])
    return sheet.project({c: V.col(c) for c in step["columns"]})


def drop_columns(sheet: Sheet, step: dict, ctx) -> Sheet:
    sheet.need(*step["columns"])
    return sheet.project({c: V.col(c) for c in sheet.columns if c not in step["columns"]})


def rename(sheet: Sheet, step: dict, ctx) -> Sheet:
    mapping = step["mapping"]
    sheet.need(*mapping)
    names = [mapping.get(c, c) for c in sheet.columns]
    if len(set(names)) < len(names):
        raise PlanError("two columns would have one name")
    return sheet.project({n: V.col(c) for n, c in zip(names, sheet.columns)})


def compute(sheet: Sheet, step: dict, ctx) -> Sheet:
    if step["name"] in sheet.columns and not step.get("replace"):
        raise PlanError(f"there is a column {step['name']!r} already")
    return sheet.with_df(sheet.df.withColumn(step["name"], arithmetic(sheet.df, step["expr"], ctx.today)))


def error_note(df, cell, name: str):
    """Counts the errors of a formula by their kinds."""

    def count() -> str:
        found = df.select(cell.error.alias("e")).filter("e is not null").groupBy("e").count().orderBy("e").collect()
        return f"{name}: " + ", ".join(f"{r['count']:,} x {r['e']}" for r in found) if found else ""

    return count


def add_formula(sheet: Sheet, step: dict, ctx) -> Sheet:
    if step["name"] in sheet.columns and not step.get("replace"):
        raise PlanError(f"there is a column {step['name']!r} already")
    df, cell = formula(sheet.df, step["formula"], ctx.today)
    return sheet.noting(error_note(df, cell, step["name"])).with_df(df.withColumn(step["name"], cell.value).drop(*[c for c in df.columns if c.startswith("__agg")]))


PARTS = {
    "year": lambda d: F.year(d).cast("bigint"),
    "quarter": lambda d: F.concat(F.year(d), F.lit("-Q"), F.quarter(d)),
    "month": lambda d: F.date_format(d, "yyyy-MM"),
    "week": lambda d: F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.weekofyear(d), 2, "0")),
    "weekday": lambda d: F.date_format(d, "EEEE"),
    "day": lambda d: F.date_format(d, "yyyy-MM-dd"),
}
#: Days in the order of the week.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def date_part(sheet: Sheet, step: dict, ctx) -> Sheet:
    name, part = step["column"], step["part"]
    sheet.need(name)
    out = step.get("name") or f"{name}_{part}"
    made = PARTS[part](V.read_date(V.col(name), sheet.kind(name)))
    sheet = sheet.with_df(sheet.df.withColumn(out, made))
    return sheet.with_df(sheet.df, orders=sheet.orders | {out: WEEKDAYS}) if part == "weekday" else sheet


def clean_text(sheet: Sheet, step: dict, ctx) -> Sheet:
    action = {
        "trim": lambda c: F.nullif(V.strip(F.regexp_replace(c, V.SPACE_RUN, " ")), F.lit("")),
        "upper": F.upper,
        "lower": F.lower,
        "title": V.title,
    }[step["action"]]
    some = _texts(sheet, step.get("columns"))
    return sheet.project({c: action(V.col(c)) if c in some and sheet.kind(c) == "text" else V.col(c) for c in sheet.columns})


def drop_blank_rows(sheet: Sheet, step: dict, ctx) -> Sheet:
    blanks = [V.is_blank(V.col(c), sheet.kind(c)) for c in sheet.columns]
    out = blanks[0]
    for b in blanks[1:]:
        out = out & b if step.get("how", "all") == "all" else out | b
    return sheet.with_df(sheet.df.filter(~out))


def replace_values(sheet: Sheet, step: dict, ctx) -> Sheet:
    """Text: every occurrence, case ignored; numbers: whole values only."""
    find, new = str(step["find"]), str(step["replace"])
    some = _texts(sheet, step.get("columns"))
    out = {}
    for c in sheet.columns:
        x = V.col(c)
        if c in some and sheet.kind(c) == "text":
            safe = new.replace("\\", "\\\\").replace("$", "\\$")
            quoted = r"\Q" + find.replace("\\E", "\\E\\\\E\\Q") + r"\E"
            x = F.nullif(F.regexp_replace(x, "(?iu)" + quoted, safe), F.lit(""))
        elif c in some and sheet.kind(c) == "number":
            try:
                old, fresh = float(find), (float(new) if new.strip() else None)
                x = F.when(x.cast("double") == old, F.lit(fresh).cast(sheet.df.schema[c].dataType)).otherwise(x)
            except ValueError:
                pass
        out[c] = x
    return sheet.project(out)


def split_column(sheet: Sheet, step: dict, ctx) -> Sheet:
    name, names = step["column"], step["names"]
    sheet.need(name)
    quoted = r"\Q" + step["delimiter"].replace("\\E", "\\E\\\\E\\Q") + r"\E"
    parts = F.split(V.text_of(V.col(name), sheet.kind(name)), quoted, len(names))
    return _after(sheet, name, {n: F.nullif(V.strip(F.get(parts, F.lit(i))), F.lit("")) for i, n in enumerate(names)})


def merge_columns(sheet: Sheet, step: dict, ctx) -> Sheet:
    names = step["columns"]
    sheet.need(*names)
    parts = [F.nullif(V.strip(V.text_of(V.col(c), sheet.kind(c))), F.lit("")) for c in names]
    return _after(sheet, names[-1], {step["name"]: F.nullif(F.concat_ws(step.get("separator", " "), *parts), F.lit(""))})


def convert(sheet: Sheet, step: dict, ctx) -> Sheet:
    """Values that cannot be read stop the plan, with their number and three examples."""
    to, some = step["to"], step["columns"]
    sheet.need(*some)
    made, checks = {}, []
    for c in some:
        kind, x = sheet.kind(c), V.col(c)
        if to == "text":
            made[c] = V.text_of(x, kind)
            continue
        made[c] = V.to_number(x, kind) if to == "number" else V.read_date(x, kind)
        if kind == "text":
            bad = F.when(~V.is_blank(x) & made[c].isNull(), x)
            checks += [F.count(bad), F.min(bad)]
    if checks:
        row = sheet.df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks)]).first()
        for i, c in enumerate(x for x in some if sheet.kind(x) == "text"):
            if row[2 * i]:
                examples = [r[0] for r in sheet.df.filter(~V.is_blank(V.col(c)) & made[c].isNull()).select(V.col(c)).limit(3).collect()]
                raise PlanError(f"{row[2 * i]} values of {c!r} are no {to}, such as {', '.join(map(repr, examples))}")
    return sheet.project({c: made.get(c, V.col(c)) for c in sheet.columns})
