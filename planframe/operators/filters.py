"""Conditions, filters and labels."""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.formula import formula
from ..sheet import PlanError, Sheet

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def holds(sheet: Sheet, c: dict, today: Column) -> Column:
    """True where the condition holds; false or NULL where not. With ``negate``, true where it does not hold (a comparison of
    sizes holds for no blank, negated or not).

    Comparisons stay in the column's own type without a cast or a replacement of NULL, so that they reach the scan.
    """
    name, op, value, negate = c["column"], c["operator"], c.get("value"), bool(c.get("negate"))
    sheet.need(name)
    kind, x, of = sheet.kind(name), V.col(name), sheet.df.schema[name].dataType
    if op in ("gt", "gte", "lt", "lte", "within_last_days", "older_than_days"):
        # a side of an edge, and whether the edge belongs to it: negated, both turn
        above, at = op[0] in "gw", op in ("gte", "lte", "within_last_days")
        side = (above != negate, at != negate)
        if op.endswith("days"):
            return _day(x, kind, of, side, F.date_sub(today, int(value)))
        number = _number(value)
        if kind == "date" or number is None:
            return _day(x, kind, of, side, V.read_date(F.lit(str(value))))
        return _size(x, of, side, number) if kind == "number" else _beside(V.to_number(x, kind), side, F.lit(float(number)))
    if op.startswith("not_"):
        op, negate = {"empty": "is_empty"}.get(op[4:], op[4:]), not negate
    if op == "is_empty":
        if negate:
            return x.isNotNull() & (V.strip(x) != "") if kind == "text" else x <= F.lit(math.inf) if isinstance(of, (T.DoubleType, T.FloatType)) else x.isNotNull()
        return V.is_blank(x, kind)
    if op in ("equals", "in"):
        found = _equal(x, kind, of, [value] if op == "equals" else c.get("values") or [])
    elif op == "contains":
        found = F.lower(V.text_of(x, kind)).contains(str(value).lower())
    else:
        raise PlanError(f"there is no operator {op!r}")
    return ~F.coalesce(found, F.lit(False)) if negate else x.isNotNull() & found if kind == "text" else found


def _beside(a: Column, side: tuple[bool, bool], edge: Column) -> Column:
    above, at = side
    return (a >= edge if at else a > edge) if above else (a <= edge if at else a < edge)


def _size(x: Column, of: T.DataType, side: tuple[bool, bool], number: Decimal) -> Column:
    above, at = side
    if isinstance(of, WHOLE):
        whole = math.floor(number) if above != at else math.ceil(number)  # the same rows, in whole numbers
        if not -(2**63) <= whole < 2**63:
            return x.isNotNull() if (whole > 0) != above else F.lit(False)
        return _beside(x, side, F.lit(whole))
    if isinstance(of, T.DecimalType):
        return _beside(x, side, F.lit(number))
    made = _beside(x, side, F.lit(float(number)))
    return made & (x <= F.lit(math.inf)) if above else made  # NaN is above every number


def _day(x: Column, kind: str, of: T.DataType, side: tuple[bool, bool], day: Column) -> Column:
    """Comparison of days; a column of times is compared with the beginning of the day, or of the next one."""
    if kind != "date" or isinstance(of, T.DateType):
        return _beside(V.read_date(x, kind), side, day)
    above, at = side
    return _beside(x, (above, above), (F.date_add(day, 1) if above != at else day).cast(of))


def _equal(x: Column, kind: str, of: T.DataType, values: list) -> Column:
    if kind == "number":
        numbers = [n for n in map(_number, values) if n is not None]
        if isinstance(of, WHOLE):
            numbers = [int(n) for n in numbers if n == int(n) and -(2**63) <= n < 2**63]
        elif not isinstance(of, T.DecimalType):
            numbers = [float(n) for n in numbers]
        return x.isin(numbers) if numbers else F.lit(False)
    if kind == "date" and len(values) == 1:
        day = V.read_date(F.lit(str(values[0])))
        return _day(x, kind, of, (True, True), day) & _day(x, kind, of, (False, True), day)
    return V.norm(x, kind).isin([str(v).strip(V.SPACES).lower() for v in values])


def _number(v) -> Decimal | None:
    try:
        number = Decimal(str(v).strip().replace(",", ""))
    except ArithmeticError:
        return None
    return number if number.is_finite() and abs(number.adjusted()) < 300 else None


def condition(sheet: Sheet, c: dict, today: Column) -> Column:
    """True or false, never NULL."""
    return F.coalesce(holds(sheet, c, today), F.lit(False))


def all_of(sheet: Sheet, when: dict, today: Column) -> Column:
    parts = [condition(sheet, c, today) for c in when["conditions"]]
    if not parts:
        raise PlanError("a filter needs a condition")
    join = (lambda a, b: a | b) if when.get("match", "all") == "any" else (lambda a, b: a & b)
    return reduce(join, parts)


def opposite(when: dict) -> dict:
    """The filter for the rows that a request removes: each condition negated, any of them where all were asked for."""
    return {"conditions": [c | {"negate": not c.get("negate")} for c in when["conditions"]], "match": "any" if when.get("match", "all") == "all" else "all"}


def filter_rows(sheet: Sheet, step: dict, ctx) -> Sheet:
    """A row stays where the conditions hold; NULL drops it like false, so nothing need be replaced."""
    parts = [holds(sheet, c, ctx.today) for c in step["conditions"]]
    if not parts:
        raise PlanError("a filter needs a condition")
    join = (lambda a, b: a | b) if step.get("match", "all") == "any" else (lambda a, b: a & b)
    return sheet.with_df(sheet.df.filter(reduce(join, parts)))


def filter_formula(sheet: Sheet, step: dict, ctx) -> Sheet:
    df, cell = formula(sheet.df, step["formula"], ctx.today)
    truth = {"bool": lambda: cell.value, "num": lambda: cell.value != 0}.get(cell.kind, lambda: F.lower(cell.value) == "true")()
    keep = truth & cell.error.isNull()
    from .columns import error_note

    return sheet.noting(error_note(df, cell, "filter")).with_df(df.filter(keep if step.get("keep", True) else ~F.coalesce(keep, F.lit(False))).drop(*[c for c in df.columns if c.startswith("__agg")]))


def label(sheet: Sheet, step: dict, ctx) -> Sheet:
    """The first case that fits gives the label."""
    name, cases, default = step["name"], step["cases"], step.get("default")
    exists = name in sheet.columns
    if exists and not step.get("replace"):
        raise PlanError(f"there is a column {name!r} already")
    given = [c["value"] for c in cases] + ([default] if default is not None else [])
    keeps = exists and step.get("replace") and default is None
    numeric = all(_number(v) is not None for v in given) and (not keeps or sheet.kind(name) == "number")
    lit = (lambda v: F.lit(float(_number(v)))) if numeric else (lambda v: F.lit(str(v)))
    other = (V.col(name).cast("double") if numeric else V.text_of(V.col(name), sheet.kind(name))) if keeps else F.lit(None) if default is None else lit(default)
    out = other
    for c in reversed(cases):
        out = F.when(all_of(sheet, c["when"], ctx.today), lit(c["value"])).otherwise(out)
    if step.get("ordered"):
        sheet = sheet.with_df(sheet.df, orders=sheet.orders | {name: list(dict.fromkeys(given))})
    return sheet.with_df(sheet.df.withColumn(name, out))
