"""Grouping, pivots, rates and chart data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.formula import arithmetic, formula, parse
from ..lineage import checkpointed
from ..sheet import PlanError, Sheet
from .filters import all_of

WIDEST = 50


def aggregate(sheet: Sheet, name: str, func: str, is_key: bool = False) -> Column:
    sheet.need(name)
    kind, c = sheet.kind(name), V.col(name)
    some = F.when(~V.is_blank(c, kind), c)
    if func == "count":
        return F.count(F.lit(1)) if is_key else F.count(some)
    if func == "nunique":
        return F.count_distinct(some)
    x = V.to_number(c, kind)
    if func == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if func == "mean":
        return F.avg(x)
    if func in ("min", "max"):
        best = F.min_by if func == "min" else F.max_by
        if kind != "text":
            return (F.min if func == "min" else F.max)(F.nanvl(c, F.lit(None).cast("double")) if kind == "number" and dict(sheet.df.dtypes)[name] == "double" else c)
        key = F.when(some.isNotNull(), F.struct(V.read_date(c).isNull(), V.read_date(c), c))
        return best(some, key)
    raise PlanError(f"there is no aggregate {func!r}")


def mergeable(sheet: Sheet, name: str, func: str, is_key: bool = False) -> tuple[list[Column], Column]:
    """Aggregates of a cell, and the aggregate over such cells that gives ``func`` over all their rows (all but nunique)."""
    if func == "count":
        return [aggregate(sheet, name, func, is_key).alias("cell")], F.coalesce(F.sum("cell"), F.lit(0))
    x = V.to_number(V.col(name), sheet.kind(name))
    if func == "sum":
        return [F.sum(x).alias("cell")], F.coalesce(F.sum("cell"), F.lit(0.0))
    if func == "mean":
        return [F.sum(x).alias("cell"), F.count(x).alias("__b")], F.try_divide(F.sum("cell"), F.sum("__b").cast("double"))
    one = aggregate(sheet, name, func).alias("cell")
    return [one], aggregate(Sheet(sheet.df.select(V.col(name).alias("cell"))), "cell", func)


def used_columns(expr: str) -> list[str]:
    out = []

    def walk(node):
        if node[0] == "col":
            out.append(node[1])
        for x in node[1:]:
            if isinstance(x, tuple):
                walk(x)
            elif isinstance(x, list):
                for y in x:
                    walk(y)

    walk(parse(expr))
    return list(dict.fromkeys(out))


def _calculated(sheet: Sheet, calculated: dict[str, str]) -> tuple[list[Column], dict[str, Column]]:
    """Sums of all columns that the formulas use, and the formulas over these sums: ratios of totals."""
    names = list(dict.fromkeys(c for e in calculated.values() for c in used_columns(e)))
    sheet.need(*names)
    sums = {c: f"__sum{i}" for i, c in enumerate(names)}
    aggs = [F.sum(V.to_number(V.col(c), sheet.kind(c))).alias(n) for c, n in sums.items()]
    return aggs, {n: arithmetic(sheet.df, e, resolve=lambda c: F.col(sums[c])) for n, e in calculated.items()}


def _ordered(df, keys: list[str], orders: dict, old: Sheet) -> Sheet:
    out = Sheet(df, [], orders={k: v for k, v in old.orders.items() if k in keys}, notes=old.notes)
    names = {f"__o{i}": (F.nullif(F.array_position(F.array(*[F.lit(v) for v in old.orders[k]]), V.col(k)), F.lit(0)) if k in old.orders else V.col(k)) for i, k in enumerate(keys)}
    return out.with_df(df.withColumns(names) if names else df, order=[(n, True) for n in names])


def group_by(sheet: Sheet, step: dict, ctx) -> Sheet:
    keys = step.get("columns") or []
    sheet.need(*keys)
    aggs = [aggregate(sheet, a["column"], a["func"], a["column"] in keys).alias(f"{a['func']}_{a['column']}") for a in step.get("aggregations") or []]
    more, made = _calculated(sheet, step.get("calculated") or {})
    if not aggs and not more:
        raise PlanError("a group needs something to calculate")
    df = sheet.df.groupBy(*[V.col(k) for k in keys]).agg(*aggs, *more)
    df = df.withColumns(made).drop(*[c for c in df.columns if c.startswith("__sum")]) if made else df
    return _ordered(df, keys, sheet.orders, sheet)


def rate(sheet: Sheet, step: dict, ctx) -> Sheet:
    """Rows, rows that match, and their percentage, for each group."""
    keys, df = step.get("columns") or [], sheet.df
    sheet.need(*keys)
    if step.get("formula"):
        df, cell = formula(df, step["formula"], ctx.today)
        hit = F.coalesce(cell.value & cell.error.isNull() if cell.kind == "bool" else cell.value != 0, F.lit(False))
    else:
        hit = all_of(sheet, step["when"], ctx.today)
    out = df.groupBy(*[V.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("matching rows"))
    share = F.floor(F.try_divide(F.col("`matching rows`").cast("double"), F.col("rows").cast("double")) * 10000 + 0.5) / 100
    return _ordered(out.withColumn("% matching", share), keys, sheet.orders, sheet)


def pivot(sheet: Sheet, step: dict, ctx) -> Sheet:
    """Body and true totals; totals come from sums and counts of the rows (for nunique from distinct values), not from the shown cells."""
    rows, across = step["rows"], step.get("columns") or []
    rows, across = ([rows] if isinstance(rows, str) else rows), ([across] if isinstance(across, str) else across)
    sheet.need(*rows, *across)
    func, value, totals = step.get("func", "count"), step.get("values"), step.get("totals", True)
    shown = lambda c: F.coalesce(F.nullif(V.strip(V.text_of(V.col(c), sheet.kind(c))), F.lit("")), F.lit("(blank)"))
    head = F.concat_ws(" / ", *[shown(c) for c in across]) if across else None
    base = sheet.df.withColumns({f"__r{i}": shown(r) if totals or sheet.kind(r) == "text" else V.col(r) for i, r in enumerate(rows)})
    r = [F.col(f"__r{i}") for i in range(len(rows))]
    if step.get("calculated"):
        aggs, made = _calculated(sheet, step["calculated"])
        sets = [r, []] if totals else [r]
        sums = [f"__sum{i}" for i in range(len(aggs))]
        df = base.groupBy(*r).agg(*aggs).groupingSets(sets, *r).agg(F.grouping_id().alias("__g"), *[F.sum(x).alias(x) for x in sums]).withColumns(made)
        return _with_total(sheet, df.select("__g", *r, *made), rows, list(made))
    if not across:
        raise PlanError("a pivot needs columns or calculated fields")
    name = value or rows[0]
    sheet.need(name)
    base = base.withColumn("__c", head)
    c = F.col("__c")
    sets = [[*r, c], r, [c], []] if totals else [[*r, c]]
    # each cell once, then totals from the few cells' states: grouping sets copy every row they read
    if func == "nunique":
        some = F.when(~V.is_blank(V.col(name), sheet.kind(name)), V.col(name))
        states, total = base.select(*r, c, some.alias("cell")).distinct(), F.count_distinct("cell")
    else:
        parts, total = mergeable(sheet, name, func, value is None)
        states = base.groupBy(*r, c).agg(*parts)
    states = checkpointed(states)  # read for the headings and for the totals
    heads = [x[0] for x in states.select("__c").distinct().orderBy("__c").limit(WIDEST + 1).collect()]
    if len(heads) > WIDEST:
        raise PlanError(f"that would make more than {WIDEST} columns; which values matter?")
    cells = states.groupingSets(sets, *r, c).agg(F.grouping_id().alias("__gid"), F.grouping("__c").alias("__gc"), total.alias("__x"))
    wide = cells.withColumn("__g", F.shiftright("__gid", 1)).groupBy("__g", *r).agg(
        *[F.max(F.when((F.col("__gc") == 0) & (c == F.lit(h)), F.col("__x"))).alias(h) for h in heads], *([F.max(F.when(F.col("__gc") == 1, F.col("__x"))).alias("Total")] if totals else [])
    )
    if func in ("count", "nunique", "sum"):
        wide = wide.withColumns({h: F.coalesce(V.col(h), F.lit(0)) for h in heads})
    return _with_total(sheet, wide, rows, heads + (["Total"] if totals else []))


def _with_total(sheet: Sheet, df, rows: list[str], columns: list[str]) -> Sheet:
    last = F.col("__g") != 0
    names = {name: F.when(last, F.lit("Total") if i == 0 else F.lit(None)).otherwise(F.col(f"__r{i}")) if dict(df.dtypes)[f"__r{i}"] == "string" else F.col(f"__r{i}") for i, name in enumerate(rows)}
    out = df.select(*[e.alias(n) for n, e in names.items()], *[V.col(c) for c in columns], last.alias("__o0"), *[F.col(f"__r{i}").alias(f"__o{i + 1}") for i in range(len(rows))])
    return Sheet(out, [(f"__o{i}", True) for i in range(len(rows) + 1)], notes=sheet.notes)


def chart(sheet: Sheet, step: dict, ctx) -> Sheet:
    """Only notes the chart; ``chart_data`` gives its points."""
    return sheet.with_df(sheet.df, charts=[*sheet.charts, step])


def chart_data(sheet: Sheet, step: dict, ctx):
    from .columns import PARTS

    df = sheet.df.filter(all_of(sheet, step["when"], ctx.today)) if step.get("when") else sheet.df
    x = V.col(step["x"])
    blank = V.is_blank(x, sheet.kind(step["x"]))
    point = PARTS[step["x_part"]](V.read_date(x, sheet.kind(step["x"]))) if step.get("x_part") else x
    y = aggregate(sheet, step["y"], step.get("func", "sum")) if step.get("y") else F.count(F.lit(1))
    out = df.filter(~blank).groupBy(point.alias("x")).agg(y.alias("y"))
    if out.limit(WIDEST + 1).count() > WIDEST:
        raise PlanError(f"a chart has {WIDEST} points at most")
    return out.orderBy("x")
