"""Steps that depend on the order of rows, and windows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..lineage import fits_window, scan
from ..sheet import PlanError, Sheet


#: Fixed value: the share of dates from which a text column sorts as dates.
DATES_SHARE = 0.8


def sort_key(sheet: Sheet, name: str) -> Column:
    """Text that looks like dates sorts as dates, ordered labels in their order, blanks as NULL."""
    sheet.need(name)
    kind, c = sheet.kind(name), V.col(name)
    if name in sheet.orders:
        return F.nullif(F.array_position(F.array(*[F.lit(v) for v in sheet.orders[name]]), c), F.lit(0))
    if kind == "text":
        return F.when(V.is_blank(c), None).otherwise(V.read_date(c).cast("string") if _dates(sheet, name) else c)
    return F.nanvl(c, F.lit(None).cast("double")) if kind == "number" and dict(sheet.df.dtypes)[name] in ("double", "float") else c


def _dates(sheet: Sheet, name: str) -> bool:
    """Whether over DATES_SHARE of the values read as dates and are not bare numbers; one aggregate over the column."""
    c = V.col(name)
    some = ~V.is_blank(c)
    read = sheet.df.agg(F.count(F.when(some, 1)), F.count(F.when(some & c.rlike("[0-9]") & ~c.rlike(r"^\s*[0-9]+\s*$"), V.read_date(c)))).first()
    return read[0] > 0 and read[1] > DATES_SHARE * read[0]


def sort(sheet: Sheet, step: dict, ctx) -> Sheet:
    """Stable, blanks last in both directions; costs nothing until a step asks for the order, but for a look at text columns."""
    up, stem = step.get("ascending", True), sheet.fresh("s")
    names = {f"{stem}_{i}": sort_key(sheet, c) for i, c in enumerate(step["columns"])}
    return sheet.with_df(sheet.df.withColumns(names), order=[(n, up) for n in names] + sheet.order)


def top_n(sheet: Sheet, step: dict, ctx) -> Sheet:
    """First rows by a column (ties in row order), of each group, or of the current order."""
    n, name, largest, per = int(step["n"]), step.get("column"), step.get("largest", True), step.get("per")
    if name is None:
        kept = sheet.df.orderBy(*sheet.by_order(reverse=not largest)).limit(n)
        return sheet.with_df(kept)
    ranked = sort(sheet, {"columns": [name], "ascending": not largest}, ctx)
    if not per:
        return ranked.with_df(ranked.df.orderBy(*ranked.by_order()).limit(n))
    sheet.need(*([per] if isinstance(per, str) else per))
    keys = [V.col(p) for p in ([per] if isinstance(per, str) else per)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ranked.by_order()))
    return ranked.with_df(ranked.df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n"))


def dedupe(sheet: Sheet, step: dict, ctx) -> Sheet:
    """One row for each key, the first or last in order; tasks keep one row a key before the shuffle (a window group limit)."""
    names = step.get("columns") or sheet.columns
    sheet.need(*names)
    keys = {f"__k{i}": F.coalesce(F.nullif(V.col(c), F.lit("")), F.lit(None)) if sheet.kind(c) == "text" else V.col(c) for i, c in enumerate(names)}
    last = step.get("keep", "first") == "last"
    place = Window.partitionBy(*keys).orderBy(*sheet.by_order(reverse=last))
    df = sheet.df.withColumns(keys)
    return sheet.with_df(df.withColumn("__n", F.row_number().over(place)).filter("__n = 1").drop("__n", *keys))


def split_by(sheet: Sheet, step: dict, ctx) -> Sheet:
    """A sheet for each value: a key beside the rows, written apart at the sink."""
    sheet.need(step["column"])
    mark = sheet.fresh("sheet")
    value = F.coalesce(F.nullif(V.strip(V.text_of(V.col(step["column"]), sheet.kind(step["column"]))), F.lit("")), F.lit("(blank)"))
    return sheet.with_df(sheet.df.withColumn(mark, value), split=[*sheet.split, mark])


def fill_blanks(sheet: Sheet, step: dict, ctx) -> Sheet:
    names = step.get("columns") or sheet.columns
    sheet.need(*names)
    method = step.get("method", "value")
    if method == "value":
        out, value = {}, step.get("value")
        for c in sheet.columns:
            x, kind = V.col(c), sheet.kind(c)
            if c in names:
                new = F.lit(str(value))
                if kind == "number":
                    try:
                        number = float(str(value))
                        whole = number.is_integer() and dict(sheet.df.dtypes)[c] != "double"
                        new = F.lit(int(number)) if whole else F.lit(number)
                    except ValueError:
                        x = V.text_of(x, kind)
                elif kind == "date":
                    x = V.text_of(x, kind)
                x = F.when(V.is_blank(V.col(c), kind), new).otherwise(x)
            out[c] = x
        return sheet.project(out)
    kept = {f"__v{i}": F.when(~V.is_blank(V.col(c), sheet.kind(c)), V.col(c)) for i, c in enumerate(names)}
    df = scan(sheet.df.withColumns(kept), [], sheet.by_order(reverse=method == "up"), list(kept), "last", [f"__filled{i}" for i in range(len(names))])
    return sheet.with_df(df.withColumns({c: F.col(f"__filled{i}") for i, c in enumerate(names)}).drop(*kept, *[f"__filled{i}" for i in range(len(names))]))


def calculate(sheet: Sheet, step: dict, ctx) -> Sheet:
    """running_total, percent_of_total or rank, over all rows or for each group."""
    kind, name, per = step["kind"], step["column"], step.get("per")
    sheet.need(name, *([per] if per else []))
    out = step.get("name") or f"{kind}_{name}"
    x = V.to_number(V.col(name), sheet.kind(name))
    keys = [V.col(per)] if per else []
    if kind == "running_total":
        df = sheet.df.withColumn("__v", x)
        if per:
            df = scan(df.withColumn("__g", keys[0]), ["__g"], sheet.by_order(), ["__v"], "sum", ["__run"]).drop("__g")
        else:
            df = scan(df, [], sheet.by_order(), ["__v"], "sum", ["__run"])
        return sheet.with_df(df.withColumn(out, F.when(F.col("__v").isNotNull(), F.col("__run"))).drop("__v", "__run"))
    if kind == "percent_of_total":
        if per:
            totals = sheet.df.groupBy(keys[0].alias("__g")).agg(F.sum(x).alias("__t"))
            df = sheet.df.join(totals, V.col(per).eqNullSafe(F.col("__g")), "left")
            share = V.half_even(F.try_divide(x, F.col("__t")) * 100, 2)
            return sheet.with_df(df.withColumn(out, share).drop("__g", "__t"))
        total = sheet.df.agg(F.sum(x)).first()[0]
        return sheet.with_df(sheet.df.withColumn(out, V.half_even(F.try_divide(x, F.lit(total).cast("double")) * 100, 2)))
    if kind == "rank":
        key = sort_key(sheet, name)
        down = step.get("descending", True)
        df = sheet.df.withColumns({"__key": key} | ({"__per": keys[0]} if per else {}))
        by = ["__per"] if per else []
        if fits_window(df, by):
            place = F.rank().over(Window.partitionBy(*by).orderBy(F.col("__key").desc_nulls_last() if down else F.col("__key").asc_nulls_last()))
            return sheet.with_df(df.withColumn(out, F.when(F.col("__key").isNotNull(), place.cast("bigint"))).drop("__key", "__per"))
        counted = sheet.df.filter(key.isNotNull()).groupBy(*[k.alias("__g") for k in keys], key.alias("__v")).agg(F.count("*").cast("double").alias("__c"))
        # rows before each distinct value, by running counts over distinct values
        order = [F.col("__v").desc() if down else F.col("__v").asc()]
        ran = scan(counted, ["__g"] if per else [], order, ["__c"], "sum", ["__upto"])
        ranks = ran.select(*(["__g"] if per else []), "__v", (F.col("__upto") - F.col("__c") + 1).cast("bigint").alias("__rank"))
        on = F.col("__key") == F.col("__v")
        if per:
            on &= F.col("__per").eqNullSafe(F.col("__g"))
        joined = df.join(ranks, on, "left")
        return sheet.with_df(joined.withColumn(out, F.col("__rank")).drop("__key", "__per", "__v", "__g", "__rank"))
    raise PlanError(f"there is no calculation {kind!r}")
