"""Profiles, findings and checks of tables, each in one or two aggregates."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import values as V

#: Names of columns that hold personal data or keys, whose values are withheld.
PERSONAL = r"(?i)(name|mail|phone|mobile|address|aadhaar|pan|passport|birth|dob|account)"
IDS = r"(?i)(^id$|_id$|id$|key$|number$|no$)"


def _long(df: DataFrame, rows: dict[str, dict]) -> DataFrame:
    """One aggregate row turned into a row for each name."""
    parts = [F.struct(F.lit(n).alias("name"), *[F.col(f"`{c}`").alias(k) for k, c in cols.items()]) for n, cols in rows.items()]
    return df.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def _counted(df: DataFrame, trimmed: bool) -> DataFrame:
    """name, value (NULL: blank), n: how often each value of each column occurs. Tasks count before anything is shuffled."""
    cells = []
    for c in (x for x in df.columns if not x.startswith("__")):
        kind, x = V.kind_of(df, c), V.col(c)
        shown = V.strip(V.text_of(x, kind)) if trimmed else x.cast("string")
        cells.append(F.struct(F.lit(c).alias("name"), F.when(~V.is_blank(x, kind), shown).alias("value")))
    return df.select(F.inline(F.array(*cells))).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """name, n_rows, n_blank, n_distinct of every column."""
    blank = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    return _counted(df, False).groupBy("name").agg(F.sum("n").alias("n_rows"), blank.alias("n_blank"), F.count("value").alias("n_distinct"))


#: Words of column names by which numbers are told apart, values of flags, and sizes of what is shown.
ROLE_WORDS = {"percent": ("pct", "percent", "%", "ratio", "rate"), "amount": ("amt", "amount", "bal", "principal", "due", "paid", "emi", "fee", "price", "value", "total", "sum", "outstanding", "interest", "charge"), "count": ("cnt", "count", "nbr", "qty", "quantity", "days", "tenure")}
FLAGS = ("0", "1", "y", "n", "yes", "no", "true", "false", "t", "f")
CATEGORY_MOST, VALUES_SHOWN, FEW_NUMBERS, ROWS_SHARED = 50, 12, 8, 60


def role(name: str, kind: str, distinct: int, values: list[str]) -> str:
    """What a column is for: date, flag, id, percent, amount, count, number, category or text. ``values``: the most frequent ones."""
    low = name.lower()
    if kind == "date":
        return "date"
    if 0 < distinct <= 2 and all(v.lower() in FLAGS for v in values):
        return "flag"
    if distinct > CATEGORY_MOST and re.search(IDS, name):
        return "id"
    if kind == "number":
        return next((r for r, words in ROLE_WORDS.items() if any(w in low for w in words)), "number")
    return "category" if distinct <= CATEGORY_MOST else "text"


def describe_columns(df: DataFrame) -> list[dict]:
    """For each column: name, kind, role, blank (share), distinct, and low, high, mean, values (with shares) or why they are withheld.

    Two aggregates; only the VALUES_SHOWN most frequent values of a column come to the driver.
    """
    names = [c for c in df.columns if not c.startswith("__")]
    counted = _counted(df, True)
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
    top = counted.filter("value is not null").withColumn("place", place).filter(F.col("place") <= VALUES_SHOWN).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("top"))
    sizes = counted.groupBy("name").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("blank"), F.count("value").alias("distinct"))
    found = {r["name"]: r for r in sizes.join(top, "name", "left").collect()}
    edges = []
    for i, c in enumerate(names):
        if (kind := V.kind_of(df, c)) in ("number", "date"):
            x = V.to_number(V.col(c), kind) if kind == "number" else V.col(c).cast("date")
            edges += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), *([F.avg(x).alias(f"m{i}")] if kind == "number" else [])]
    seen = df.agg(*edges).first().asDict() if edges else {}
    out = []
    for i, c in enumerate(names):
        r, kind = found.get(c), V.kind_of(df, c)
        rows, blank, distinct, most = (r["rows"], r["blank"], r["distinct"], r["top"] or []) if r else (0, 0, 0, [])
        one = {"name": c, "kind": kind, "role": role(c, kind, distinct, [v["value"] for v in most]), "blank": round(blank / rows, 2) if rows else 0, "distinct": distinct}
        personal = re.search(PERSONAL, c) is not None
        if personal or one["role"] == "id":
            one["withheld"] = "looks like personal data" if personal else "an identifier"
        else:
            one |= {k: seen[f"{k[0]}{i}"] for k in ("low", "high", "mean") if seen.get(f"{k[0]}{i}") is not None}
            if kind == "date" or kind == "number" and one["role"] != "flag" and distinct > FEW_NUMBERS:
                pass  # the range is enough
            elif distinct > CATEGORY_MOST:
                one["withheld"] = "many different values"
            else:
                one["values"] = [(v["value"], round(v["n"] / max(1, rows - blank), 2)) for v in most]
        out.append(one)
    return out


def not_shared(df: DataFrame) -> str | None:
    """Why the rows of a result may not be shown outside: too many of them, or a personal or identifying column. None: they may."""
    if df.limit(ROWS_SHARED + 1).count() > ROWS_SHARED:
        return f"it has more than {ROWS_SHARED} rows"
    told = [c for c in describe_columns(df) if c["role"] == "id" or re.search(PERSONAL, c["name"])]
    return f"it has a personal or id column ({told[0]['name']})" if told else None


def value_counts(df: DataFrame, name: str, n: int = 12) -> DataFrame:
    """The n most frequent values; a blank is (blank)."""
    c = F.coalesce(F.nullif(V.strip(V.text_of(V.col(name), V.kind_of(df, name))), F.lit("")), F.lit("(blank)"))
    return df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def share_of_values(df: DataFrame, name: str, n: int = 12) -> DataFrame | None:
    """Values with their shares, or nothing for personal data and keys."""
    if re.search(PERSONAL, name) or re.search(IDS, name):
        return None
    total = df.count()
    return value_counts(df, name, n).withColumn("share", F.round(F.col("n") / F.lit(max(1, total)), 4))


def findings(df: DataFrame) -> DataFrame:
    """finding, name, n: what a cleaning step would mend, in one aggregate; repeated rows in a second."""
    names = [x for x in df.columns if not x.startswith("__")]
    every = [V.is_blank(V.col(c), V.kind_of(df, c)) for c in names]
    aggs, rows = [F.count(F.when(F.array_min(F.array(*every)), 1)).alias("f0")], [("empty rows", None, "f0")]
    for c in names:
        kind, x = V.kind_of(df, c), V.col(c)
        blank = V.is_blank(x, kind)
        tests = {"blanks": blank}
        if kind == "text":
            tests["stray spaces"] = ~blank & (x != V.strip(F.regexp_replace(x, V.SPACE_RUN, " ")))
            tests["amounts as text"] = ~blank & V.read_number(x).isNotNull()
            tests["dates as text"] = ~blank & V.read_number(x).isNull() & V.read_date(x).isNotNull()
        for k, t in tests.items():
            aggs.append(F.count(F.when(t, 1)).alias(f"f{len(rows)}"))
            rows.append((k, c, f"f{len(rows)}"))
    groups = df.groupBy(*[V.col(c) for c in names]).agg(F.count(F.lit(1)).alias("__n"))
    repeats = groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n")).select(F.lit("repeated rows").alias("finding"), F.lit(None).cast("string").alias("name"), "n")
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(k).alias("finding"), F.lit(c).cast("string").alias("name"), F.col(f).alias("n")) for k, c, f in rows]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*").unionByName(repeats).filter("n > 0")


def spellings(df: DataFrame, name: str) -> DataFrame:
    """Values that differ in case and spaces only: key, spellings."""
    key = F.lower(F.regexp_replace(V.col(name), V.SPACE_RUN, ""))
    return df.filter(~V.is_blank(V.col(name))).groupBy(key.alias("key")).agg(F.count_distinct(V.col(name)).alias("spellings")).filter("spellings > 1")


def mends(df: DataFrame) -> list[dict]:
    """Findings, spellings and mixed dates among them, each with the step that mends it: finding, name, n, step."""
    out = [r.asDict() for r in findings(df).collect()]
    texts = [c for c in df.columns if not c.startswith("__") and V.kind_of(df, c) == "text"]
    iso = lambda c: V.col(c).rlike(r"^\s*[0-9]{4}-")
    read = lambda c: V.read_number(V.col(c)).isNull() & V.read_date(V.col(c)).isNotNull()
    if texts:
        kinds = df.agg(*[F.count(F.when(read(c) & (iso(c) if k else ~iso(c)), 1)) for c in texts for k in (0, 1)]).first()
        out += [{"finding": "mixed dates", "name": c, "n": min(kinds[2 * i : 2 * i + 2])} for i, c in enumerate(texts) if min(kinds[2 * i : 2 * i + 2])]
        out += [{"finding": "spellings apart", "name": c, "n": n} for c in texts if (n := spellings(df, c).count())]
    step = {
        "empty rows": lambda c: {"op": "drop_blank_rows", "how": "all"}, "repeated rows": lambda c: {"op": "dedupe"}, "stray spaces": lambda c: {"op": "clean_text", "action": "trim", "columns": [c]},
        "amounts as text": lambda c: {"op": "convert", "columns": [c], "to": "number"}, "dates as text": lambda c: {"op": "convert", "columns": [c], "to": "date"}, "mixed dates": lambda c: {"op": "convert", "columns": [c], "to": "date"},
        "spellings apart": lambda c: {"op": "clean_text", "action": "title", "columns": [c]}, "blanks": lambda c: {"op": "fill_blanks", "columns": [c], "method": "value", "value": 0 if V.kind_of(df, c) == "number" else "Unknown"},
    }
    return [r | {"step": json.dumps(step[r["finding"]](r["name"]))} for r in out]


def check_result(df: DataFrame) -> list[str]:
    """Warnings about a result: no rows, columns all blank, percentages out of range."""
    names = [c for c in df.columns if not c.startswith("__")]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        kind = V.kind_of(df, c)
        aggs.append(F.count(F.when(~V.is_blank(V.col(c), kind), 1)).alias(f"s{i}"))
        if kind == "number" and ("%" in c or "percent" in c.lower()):
            aggs.append(F.count(F.when((V.col(c) < 0) | (V.col(c) > 100), 1)).alias(f"p{i}"))
    row = df.agg(*aggs).first().asDict()
    if not row["n"]:
        return ["the result has no rows"]
    out = [f"column {c!r} is blank in every row" for i, c in enumerate(names) if not row[f"s{i}"]]
    return out + [f"column {c!r} has {row[f'p{i}']} values outside 0 to 100" for i, c in enumerate(names) if row.get(f"p{i}")]


def sample(df: DataFrame, n: int = 20_000, seed: int = 7) -> DataFrame:
    """``n`` rows by the least hash of seed and values, whatever the partitions; all rows where there are fewer."""
    place = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    return df.orderBy(place).limit(n)
