"""Spreadsheet formulas as Spark columns.

A formula becomes a pair of columns, value and error; an error travels only through the branch that is taken, so
``IFERROR``, ``IF`` and ``SWITCH`` are lazy without exceptions. Aggregates over a column are one job
for all of a formula; criteria that differ by row become an aggregate joined back by key.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V

DIV, VALUE, NA, NUM = "#DIV/0!", "#VALUE!", "#N/A", "#NUM!"
TOKEN = re.compile(r'\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|"((?:[^"]|"")*)"|\[([^\]]+)\]|([A-Za-z_][A-Za-z0-9_.]*)|(<>|<=|>=|[-+*/^&=<>(),%]))')


class FormulaError(ValueError):
    pass


def parse(text: str):
    """Nested tuples: ("num", x), ("text", s), ("col", name), ("call", NAME, args), ("op", sign, a, b), ("neg", a), ("pct", a)."""
    text = text.strip().removeprefix("=")
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"cannot read {text[at:at + 12]!r}")
        tokens.append(next((k, g) for k, g in zip(("num", "text", "col", "name", "sign"), m.groups()) if g is not None))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek(*signs: str) -> bool:
        return tokens[place][0] == "sign" and tokens[place][1] in signs

    def take():
        nonlocal place
        place += 1
        return tokens[place - 1]

    def left(signs: tuple[str, ...], below: Callable):
        def level():
            a = below()
            while peek(*signs):
                a = ("op", take()[1], a, below())
            return a

        return level

    def need(sign: str):
        if not peek(sign):
            raise FormulaError(f"expected {sign!r}")
        take()

    def percent():
        a = atom()
        while peek("%"):
            take()
            a = ("pct", a)
        return a

    def unary():
        if peek("-", "+"):
            return ("neg", unary()) if take()[1] == "-" else unary()
        return percent()

    def atom():
        kind, value = take()
        if kind == "num":
            return ("num", float(value))
        if kind == "text":
            return ("text", value.replace('""', '"'))
        if kind == "col":
            return ("col", value)
        if kind == "name":
            if peek("("):
                take()
                args = []
                while not peek(")"):
                    args.append(compare())
                    if not peek(","):
                        break
                    take()
                need(")")
                return ("call", value.upper(), args)
            return ("bool", value.upper() == "TRUE") if value.upper() in ("TRUE", "FALSE") else ("col", value)
        if (kind, value) == ("sign", "("):
            a = compare()
            need(")")
            return a
        raise FormulaError(f"unexpected {value!r}")

    power = left(("^",), unary)
    product = left(("*", "/"), power)
    total = left(("+", "-"), product)
    joined = left(("&",), total)
    compare = left(("=", "<>", "<", "<=", ">", ">="), joined)
    out = compare()
    if tokens[place][0] != "end":
        raise FormulaError(f"unexpected {tokens[place][1]!r}")
    return out


def find_column(df: DataFrame, name: str) -> str:
    fold = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    if name in df.columns:
        return name
    near = [c for c in df.columns if fold(c) == fold(name) and not c.startswith("__")]
    if len(near) == 1:
        return near[0]
    import difflib

    guess = difflib.get_close_matches(name, [c for c in df.columns if not c.startswith("__")], 1)
    raise FormulaError(f"there is no column {name!r}" + (f"; did you mean {guess[0]!r}?" if guess else ""))


# --- restricted arithmetic -----------------------------------------------------------------------


def arithmetic(df: DataFrame, text: str, today: Column | None = None, resolve: Callable | None = None) -> Column:
    """Numbers, columns, + - * /, round, abs, days, weeks, months, years, today; division by zero is blank."""
    today = today if today is not None else F.current_date()

    def number(node) -> Column:
        kind = node[0]
        if kind == "num":
            return F.lit(node[1])
        if kind == "neg":
            return -number(node[1])
        if kind == "op" and node[1] in "+-*/":
            a, b = number(node[2]), number(node[3])
            out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[node[1]]()
            return out
        if kind == "col":
            if resolve:
                return resolve(node[1])
            name = find_column(df, node[1])
            if (k := V.kind_of(df, name)) == "text":
                raise FormulaError(f"column {name!r} holds text: convert it to numbers first")
            return V.to_number(V.col(name), k)
        if kind == "call":
            name, args = node[1], node[2]
            if name == "ABS":
                return F.abs(number(args[0]))
            if name == "ROUND":
                return V.half_even(number(args[0]), int(args[1][1]) if len(args) > 1 else 0)
            if name in ("DAYS", "WEEKS", "MONTHS", "YEARS"):
                a, b = date(args[0]), date(args[1])
                days = F.datediff(b, a)
                return {"DAYS": days, "WEEKS": F.floor(days / 7), "MONTHS": V.months_between(a, b), "YEARS": F.floor(V.months_between(a, b) / 12)}[name].cast("double")
        raise FormulaError("only arithmetic is allowed here")

    def date(node) -> Column:
        if node[:2] == ("call", "TODAY"):
            return today
        if node[0] == "col":
            name = find_column(df, node[1])
            return V.read_date(V.col(name), V.kind_of(df, name))
        raise FormulaError("a date is a column or today()")

    return F.round(number(parse(text)), 10)


# --- spreadsheet formulas ------------------------------------------------------------------------


@dataclass
class Cell:
    kind: str  # num, text, bool, date, blank
    value: Column
    error: Column  # NULL where there is none


@dataclass
class Compiler:
    df: DataFrame
    today: Column | None = None
    totals: dict[str, Column] = field(default_factory=dict)
    found: dict[str, object] = field(default_factory=dict)
    dry: bool = True

    def none(self) -> Column:
        return F.lit(None).cast("string")

    def cell(self, kind: str, value: Column, *errors: Column) -> Cell:
        return Cell(kind, value, F.coalesce(*errors) if errors else self.none())

    # conversions
    def num(self, c: Cell) -> tuple[Column, Column]:
        if c.kind == "text":
            n = V.read_number(c.value)
            blank = V.is_blank(c.value)
            return F.when(blank, F.lit(0.0)).otherwise(n), F.coalesce(c.error, F.when(~blank & n.isNull(), VALUE))
        if c.kind == "date":
            moment = c.value.cast("timestamp")
            return F.datediff(c.value, F.lit("1899-12-30").cast("date")) + (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)) / 86400, c.error
        return F.coalesce(c.value.cast("double"), F.lit(0.0)), c.error

    def text(self, c: Cell) -> tuple[Column, Column]:
        shown = {"num": lambda: V.text_of(c.value, "number"), "bool": lambda: F.upper(c.value.cast("string")), "date": lambda: F.regexp_replace(F.date_format(c.value.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")}.get(c.kind, lambda: c.value.cast("string"))()
        return F.coalesce(shown, F.lit("")), c.error

    def bool(self, c: Cell) -> tuple[Column, Column]:
        if c.kind == "bool":
            return F.coalesce(c.value, F.lit(False)), c.error
        if c.kind == "text":
            low = F.lower(V.strip(c.value))
            ok = low.isin("true", "false") | V.is_blank(c.value)
            return F.coalesce(low == "true", F.lit(False)), F.coalesce(c.error, F.when(~ok, VALUE))
        n, e = self.num(c)
        return n != 0, e

    def date(self, c: Cell) -> tuple[Column, Column]:
        if c.kind == "date":
            return c.value, F.coalesce(c.error, F.when(c.value.isNull(), VALUE))
        d = V.read_date(c.value) if c.kind == "text" else F.date_add(F.lit("1899-12-30").cast("date"), c.value.cast("int"))
        return d, F.coalesce(c.error, F.when(d.isNull(), VALUE))

    def common(self, cells: list[Cell]) -> tuple[str, list[Column]]:
        kinds = {c.kind for c in cells if c.kind != "blank"}
        kind = kinds.pop() if len(kinds) == 1 else "blank" if not kinds else "text"
        if kind == "text":
            return kind, [F.when(c.value.isNull(), None).otherwise(self.text(c)[0]) if c.kind != "blank" else self.none() for c in cells]
        t = {"num": "double", "bool": "boolean", "date": "date", "blank": "string"}[kind]
        return kind, [c.value.cast(t) for c in cells]

    def choose(self, cases: list[tuple[Column, Column, Cell]], other: Cell | None, missing: str | None = None) -> Cell:
        """The first case (condition, its error, result) that holds; an error in a condition on the way wins."""
        results = [r for _, _, r in cases] + ([other] if other else [])
        kind, vals = self.common(results)
        value = vals[-1] if other else F.lit(None)
        error = other.error if other else F.lit(missing).cast("string") if missing else self.none()
        for (cond, cond_error, r), v in reversed(list(zip(cases, vals))):
            value = F.when(cond_error.isNull() & cond, v).otherwise(value)
            error = F.when(cond_error.isNotNull(), cond_error).when(cond, r.error).otherwise(error)
        return Cell(kind, value, error)

    # nodes
    def compile(self, node) -> Cell:
        kind = node[0]
        if kind == "num":
            return self.cell("num", F.lit(node[1]))
        if kind == "text":
            return self.cell("text", F.lit(node[1]))
        if kind == "bool":
            return self.cell("bool", F.lit(node[1]))
        if kind == "col":
            name = find_column(self.df, node[1])
            k = V.kind_of(self.df, name)
            c = V.col(name)
            if k == "number":
                return self.cell("num", F.nanvl(c.cast("double"), F.lit(None).cast("double")))
            return self.cell({"date": "date", "bool": "bool"}.get(k, "text"), c.cast("date") if k == "date" else c if k == "bool" else F.when(V.is_blank(c), None).otherwise(c))
        if kind == "neg":
            n, e = self.num(self.compile(node[1]))
            return self.cell("num", -n, e)
        if kind == "pct":
            n, e = self.num(self.compile(node[1]))
            return self.cell("num", n / 100, e)
        if kind == "op":
            return self.operator(node[1], node[2], node[3])
        return self.call(node[1], node[2])

    def operator(self, sign: str, left, right) -> Cell:
        a, b = self.compile(left), self.compile(right)
        if sign == "&":
            (x, ex), (y, ey) = self.text(a), self.text(b)
            return self.cell("text", F.concat(x, y), ex, ey)
        if sign in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(sign, a, b)
        (x, ex), (y, ey) = self.num(a), self.num(b)
        if sign == "/":
            return self.cell("num", F.try_divide(x, y), ex, ey, F.when(y == 0, DIV))
        if sign == "^":
            p = F.pow(x, y)
            return self.cell("num", p, ex, ey, F.when(F.isnan(p) | (F.abs(p) == float("inf")), NUM))
        out = self.cell("num", {"+": x + y, "-": x - y, "*": x * y}[sign], ex, ey)
        if "date" in (a.kind, b.kind) and a.kind != b.kind and sign in "+-":
            return self.cell("date", F.date_add(F.lit("1899-12-30").cast("date"), out.value.cast("int")), out.error)
        return out

    def compare(self, sign: str, a: Cell, b: Cell) -> Cell:
        rank = {"num": 0, "date": 0, "text": 1, "bool": 2}
        if "blank" not in (a.kind, b.kind) and rank[a.kind] != rank[b.kind]:
            # numbers before text before logical values; a blank takes the other's kind
            fixed = F.lit(float(rank[a.kind])), F.lit(float(rank[b.kind]))
            x = F.when(a.value.isNull(), fixed[1]).otherwise(fixed[0])
            y = F.when(b.value.isNull(), fixed[0]).otherwise(fixed[1])
            ex, ey = a.error, b.error
        elif a.kind == "text" or b.kind == "text":
            (x, ex), (y, ey) = self.text(a), self.text(b)
            x, y = F.lower(x), F.lower(y)
        else:
            (x, ex), (y, ey) = self.num(a), self.num(b)
        made = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
        return self.cell("bool", made, ex, ey)

    def call(self, name: str, args: list) -> Cell:
        made = getattr(self, "f_" + name.lower(), None)
        if made is None:
            raise FormulaError(f"there is no function {name}")
        return made(*args)

    def nums(self, *args) -> list:
        cells = [self.num(self.compile(a)) for a in args]
        return [c for c, _ in cells] + [[e for _, e in cells]]

    # logic
    def f_if(self, cond, a, b=("bool", False)):
        c, e = self.bool(self.compile(cond))
        return self.choose([(c, e, self.compile(a))], self.compile(b))

    def f_ifs(self, *args):
        cases = [(*self.bool(self.compile(c)), self.compile(r)) for c, r in zip(args[::2], args[1::2])]
        return self.choose(cases, None, NA)

    def f_switch(self, on, *args):
        on_cell = self.compile(on)
        pairs = list(zip(args[::2], args[1::2])) if len(args) % 2 == 0 else list(zip(args[:-1:2], args[1:-1:2]))
        cases = []
        for value, result in pairs:
            same = self.compare("=", on_cell, self.compile(value))
            cases.append((same.value, same.error, self.compile(result)))
        return self.choose(cases, self.compile(args[-1]) if len(args) % 2 else None, NA)

    def f_iferror(self, a, b):
        c, d = self.compile(a), self.compile(b)
        kind, (x, y) = self.common([c, d])
        return Cell(kind, F.when(c.error.isNotNull(), y).otherwise(x), F.when(c.error.isNotNull(), d.error))

    def f_ifna(self, a, b):
        c, d = self.compile(a), self.compile(b)
        kind, (x, y) = self.common([c, d])
        is_na = F.coalesce(c.error == NA, F.lit(False))
        return Cell(kind, F.when(is_na, y).otherwise(x), F.when(is_na, d.error).otherwise(c.error))

    def _all(self, args, stop: bool):
        value, error = F.lit(not stop), self.none()
        for a in reversed(args):
            v, e = self.bool(self.compile(a))
            error = F.when(e.isNotNull(), e).when(v == stop, None).otherwise(error)
            value = F.when(v == stop, F.lit(stop)).otherwise(value)
        return self.cell("bool", value, error)

    def f_and(self, *args):
        return self._all(args, False)

    def f_or(self, *args):
        return self._all(args, True)

    def f_not(self, a):
        v, e = self.bool(self.compile(a))
        return self.cell("bool", ~v, e)

    def f_xor(self, *args):
        cells = [self.bool(self.compile(a)) for a in args]
        return self.cell("bool", reduce(lambda x, y: x + y, [v.cast("int") for v, _ in cells]) % 2 == 1, *[e for _, e in cells])

    # information
    def f_isblank(self, a):
        c = self.compile(a)
        return self.cell("bool", c.error.isNull() & (c.value.isNull() | (V.is_blank(c.value) if c.kind == "text" else F.lit(False))))

    def f_isnumber(self, a):
        c = self.compile(a)
        return self.cell("bool", c.error.isNull() & c.value.isNotNull() & F.lit(c.kind in ("num", "date")))

    def f_istext(self, a):
        c = self.compile(a)
        return self.cell("bool", c.error.isNull() & c.value.isNotNull() & F.lit(c.kind == "text"))

    def f_iserror(self, a):
        return self.cell("bool", self.compile(a).error.isNotNull())

    def f_isna(self, a):
        return self.cell("bool", F.coalesce(self.compile(a).error == NA, F.lit(False)))

    # mathematics
    def f_abs(self, a):
        x, e = self.nums(a)
        return self.cell("num", F.abs(x), *e)

    def _round(self, a, digits, how: str):
        x, n, e = self.nums(a, digits)
        scale = F.pow(F.lit(10.0), n)
        size = F.abs(x) * scale
        whole = {"near": F.floor(size + 0.5 + 1e-9), "up": F.ceil(size - 1e-9), "down": F.floor(size + 1e-9)}[how]
        return self.cell("num", F.signum(x) * whole / scale, *e)

    def f_round(self, a, n=("num", 0.0)):
        return self._round(a, n, "near")

    def f_roundup(self, a, n=("num", 0.0)):
        return self._round(a, n, "up")

    def f_rounddown(self, a, n=("num", 0.0)):
        return self._round(a, n, "down")

    f_trunc = f_rounddown

    def f_int(self, a):
        x, e = self.nums(a)
        return self.cell("num", F.floor(x).cast("double"), *e)

    def f_sign(self, a):
        x, e = self.nums(a)
        return self.cell("num", F.signum(x), *e)

    def f_sqrt(self, a):
        x, e = self.nums(a)
        return self.cell("num", F.sqrt(F.greatest(x, F.lit(0.0))), *e, F.when(x < 0, NUM))

    def f_power(self, a, b):
        return self.operator("^", a, b)

    def f_mod(self, a, b):
        x, y, e = self.nums(a, b)
        return self.cell("num", x - y * F.floor(F.try_divide(x, y)), *e, F.when(y == 0, DIV))

    def f_ceiling(self, a, s=("num", 1.0)):
        x, y, e = self.nums(a, s)
        return self.cell("num", F.when(y == 0, 0.0).otherwise(F.ceil(F.try_divide(x, y)) * y), *e)

    def f_floor(self, a, s=("num", 1.0)):
        x, y, e = self.nums(a, s)
        return self.cell("num", F.floor(F.try_divide(x, y)) * y, *e, F.when(y == 0, DIV))

    # aggregates over columns, or over the values of a row
    def total(self, key: str, agg: Column) -> object:
        if self.dry:
            self.totals[key] = agg
            return None
        return self.found[key]

    def _aggregate(self, name: str, args):
        columns = [find_column(self.df, a[1]) for a in args if a[0] == "col"]
        if len(columns) == len(args) == 1:
            c = columns[0]
            k = V.kind_of(self.df, c)
            x = V.to_number(V.col(c), k) if k in ("number", "bool") else F.lit(None).cast("double")
            agg = {"sum": F.coalesce(F.sum(x), F.lit(0.0)), "average": F.avg(x), "min": F.coalesce(F.min(x), F.lit(0.0)), "max": F.coalesce(F.max(x), F.lit(0.0)), "count": F.count(x).cast("double"), "counta": F.count(F.when(~V.is_blank(V.col(c), k), 1)).cast("double"), "median": ("median", x)}[name]
            v = F.lit(self.total(f"{name}:{c}", agg)).cast("double")
            return self.cell("num", v, F.when(v.isNull(), DIV if name == "average" else NUM))
        cells = [self.compile(a) for a in args]
        some = [self.num(c)[0] if c.kind != "text" else V.read_number(c.value) for c in cells]
        some = [F.when(c.value.isNotNull(), v) for c, v in zip(cells, some)]
        listed = F.filter(F.array(*some), lambda x: x.isNotNull())
        added = F.aggregate(listed, F.lit(0.0), lambda s, x: s + x)
        size = F.size(listed).cast("double")
        out, err = {
            "sum": (added, None), "average": (F.try_divide(added, size), DIV), "min": (F.coalesce(F.array_min(listed), F.lit(0.0)), None), "max": (F.coalesce(F.array_max(listed), F.lit(0.0)), None), "count": (size, None),
            "counta": (F.size(F.filter(F.array(*[c.value.cast("string") for c in cells]), lambda x: x.isNotNull())).cast("double"), None),
            "median": ((F.get(F.array_sort(listed), F.floor((size - 1) / 2).cast("int")) + F.get(F.array_sort(listed), F.floor(size / 2).cast("int"))) / 2, NUM),
        }[name]
        return self.cell("num", out, *[c.error for c in cells], *([F.when(size == 0, err)] if err else []))

    def f_sum(self, *a):
        return self._aggregate("sum", a)

    def f_average(self, *a):
        return self._aggregate("average", a)

    def f_min(self, *a):
        return self._aggregate("min", a)

    def f_max(self, *a):
        return self._aggregate("max", a)

    def f_count(self, *a):
        return self._aggregate("count", a)

    def f_counta(self, *a):
        return self._aggregate("counta", a)

    def f_median(self, *a):
        return self._aggregate("median", a)

    # text
    def _texts(self, *args):
        cells = [self.text(self.compile(a)) for a in args]
        return [c for c, _ in cells] + [[e for _, e in cells]]

    def f_left(self, a, n=("num", 1.0)):
        (s, e), (k, ek) = self.text(self.compile(a)), self.num(self.compile(n))
        return self.cell("text", F.substring(s, F.lit(1), F.greatest(k.cast("int"), F.lit(0))), e, ek, F.when(k < 0, VALUE))

    def f_right(self, a, n=("num", 1.0)):
        (s, e), (k, ek) = self.text(self.compile(a)), self.num(self.compile(n))
        return self.cell("text", F.right(s, F.greatest(k.cast("int"), F.lit(0))), e, ek, F.when(k < 0, VALUE))

    def f_mid(self, a, start, n):
        (s, e), (b, eb), (k, ek) = self.text(self.compile(a)), self.num(self.compile(start)), self.num(self.compile(n))
        return self.cell("text", F.substring(s, F.greatest(b.cast("int"), F.lit(1)), F.greatest(k.cast("int"), F.lit(0))), e, eb, ek, F.when((b < 1) | (k < 0), VALUE))

    def f_len(self, a):
        s, e = self._texts(a)
        return self.cell("num", F.length(s).cast("double"), *e)

    def f_upper(self, a):
        s, e = self._texts(a)
        return self.cell("text", F.upper(s), *e)

    def f_lower(self, a):
        s, e = self._texts(a)
        return self.cell("text", F.lower(s), *e)

    def f_proper(self, a):
        s, e = self._texts(a)
        return self.cell("text", V.title(s), *e)

    def f_trim(self, a):
        s, e = self._texts(a)
        return self.cell("text", V.strip(F.regexp_replace(s, V.SPACE_RUN, " ")), *e)

    def f_clean(self, a):
        s, e = self._texts(a)
        return self.cell("text", F.regexp_replace(s, r"[\x00-\x1f]", ""), *e)

    def f_concat(self, *args):
        *s, e = self._texts(*args)
        return self.cell("text", F.concat(*s), *e)

    f_concatenate = f_concat

    def f_textjoin(self, sep, skip, *args):
        *s, e = self._texts(*args)
        (d, ed), (k, ek) = self.text(self.compile(sep)), self.bool(self.compile(skip))
        return self.cell("text", F.aggregate(F.filter(F.array(*s), lambda x: ~(k & (x == ""))), F.lit(None).cast("string"), lambda acc, x: F.coalesce(F.concat(acc, d, x), x), lambda acc: F.coalesce(acc, F.lit(""))), *e, ed, ek)

    def f_substitute(self, a, old, new, nth=None):
        s, o, n, e = self._texts(a, old, new)
        if nth is None:
            return self.cell("text", F.when(o == "", s).otherwise(F.replace(s, o, n)), *e)
        k, ek = self.num(self.compile(nth))
        k = k.cast("int")
        head = F.call_function("substring_index", s, o, k)
        has = (o != "") & (F.length(head) + F.length(o) <= F.length(s)) & (F.size(F.split(s, F.concat(F.lit(r"\Q"), F.replace(o, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")), -1)) > k)
        return self.cell("text", F.when(has, F.concat(head, n, F.substring(s, F.length(head) + F.length(o) + 1, F.length(s)))).otherwise(s), *e, ek, F.when(k < 1, VALUE))

    def f_replace(self, a, start, n, new):
        (s, e), (t, et) = self.text(self.compile(a)), self.text(self.compile(new))
        b, k, en = self.nums(start, n)
        return self.cell("text", F.overlay(s, t, F.greatest(b.cast("int"), F.lit(1)), F.greatest(k.cast("int"), F.lit(0))), e, et, *en, F.when((b < 1) | (k < 0), VALUE))

    def f_find(self, what, a, start=("num", 1.0), fold=False):
        f, s, e = self._texts(what, a)
        b, eb = self.num(self.compile(start))
        if fold:
            f, s = F.lower(f), F.lower(s)
        rest = F.instr(F.substring(s, b.cast("int"), F.length(s)), f)
        return self.cell("num", (rest + b - 1).cast("double"), *e, eb, F.when((rest == 0) | (b < 1), VALUE))

    def f_search(self, what, a, start=("num", 1.0)):
        return self.f_find(what, a, start, True)

    def f_exact(self, a, b):
        x, y, e = self._texts(a, b)
        return self.cell("bool", x == y, *e)

    def f_rept(self, a, n):
        (s, e), (k, ek) = self.text(self.compile(a)), self.num(self.compile(n))
        return self.cell("text", F.repeat(s, k.cast("int")), e, ek, F.when(k < 0, VALUE))

    def f_value(self, a):
        c = self.compile(a)
        if c.kind != "text":
            x, e = self.num(c)
            return self.cell("num", x, e)
        n = V.read_number(c.value)
        return self.cell("num", n, c.error, F.when(n.isNull(), VALUE))

    def f_text(self, a, pattern):
        c = self.compile(a)
        if pattern[0] != "text":
            raise FormulaError("the pattern of TEXT is a text")
        p = pattern[1]
        if re.search(r"[dmy]", p, re.I) and not re.search(r"[0#]", p):
            d, e = self.date(c)
            java = re.sub(r"(?i)mmmm", "LLLL", re.sub(r"(?i)dddd", "EEEE", re.sub(r"(?i)(?<!d)ddd(?!d)", "EEE", p)))
            java = re.sub(r"(?i)y+", lambda m: "yyyy" if len(m[0]) > 2 else "yy", re.sub(r"(?i)(?<![dD])d{1,2}(?![dD])", lambda m: m[0].lower(), re.sub(r"(?i)m{1,3}(?!m)", lambda m: m[0].upper(), java)))
            return self.cell("text", F.date_format(d, java), e)
        n, e = self.num(c)
        m = re.fullmatch(r"([^0#,.%]*)([#,0]*)(?:\.([0#]+))?(%?)([^0#,.%]*)", p)
        if not m:
            raise FormulaError(f"cannot use the pattern {p!r}")
        before, whole, decimals, percent, after = m.groups()
        n = n * 100 if percent else n
        d = len(decimals or "")
        size = F.floor(F.abs(n) * 10**d + 0.5 + 1e-9) / 10**d
        shown = F.format_number(size, d)
        shown = shown if "," in whole else F.replace(shown, F.lit(","), F.lit(""))
        if (zeros := whole.count("0")) > 1:
            at = F.instr(F.concat(shown, F.lit(".")), ".")
            shown = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), zeros - at + 1)), shown)
        sign = F.when((n < 0) & (size > 0), "-").otherwise("")
        return self.cell("text", F.concat(sign, F.lit(before), shown, F.lit(percent + after)), e)

    # dates
    def _today(self) -> Column:
        return self.today if self.today is not None else F.current_date()

    def f_today(self):
        return self.cell("date", self._today())

    def f_now(self):
        """The moment; at the beginning of the day where a day is given for today."""
        return self.cell("date", self.today.cast("timestamp") if self.today is not None else F.current_timestamp())

    def f_date(self, y, m, d):
        a, b, c, e = self.nums(y, m, d)
        return self.cell("date", F.date_add(F.add_months(F.make_date(a.cast("int"), F.lit(1), F.lit(1)), (b - 1).cast("int")), (c - 1).cast("int")), *e)

    def _part(self, a, of):
        d, e = self.date(self.compile(a))
        return self.cell("num", of(d).cast("double"), e)

    def f_year(self, a):
        return self._part(a, F.year)

    def f_month(self, a):
        return self._part(a, F.month)

    def f_day(self, a):
        return self._part(a, F.dayofmonth)

    def f_weekday(self, a, kind=("num", 1.0)):
        return self._part(a, {1: F.dayofweek, 2: lambda d: F.weekday(d) + 1, 3: F.weekday}[int(kind[1])])

    def f_edate(self, a, n):
        (d, e), (k, ek) = self.date(self.compile(a)), self.num(self.compile(n))
        return self.cell("date", F.add_months(d, k.cast("int")), e, ek)

    def f_eomonth(self, a, n):
        (d, e), (k, ek) = self.date(self.compile(a)), self.num(self.compile(n))
        return self.cell("date", F.last_day(F.add_months(d, k.cast("int"))), e, ek)

    def f_days(self, end, start):
        (b, eb), (a, ea) = self.date(self.compile(end)), self.date(self.compile(start))
        return self.cell("num", F.datediff(b, a).cast("double"), eb, ea)

    def f_datedif(self, start, end, unit):
        (a, ea), (b, eb) = self.date(self.compile(start)), self.date(self.compile(end))
        months = V.months_between(a, b)
        # the same day in another year: 29 February becomes 1 March where there is none
        in_year = lambda y: F.date_add(F.make_date(y, F.month(a), F.lit(1)), F.dayofmonth(a) - 1)
        last = F.when(in_year(F.year(b)) <= b, in_year(F.year(b))).otherwise(in_year(F.year(b) - 1))
        # days beyond whole months; below zero they are counted from the month before, by its length
        days = F.dayofmonth(b) - F.dayofmonth(a)
        days = days + F.when(days < 0, F.dayofmonth(F.last_day(F.add_months(b, -1)))).otherwise(0)
        made = {"D": F.datediff(b, a), "M": months, "Y": F.floor(months / 12), "YM": months % 12, "MD": days, "YD": F.datediff(b, last)}.get(unit[1].upper())
        if made is None:
            return self.cell("num", F.lit(None).cast("double"), F.lit(NUM))
        return self.cell("num", made.cast("double"), ea, eb, F.when(b < a, NUM))

    def f_networkdays(self, start, end):
        (a, ea), (b, eb) = self.date(self.compile(start)), self.date(self.compile(end))
        lo, hi = F.least(a, b), F.greatest(a, b)
        upto = lambda d: (n := F.datediff(d, F.lit("1899-12-31").cast("date"))) is not None and F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))  # noqa: E731  working days before d; the origin precedes a Monday
        count = upto(F.date_add(hi, 0)) - upto(F.date_sub(lo, 1))
        return self.cell("num", (count * F.when(b < a, -1).otherwise(1)).cast("double"), ea, eb)

    # conditional aggregates
    def _criterion(self, column: str, node) -> tuple[str, object]:
        """("fixed", condition) or ("key", key of the column, key of the row)."""
        k = V.kind_of(self.df, column)
        c = V.col(column)
        if node[0] == "neg" and node[1][0] == "num":
            node = ("num", -node[1][1])
        if node[0] == "num":
            return "fixed", V.to_number(c, k) == node[1]
        if node[0] == "text":
            m = re.match(r"(<>|<=|>=|=|<|>)?(.*)", node[1], re.S)
            sign, rest = m[1] or "=", m[2].strip()
            number = re.fullmatch(r"[+-]?\d+\.?\d*", rest)
            if number and (k == "number" or sign in ("<", ">", "<=", ">=")):
                x, y = V.to_number(c, k), F.lit(float(rest))
            elif sign in ("=", "<>") and re.search(r"[*?]", rest):
                pattern = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in rest.lower())
                hit = F.coalesce(V.norm(c, k).rlike(f"(?s)^{pattern}$"), F.lit(False))
                return "fixed", hit if sign == "=" else ~hit
            else:
                x, y = V.norm(c, k), F.lit(rest.lower())
            made = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
            return "fixed", F.coalesce(made, F.lit(sign == "<>"))
        if node[0] == "col":
            other = find_column(self.df, node[1])
            return "key", V.match_key(c, k), V.match_key(V.col(other), V.kind_of(self.df, other))
        raise FormulaError("a criterion is a value, a text or a column")

    def _conditional(self, pairs, value: str | None, how: str) -> Cell:
        x = V.to_number(V.col(value), V.kind_of(self.df, value)) if value else F.lit(1.0)
        tests = [self._criterion(find_column(self.df, c[1]), n) for c, n in pairs]
        fixed = reduce(lambda p, q: p & q, [t[1] for t in tests if t[0] == "fixed"], F.lit(True))
        keys = [t for t in tests if t[0] == "key"]
        picked = F.when(F.coalesce(fixed, F.lit(False)), x)
        agg = {"count": F.count(picked).cast("double"), "sum": F.coalesce(F.sum(picked), F.lit(0.0)), "average": F.avg(picked)}[how]
        name = f"__agg{len(self.found)}" if not self.dry else ""
        mark = f"{how}:{value}:{pairs}"
        if not keys:
            v = F.lit(self.total(mark, agg)).cast("double")
        elif self.dry:
            v = F.lit(None).cast("double")
        else:
            # an aggregate by key, joined back: no row meets more than one
            table = self.df.select(*[k[1].alias(f"{name}k{i}") for i, k in enumerate(keys)], picked.alias("__x")).groupBy(*[f"{name}k{i}" for i in range(len(keys))]).agg({"count": F.count("__x").cast("double"), "sum": F.sum("__x"), "average": F.avg("__x")}[how].alias(name))
            self.found[name] = True
            on = reduce(lambda p, q: p & q, [k[2] == F.col(f"{name}k{i}") for i, k in enumerate(keys)])
            self.df = self.df.join(table, on, "left").drop(*[f"{name}k{i}" for i in range(len(keys))])
            v = F.col(name) if how == "average" else F.coalesce(name, F.lit(0.0))
        return self.cell("num", v, *([F.when(v.isNull(), DIV)] if how == "average" else []))

    def f_countif(self, c, n):
        return self._conditional([(c, n)], None, "count")

    def f_countifs(self, *args):
        return self._conditional(list(zip(args[::2], args[1::2])), None, "count")

    def f_sumif(self, c, n, value=None):
        return self._conditional([(c, n)], find_column(self.df, (value or c)[1]), "sum")

    def f_sumifs(self, value, *args):
        return self._conditional(list(zip(args[::2], args[1::2])), find_column(self.df, value[1]), "sum")

    def f_averageif(self, c, n, value=None):
        return self._conditional([(c, n)], find_column(self.df, (value or c)[1]), "average")


def median(df: DataFrame, x: Column) -> float | None:
    """The exact median. Values are counted first, then their counts are summed along the values, range by range: no task holds all."""
    from ..lineage import scan

    counted = df.select(x.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ran = scan(counted, [], [F.col("v").asc()], ["n"], "sum", ["upto"])
    half = ran.agg(F.max("upto")).first()[0]
    if half is None:
        return None
    low, high = ran.agg(*[F.min(F.when(F.col("upto") >= k, F.col("v"))) for k in ((half + 1) // 2, half // 2 + 1)]).first()
    return (low + high) / 2


def formula(df: DataFrame, text: str, today: Column | None = None) -> tuple[DataFrame, Cell]:
    """``df`` (with helper columns where criteria are joined) and the formula's cell."""
    tree = parse(text)
    compiler = Compiler(df, today)
    compiler.compile(tree)
    if compiler.totals:
        names = list(compiler.totals)
        plain = [n for n in names if isinstance(compiler.totals[n], Column)]
        row = df.agg(*[compiler.totals[n].alias(f"t{i}") for i, n in enumerate(plain)]).first() if plain else ()
        compiler.found = {n: row[i] for i, n in enumerate(plain)} | {n: median(df, compiler.totals[n][1]) for n in names if n not in plain}
    compiler.dry = False
    cell = compiler.compile(tree)
    value = F.round(cell.value, 10) if cell.kind == "num" else cell.value
    return compiler.df, Cell(cell.kind, F.when(cell.error.isNull(), value), cell.error)
