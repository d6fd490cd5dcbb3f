"""Running plans. A plan is a list of steps, each a dict with ``op`` and the fields of FIELDS."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import columns, files, filters, formats, groups, rows
from ..sheet import PlanError, Sheet, sheet_of

OPS = {
    "filter": filters.filter_rows, "filter_formula": filters.filter_formula, "label": filters.label,
    "select_columns": columns.select_columns, "drop_columns": columns.drop_columns, "rename": columns.rename, "compute": columns.compute, "formula": columns.add_formula, "date_part": columns.date_part,
    "clean_text": columns.clean_text, "drop_blank_rows": columns.drop_blank_rows, "replace": columns.replace_values, "split_column": columns.split_column, "merge_columns": columns.merge_columns, "convert": columns.convert,
    "sort": rows.sort, "top_n": rows.top_n, "dedupe": rows.dedupe, "split_by": rows.split_by, "fill_blanks": rows.fill_blanks, "calculate": rows.calculate,
    "group_by": groups.group_by, "rate": groups.rate, "pivot": groups.pivot, "chart": groups.chart,
    "lookup": files.lookup, "append": files.append, "compare": files.compare,
    "highlight": formats.highlight, "number_format": formats.number_format,
}
#: Required fields, then optional ones.
FIELDS = {
    "filter": ("conditions", "match"), "filter_formula": ("formula", "keep"), "label": ("name cases", "default replace ordered"),
    "select_columns": ("columns", ""), "drop_columns": ("columns", ""), "rename": ("mapping", ""), "compute": ("name expr", "replace"), "formula": ("name formula", "replace"), "date_part": ("column part", "name"),
    "clean_text": ("action", "columns"), "drop_blank_rows": ("", "how"), "replace": ("find replace", "columns"), "split_column": ("column delimiter names", ""), "merge_columns": ("columns name", "separator"), "convert": ("columns to", ""),
    "sort": ("columns", "ascending"), "top_n": ("n", "column largest per"), "dedupe": ("", "columns keep"), "split_by": ("column", ""), "fill_blanks": ("", "columns method value"), "calculate": ("kind column", "per descending name"),
    "group_by": ("", "columns aggregations calculated"), "rate": ("", "columns when formula"), "pivot": ("rows", "columns values func totals calculated"), "chart": ("kind x", "x_part y func title when"),
    "lookup": ("file left_on right_on", "columns"), "append": ("file", ""), "compare": ("file keep", "left_on right_on"),
    "highlight": ("", "when duplicates_in column color"), "number_format": ("columns style", "decimals date_pattern"),
}


@dataclass
class Context:
    files: dict[str, DataFrame | Sheet] = field(default_factory=dict)
    today: Column = field(default_factory=F.current_date)


def read_plan(plan: str | list) -> list[dict]:
    """Steps of a plan, checked for unknown steps and fields."""
    steps = json.loads(plan) if isinstance(plan, str) else plan
    steps = steps.get("steps", []) if isinstance(steps, dict) else steps
    for step in steps:
        op = step.get("op")
        if op not in OPS:
            raise PlanError(f"there is no step {op!r}")
        need, may = (x.split() for x in FIELDS[op])
        if missing := [f for f in need if f not in step]:
            raise PlanError(f"step {op!r} lacks {', '.join(missing)}")
        if extra := [f for f in step if f not in ("op", *need, *may)]:
            raise PlanError(f"step {op!r} has no field {', '.join(extra)}")
    return steps


def check_columns(columns: list[str], steps: list[dict], files: dict[str, list[str]]) -> None:
    """Follows the columns through all steps and refuses a missing one before anything runs.

    After a pivot the headings depend on the data: from there on nothing is checked.
    """
    have = list(columns)

    def need(where: list[str], *names) -> None:
        for n in names:
            if n and n not in where:
                raise PlanError(f"step {step['op']!r}: there is no column {n!r}; the columns are {', '.join(where)}")

    listed = lambda x: [x] if isinstance(x, str) else list(x or [])
    for step in steps:
        op, names = step["op"], listed(step.get("columns"))
        conditions = [c["column"] for w in [step, step.get("when") or {}, *[c["when"] for c in step.get("cases") or []]] for c in w.get("conditions") or []]
        if op == "lookup" or op == "append" or op == "compare":
            if step["file"] not in files:
                raise PlanError(f"there is no table {step['file']!r}; there are {', '.join(files) or 'none'}")
            there = files[step["file"]]
        if op == "lookup":
            need(have, step["left_on"])
            need(there, step["right_on"], *names)
            have += [c if c not in have else f"{c} ({step['file']})" for c in names or [c for c in there if c != step["right_on"]]]
        elif op == "append":
            known = {re.sub(r"[^a-z0-9]", "", c.lower()) for c in have}
            have += [c for c in there if re.sub(r"[^a-z0-9]", "", c.lower()) not in known]
        elif op == "compare":
            if step.get("left_on"):
                need(have, step["left_on"])
                need(there, step.get("right_on") or step["left_on"])
            have = list(there) if step["keep"] == "only_there" else have
        elif op == "pivot":
            need(have, *listed(step["rows"]), *names, step.get("values"))
            return
        else:
            need(have, *names, *conditions, *step.get("mapping", {}), step.get("column"), step.get("duplicates_in"), *listed(step.get("per")), *[a["column"] for a in step.get("aggregations") or []])
            if op == "select_columns":
                have = names
            elif op == "drop_columns":
                have = [c for c in have if c not in names]
            elif op == "rename":
                have = [step["mapping"].get(c, c) for c in have]
            elif op == "group_by":
                have = names + [f"{a['func']}_{a['column']}" for a in step.get("aggregations") or []] + list(step.get("calculated") or {})
            elif op == "rate":
                have = names + ["rows", "matching rows", "% matching"]
            elif op == "split_column":
                have += [n for n in step["names"] if n not in have]
            elif op in ("compute", "formula", "label", "merge_columns", "date_part", "calculate"):
                new = step.get("name") or (f"{step['column']}_{step['part']}" if op == "date_part" else f"{step['kind']}_{step['column']}")
                have += [new] if new not in have else []


def run_plan(sheet: Sheet | DataFrame, plan: str | list, files: dict | None = None, today: str | None = None) -> Sheet:
    """The sheet after all steps; lazy but for checks (conversions, widths, sizes of lookup tables)."""
    sheet = sheet if isinstance(sheet, Sheet) else sheet_of(sheet)
    ctx = Context(files or {}, F.lit(today).cast("date") if today else F.current_date())
    steps = read_plan(plan)
    check_columns(sheet.columns, steps, {n: list(f.columns) for n, f in ctx.files.items()})
    for step in steps:
        sheet = OPS[step["op"]](sheet, step, ctx)
    return sheet


@dataclass
class Session:
    """A sheet, the plans applied to it, and a place in them; undo and redo replay lazily from the original."""

    original: Sheet
    files: dict = field(default_factory=dict)
    today: str | None = None
    plans: list[list[dict]] = field(default_factory=list)
    at: int = 0

    def sheet(self) -> Sheet:
        return run_plan(self.original, [s for p in self.plans[: self.at] for s in p], self.files, self.today)

    def preview(self, plan: str | list, rows: int = 100) -> tuple[list, int]:
        """First rows of the result, and how many rows it has."""
        out = run_plan(self.sheet(), plan, self.files, self.today)
        return out.output().limit(rows).collect(), out.df.count()

    def execute(self, plan: str | list) -> Sheet:
        steps = read_plan(plan)
        run_plan(self.sheet(), steps, self.files, self.today)
        self.plans, self.at = [*self.plans[: self.at], steps], self.at + 1
        return self.sheet()

    def undo(self) -> Sheet:
        if not self.at:
            raise PlanError("there is nothing to undo")
        self.at -= 1
        return self.sheet()

    def redo(self) -> Sheet:
        if self.at == len(self.plans):
            raise PlanError("there is nothing to redo")
        self.at += 1
        return self.sheet()
