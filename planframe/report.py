"""A workbook of results with a sheet that tells how each was calculated, and kept definitions of words."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .sheet import Sheet
from .sources.workbook import write_workbook

HOW = "How calculated"


@dataclass
class Result:
    name: str
    sheet: Sheet
    made_from: str
    shows: str = ""
    steps: list[dict] = field(default_factory=list)
    sql: str | None = None

    def lines(self) -> list[str]:
        """The SQL, or a line for each step: its name and fields."""
        if self.sql:
            return [f"SQL on every row: {self.sql}"]
        told = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return [" ".join([s["op"].replace("_", " "), *[f"{k}={told(v)}" for k, v in s.items() if k != "op"]]) for s in self.steps]


def how_calculated(spark: SparkSession, results: list[Result]) -> DataFrame:
    rows = [(i, r.name, r.made_from, r.shows, "\n".join(r.lines()), "\n".join(r.sheet.notes)) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "`__o0` int, Sheet string, `Made from` string, `What it shows` string, `Steps (run on every row)` string, Notes string")


def write_report(spark: SparkSession, results: list[Result], path: str) -> list[str]:
    """All results and how they were calculated, in one workbook."""
    how = Sheet(how_calculated(spark, results), [("__o0", True)])
    return write_workbook({r.name: r.sheet for r in results} | {HOW: how}, path)


@dataclass
class Definition:
    """What a word means: rows whose ``column`` meets the condition get ``label``, all others ``otherwise``."""

    column: str
    operator: str
    value: str
    label: str
    otherwise: str

    def step(self, name: str) -> dict:
        when = {"conditions": [{"column": self.column, "operator": self.operator, "value": self.value}]}
        return {"op": "label", "name": name, "cases": [{"value": self.label, "when": when}], "default": self.otherwise}


@dataclass
class Dictionary:
    """Definitions by word, kept in a JSON file for each layout: the same columns in the same order, whatever the file."""

    path: str

    def _all(self) -> dict:
        file = Path(self.path)
        return json.loads(file.read_text()) if file.exists() else {}

    def define(self, columns: list[str], word: str, definition: Definition) -> None:
        held = self._all()
        held.setdefault(json.dumps(columns), {})[word] = asdict(definition)
        Path(self.path).write_text(json.dumps(held, ensure_ascii=False, indent=1))

    def of(self, columns: list[str]) -> dict[str, Definition]:
        return {w: Definition(**d) for w, d in self._all().get(json.dumps(columns), {}).items()}
