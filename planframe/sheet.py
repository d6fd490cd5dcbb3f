"""Sheets: DataFrames whose row order is data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import values as V

HIDDEN = "__"


class PlanError(ValueError):
    """A plan that cannot be run as it stands; the message says why."""


@dataclass
class Sheet:
    """``df`` with hidden columns (names begin with two underscores); ``order``: hidden columns and directions.

    ``split`` names the columns that divide it into sheets; ``formats`` and ``notes`` never change data.
    A note is a text, or a function that counts and gives one when ``told`` asks.
    """

    df: DataFrame
    order: list[tuple[str, bool]] = field(default_factory=list)
    split: list[str] = field(default_factory=list)
    formats: dict[str, dict] = field(default_factory=dict)
    orders: dict[str, list] = field(default_factory=dict)
    charts: list = field(default_factory=list)
    notes: list = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def with_df(self, df: DataFrame, **changes) -> Sheet:
        return replace(self, df=df, **changes)

    def noting(self, *notes) -> Sheet:
        return replace(self, notes=[*self.notes, *notes])

    def told(self) -> list[str]:
        """What the steps found; runs the counts that this takes."""
        return [text for n in self.notes if (text := n() if callable(n) else n)]

    def kind(self, name: str) -> str:
        return V.kind_of(self.df, name)

    def need(self, *names: str) -> None:
        for n in names:
            if n not in self.columns:
                raise PlanError(f"there is no column {n!r}; the columns are {', '.join(self.columns)}")

    def by_order(self, reverse: bool = False) -> list[Column]:
        return [F.col(c).asc_nulls_last() if up != reverse else F.col(c).desc_nulls_last() for c, up in self.order]

    def fresh(self, stem: str) -> str:
        n = 0
        while f"{HIDDEN}{stem}{n}" in self.df.columns:
            n += 1
        return f"{HIDDEN}{stem}{n}"

    def project(self, columns: dict[str, Column]) -> Sheet:
        """A single select of these columns and the hidden ones."""
        return self.with_df(self.df.select(*[c.alias(n) for n, c in columns.items()], *[F.col(h) for h in self.hidden]))

    def output(self, ordered: bool = True) -> DataFrame:
        df = self.df.orderBy(*self.by_order()) if ordered and self.order else self.df
        return df.select(*[V.col(c) for c in self.columns])


def sheet_of(df: DataFrame, order: list[str] | None = None) -> Sheet:
    """A sheet whose rows come in the order of these columns, else in file order."""
    if order:
        names = [f"{HIDDEN}o{i}" for i in range(len(order))]
        return Sheet(df.withColumns({n: V.col(c) for n, c in zip(names, order)}), [(n, True) for n in names])
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("__o0"), F.col("_metadata.row_index").alias("__o1"))
        placed.schema  # analysed here
    except Exception:
        placed = df.withColumns({"__o0": F.lit(""), "__o1": F.monotonically_increasing_id()})
    return Sheet(placed, [("__o0", True), ("__o1", True)])


def main_sheet(sheets: dict[str, Sheet]) -> str:
    """The sheet that plans work on: that with the most rows, of equal ones the first."""
    return max(sheets, key=lambda n: sheets[n].df.count())


def safe_name(name: str, taken: set[str]) -> str:
    """A sheet name without []:*?/\\, of at most 31 characters, unique ignoring case."""
    base = re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"
    out, n = base, 2
    while out.lower() in taken:
        tail = f" ({n})"
        out, n = base[: 31 - len(tail)] + tail, n + 1
    taken.add(out.lower())
    return out
