"""What a cleaning step is, and the registry of steps by name.

A step has two halves.  ``fit`` runs small aggregates and returns constants or
a mapping; it may raise ``ValueError`` when the step cannot work.  ``plan``
turns those into a :class:`Change` without running anything, so a chain of
steps stays one lazy plan that Catalyst collapses.

A fit that is made of common aggregates says so: ``needs`` names them, and
``answer`` makes the constants of what was found.  A recipe then meets the needs
of all steps that see the same table in shared passes.  Which steps those are
follows from ``writes``, the columns that a step may write.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from .needs import Need, gather


@dataclass
class Change:
    """The effect of one step; exactly one of the first three is used."""

    assign: dict[str, Column] | None = None  # columns written, rows untouched
    keep: Column | None = None               # condition of the rows that stay
    table: DataFrame | None = None           # any other reshaping
    base: DataFrame | None = None            # input with a lookup joined on
    helpers: list[str] = field(default_factory=list)  # lookup columns to drop
    flags: dict[str, Column] = field(default_factory=dict)  # rows to count
    stats: dict = field(default_factory=dict)               # fitted constants

    def apply(self, df: DataFrame) -> DataFrame:
        if self.table is not None:
            return self.table
        if self.keep is not None:
            return df.filter(self.keep)
        out = (self.base if self.base is not None else df).withColumns(self.assign)
        return out.drop(*self.helpers) if self.helpers else out


@dataclass(frozen=True)
class Tool:
    name: str
    plan: Callable[[DataFrame, str | None, dict, dict], Change]
    fit: Callable[[DataFrame, str | None, dict], dict] | None
    check: Callable[[dict], None] | None
    needs_column: bool
    asked_only: Callable[[dict], bool]
    shuffles: Callable[[dict], bool]
    needs: Callable[[dict], Need | None] | None = None
    answer: Callable[[str, dict, dict], dict] | None = None
    #: columns that may be written; None if rows go or others could change
    writes: Callable[[str, dict], set[str] | None] = lambda col, params: None


TOOLS: dict[str, Tool] = {}


def step(name: str, *, fit=None, check=None, needs_column: bool = True,
         asked_only=lambda params: False, shuffles=lambda params: False,
         needs=None, answer=None, writes=lambda col, params: None):
    """Register a step.  Users add their own with the same decorator.

    Either ``fit`` or ``needs`` with ``answer``; neither if nothing is fitted.
    """
    if needs:
        def fit(df, col, params):
            need = needs(params)
            return answer(col, params, gather(df, [(col, need)])[0] if need else {})

    def register(plan):
        TOOLS[name] = Tool(name, plan, fit, check, needs_column, asked_only, shuffles,
                           needs, answer, writes)
        return plan
    return register


def own_column(col: str, params: dict) -> set[str]:
    """``writes`` of a step that changes its column only."""
    return {col}


def plan_step(df: DataFrame, tool: str, col: str | None = None,
              params: dict | None = None, fitted: dict | None = None) -> Change:
    """Fit a step unless ``fitted`` constants are given, then plan it."""
    params = params or {}
    if tool not in TOOLS:
        raise ValueError(f"unknown tool: {tool}")
    spec = TOOLS[tool]
    if spec.needs_column and col is None:
        raise ValueError(f"{tool} works on a column, none is named")
    if col is not None and col not in df.columns:
        raise ValueError(f"no column '{col}'")
    if spec.check:
        spec.check(params)
    if fitted is None:
        fitted = spec.fit(df, col, params) if spec.fit else {}
    return spec.plan(df, col, params, fitted)


def apply_step(df: DataFrame, tool: str, col: str | None = None,
               params: dict | None = None, fitted: dict | None = None) -> DataFrame:
    """``df`` after one step; NaN cells are missing cells."""
    df = cells.nan_to_null(df)
    return plan_step(df, tool, col, params, fitted).apply(df)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))
