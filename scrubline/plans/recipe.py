"""Recipes: lists of steps that are checked, run, audited, saved and replayed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, masks
from ..functions import patterns as P
from ..functions.text import snake_case
from ..operators.base import TOOLS, Change, Tool, plan_step
from ..operators.needs import Need, gather
from ..session import discard, read_text, small_table, stage, write_text

VERSION = 1
FIELDS = ("tool", "col", "params", "reason")


def check_steps(steps: list[dict], columns: list[str] | None = None,
                allow: bool = False) -> list[dict]:
    """Raise ``ValueError`` unless the steps are well formed and safe.

    With ``columns`` every column a step names has to be one of them (or the
    snake_case form of one).  Steps that delete or change values without a
    signal in the profile need ``allow``: somebody asked for them.
    """
    known = set(columns or []) | {snake_case(c) for c in columns or []}
    for i, s in enumerate(steps):
        if not isinstance(s, dict) or set(s) != set(FIELDS) or not isinstance(s["params"], dict):
            raise ValueError(f"step {i}: needs exactly the fields {', '.join(FIELDS)}")
        tool = TOOLS.get(s["tool"])
        if tool is None:
            raise ValueError(f"step {i}: unknown tool '{s['tool']}'")
        if tool.needs_column and s["col"] is None:
            raise ValueError(f"step {i}: {tool.name} works on a column, none is named")
        if tool.asked_only(s["params"]) and not allow:
            raise ValueError(f"step {i}: {tool.name} {s['params']} changes or deletes data; "
                             "pass allow=True if that is wanted")
        if tool.check:
            tool.check(s["params"])
        if columns is not None:
            named = [s["col"]] if s["col"] is not None else []
            for c in named + list(s["params"].get("columns", [])):
                if c not in known:
                    raise ValueError(f"step {i}: no column '{c}'")
    return steps


def save_recipe(spark: SparkSession, steps: list[dict], path: str,
                source: str | None = None) -> str:
    check_steps(steps, allow=True)
    created = datetime.now(timezone.utc).isoformat(timespec="seconds")
    write_text(spark, path, json.dumps({
        "recipe": VERSION, "created": created, "source": source, "steps": steps,
    }, indent=2, ensure_ascii=False))
    return path


def load_recipe(spark: SparkSession, path: str) -> list[dict]:
    data = json.loads(read_text(spark, path))
    return check_steps(data["steps"] if isinstance(data, dict) else data, allow=True)


@dataclass
class StepRun:
    """What one step did."""
    step: dict
    index: int
    col: str | None = None
    status: str = "ok"
    error: str | None = None
    fitted: dict = field(default_factory=dict)
    change: Change | None = None
    before: DataFrame | None = None
    after: DataFrame | None = None
    duration_ms: float = 0.0
    replan: Callable[[DataFrame], Change] | None = None  # the change on another plan of the table
    stats: dict = field(default_factory=dict)            # per group, if there are several


@dataclass
class RecipeRun:
    df: DataFrame
    runs: list[StepRun]
    staged: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Delete the written intermediate tables, once the result is stored
        and the audit taken."""
        for table in self.staged:
            discard(table)
        self.staged.clear()

    @property
    def fitted(self) -> list[dict | None]:
        """Constants of each step, to replay the recipe with frozen fits."""
        return [r.fitted if r.status == "ok" else None for r in self.runs]

    def audit(self) -> DataFrame:
        return audit_table(self)


def resolve(col: str | None, columns: list[str]) -> str | None:
    """The column a step means: by name, else the only one with the same
    snake_case form."""
    if col is None or col in columns:
        return col
    same = [c for c in columns if snake_case(c) == snake_case(col)]
    return same[0] if len(same) == 1 else col


def run_recipe(df: DataFrame, steps: list[dict],
               fitted: list[dict | None] | None = None) -> RecipeRun:
    """Chain the steps into one lazy plan.

    Unknown tools are skipped and failing steps recorded; the run goes on.
    After a step that shuffles the table, the result is written out once if a
    later step still has to be fitted: the fits and the final pass then read
    the columns they need instead of repeating the shuffle.

    Steps whose columns no step between them writes are fitted together, in the
    passes of one (``together``); the first of them takes the time.
    """
    current = cells.nan_to_null(df)
    runs: list[StepRun] = []
    staged: list[DataFrame] = []
    found: dict[int, dict] = {}   # by step: what was gathered for its fit
    alone: set[int] = set()       # steps that could not be gathered for together
    for i, s in enumerate(steps):
        started = time.perf_counter()
        run = StepRun(s, i, resolve(s.get("col"), current.columns))
        runs.append(run)
        tool = TOOLS.get(s.get("tool"))
        if tool is None:
            run.status, run.error = "skipped", f"unknown tool: {s.get('tool')}"
            continue
        params = s.get("params") or {}
        try:
            known = fitted[i] if fitted else None
            if known is None and tool.fit:
                if tool.needs and i not in found and i not in alone:
                    wanted = together(current, steps, i, fitted)
                    try:
                        found |= dict(zip(wanted, gather(current, list(wanted.values())), strict=True))
                    except (ValueError, TypeError, KeyError, PySparkException):
                        alone.update(wanted)  # each tells its own error
                run.fitted = _fit(current, tool, run.col, params, found.get(i))
            else:
                run.fitted = known or {}
            run.change = plan_step(current, tool.name, run.col, params, run.fitted)
            after = run.change.apply(current)
            if tool.shuffles(params) and not fitted and _fits_later(steps[i + 1:]):
                after = stage(after, "recipe")
                staged.append(after)
            run.before, run.after, current = current, after, after
        except (ValueError, TypeError, KeyError, PySparkException) as exc:
            run.status, run.error = "error", f"{type(exc).__name__}: {exc}"
        run.duration_ms = round((time.perf_counter() - started) * 1000, 1)
    return RecipeRun(current, runs, staged)


def together(df: DataFrame, steps: list[dict], first: int,
             fitted: list[dict | None] | None = None) -> dict[int, tuple[str, Need]]:
    """The steps from ``first`` on that can be fitted on ``df`` as it is now, with
    what they need.

    A step reads its column.  It sees ``df`` as long as no step before it writes
    that column, removes rows or changes other columns; the search ends at a step
    that may do the latter, such as a user's own step that does not say what it
    writes, or one whose column is not there yet.
    """
    wanted: dict[int, tuple[str, Need]] = {}
    written: set[str] = set()
    for i in range(first, len(steps)):
        tool, params = TOOLS.get(steps[i].get("tool")), steps[i].get("params") or {}
        if tool is None:
            continue
        col = steps[i].get("col")
        if i == first:
            col = resolve(col, df.columns)
        if col not in df.columns:
            break
        given = fitted[i] if fitted else None
        need = _need(tool, params) if given is None and col.lower() not in written else None
        if need is not None:
            wanted[i] = (col, need)
        writes = tool.writes(col, params)
        if writes is None:
            break
        written |= {w.lower() for w in writes}
    return wanted


def _need(tool: Tool, params: dict) -> Need | None:
    """None too for a step with wrong parameters, which fails when its turn comes."""
    try:
        if tool.check:
            tool.check(params)
        return tool.needs(params) if tool.needs else None
    except (ValueError, TypeError, KeyError):
        return None


def _fit(df: DataFrame, tool: Tool, col: str | None, params: dict, found: dict | None = None) -> dict:
    if tool.needs_column and col not in df.columns:
        raise ValueError(f"no column '{col}'")
    if tool.check:
        tool.check(params)
    return tool.fit(df, col, params) if found is None else tool.answer(col, params, found)


def _fits_later(steps: list[dict]) -> bool:
    return any(s.get("tool") in TOOLS and TOOLS[s["tool"]].fit for s in steps)


AUDIT = ("step int, tool string, col string, params string, reason string, status string, "
         "error string, rows_affected bigint, stats map<string,string>, "
         "examples array<struct<before:string,after:string>>, duration_ms double")


class _Segment:
    """Steps between two reshapings, counted together in one aggregate.

    Rows that a filter removes are only marked here, so that the counts of
    all filters and column steps of the segment come from the same pass.  An
    aggregate counts right even when lost tasks are run again, which metrics
    collected on the side would not.
    """

    def __init__(self, start: DataFrame, by: str | None = None):
        self.df, self.by = start.withColumn("_alive", F.lit(True)), by
        self.metrics: dict[str, Column] = {}

    def add(self, run: StepRun) -> None:
        alive, change = F.col("_alive"), run.change
        if change.keep is not None:
            flag = f"_flag{run.index}"
            kept = F.coalesce(change.keep, F.lit(False))
            self.df = self.df.withColumns({flag: alive & ~kept, "_alive": alive & kept})
            self.metrics[f"{run.index}:rows_affected"] = F.count_if(F.col(flag))
            return
        if change.base is not None:  # a lookup or a helper column is joined on again
            tool = TOOLS[run.step["tool"]]
            change = run.replan(self.df) if run.replan else tool.plan(
                self.df, run.col, run.step.get("params") or {}, run.fitted)
        new = dict(change.assign)
        for name, condition in change.flags.items():
            flag = f"_flag{run.index}_{name}"
            new[flag] = alive & F.coalesce(condition, F.lit(False))
            self.metrics[f"{run.index}:{name}"] = F.count_if(F.col(flag))
        base = change.base if change.base is not None else self.df
        if run.col in change.assign and "rows_affected" in change.flags:
            old = f"_old{run.index}"
            new[old] = cells.as_text(run.before, run.col)
            self._examples(run, old, f"_flag{run.index}_rows_affected")
        self.df = base.withColumns(new).drop(*change.helpers)
        if f"_old{run.index}" in new:
            text = cells.as_text(run.after, run.col)
            self.df = self.df.withColumn(f"_new{run.index}", text)

    def _examples(self, run: StepRun, old: str, flag: str) -> None:
        pair = F.when(F.col(flag), F.struct(F.col(old).alias("before"),
                                            F.col(f"_new{run.index}").alias("after")))
        mixed = F.when(F.col(flag), F.xxhash64(old))
        self.metrics[f"{run.index}:examples"] = F.array_compact(F.array_distinct(F.array(
            F.min(pair), F.max(pair), F.min_by(pair, mixed))))

    def measure(self, rows: bool) -> dict:
        """``{group: {metric: value}}`` in one aggregate; the only group is None
        for a single table."""
        metrics = dict(self.metrics)
        if rows:
            metrics["rows"] = F.count_if(F.col("_alive"))
        if not metrics:
            return {}
        counted = [m.alias(f"m{i}") for i, m in enumerate(metrics.values())]
        if self.by is None:
            return {None: dict(zip(metrics, self.df.agg(*counted).first()))}
        return {r[0]: dict(zip(metrics, tuple(r)[1:]))
                for r in self.df.groupBy(cells.col(self.by)).agg(*counted).collect()}


def audit_table(result: RecipeRun) -> DataFrame:
    """One row per step: status, counts, fitted constants, masked examples."""
    found = measured_changes(result.runs).get(None, {})
    rows = [_audit_row(r, found) for r in result.runs]
    return small_table(result.df.sparkSession, rows, AUDIT).transform(_mask_examples)


def audit_by(runs: list[StepRun], by: str, groups: list[str], spark: SparkSession) -> DataFrame:
    """``(group, step, ...)``: the audits of several tables that were cleaned in one."""
    found = measured_changes(runs, by)
    rows = [(g, *_audit_row(r, found.get(g, {}), g)) for g in groups for r in runs]
    return small_table(spark, rows, "group string, " + AUDIT).transform(_mask_examples)


def measured_changes(runs: list[StepRun], by: str | None = None) -> dict[str | None, dict]:
    """Counts and examples of every step, ``{group: {"index:metric": value}}``."""
    ok = [r for r in runs if r.status == "ok"]
    found: dict[str | None, dict] = {}
    rows_before: dict[int, dict] = {}
    segment: _Segment | None = None
    pending: StepRun | None = None  # last deduplication, still to be counted after

    def close(rows: bool) -> dict:
        nonlocal pending
        measured = segment.measure(rows=rows)
        for g, values in measured.items():
            found.setdefault(g, {}).update({k: v for k, v in values.items() if k != "rows"})
        if pending:
            for g, before in rows_before[pending.index].items():
                left = _rows_at_start(measured[g], segment) if g in measured else 0
                found.setdefault(g, {})[f"{pending.index}:rows_affected"] = before - left
            pending = None
        return measured

    for r in ok:
        if segment is None:
            segment = _Segment(r.before, by)
        if r.change.table is None:
            segment.add(r)
            continue
        dedupes = TOOLS[r.step["tool"]].shuffles(r.step.get("params") or {})
        if dedupes or segment.metrics or pending:
            measured = close(rows=True)
            if dedupes:
                rows_before[r.index], pending = {g: m["rows"] for g, m in measured.items()}, r
        segment = _Segment(r.after, by)
    if segment is not None and (segment.metrics or pending):
        close(rows=True)
    return found


def _rows_at_start(measured: dict, segment: _Segment) -> int:
    """Rows entering a segment: those left plus those its filters marked."""
    return measured["rows"] + sum(
        v for k, v in measured.items()
        if k.endswith(":rows_affected") and f"_flag{k.split(':')[0]}" in segment.df.columns)


def _audit_row(r: StepRun, found: dict, group: str | None = None) -> tuple:
    mine = {k.split(":", 1)[1]: v for k, v in found.items() if k.startswith(f"{r.index}:")}
    stats = {k: json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list))
             else str(v) for k, v in {**(r.change.stats if r.change else {}), **r.stats.get(group, {})}.items()}
    stats |= {k: str(v) for k, v in mine.items() if k not in ("rows_affected", "examples")}
    if r.col != r.step.get("col"):
        stats["col_resolved_to"] = str(r.col)
    examples = [(e["before"], e["after"]) for e in mine.get("examples") or []]
    affected = mine.get("rows_affected", 0 if r.status == "ok" else None)
    return (r.index, r.step.get("tool"), r.col, json.dumps(r.step.get("params") or {}),
            r.step.get("reason", ""), r.status, r.error, affected, stats, examples,
            r.duration_ms)


def _mask_examples(audit: DataFrame) -> DataFrame:
    """Examples leave the library masked, whole cells in sensitive columns."""
    hidden = F.coalesce(F.col("col").rlike(P.SENSITIVE_COLUMN), F.lit(False))

    def shown(c: Column) -> Column:
        return F.when(hidden, masks.mask_whole(c)).otherwise(masks.mask_all(c))

    return audit.withColumn("examples", F.transform("examples", lambda e: F.struct(
        shown(e["before"]).alias("before"), shown(e["after"]).alias("after"))))
