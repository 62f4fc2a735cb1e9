"""One recipe over many tables that stand in one DataFrame.

A column tells the tables apart.  A step is fitted by one aggregate for all of
them, grouped by that column, and planned once: a table's own constants are
looked up in the plan.  So the jobs are those of one table, whatever the number
of tables.  Tables that a step treats differently (it fails on some of them, or
other columns of theirs are blank) go on in branches of their own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import col as c_
from ..functions.text import snake_case
from ..operators.base import TOOLS, Change
from ..operators.categories import canonical_spellings
from ..operators.columns import _named
from ..operators.lookup import attach, build, ranked
from ..operators.missing import _fill, fences
from ..operators.quantiles import per_group, quantiles
from ..session import stage
from .profile import SEPARATOR
from .recipe import StepRun, resolve

_OUT = "_mapped"
Fits = dict  # group -> fitted constants, or the ValueError that stops the step there


@dataclass
class Branch:
    """Tables that went through the same steps."""
    df: DataFrame
    groups: list[str]
    runs: list[StepRun] = field(default_factory=list)


def run_recipe_by(df: DataFrame, by: str, groups: list[str], steps: list[dict]) -> list[Branch]:
    """The steps on every table; the staged copies belong to the open workspace."""
    branches = [Branch(cells.nan_to_null(df), groups)]
    for i, s in enumerate(steps):
        later = any(t.get("tool") in TOOLS and TOOLS[t["tool"]].fit for t in steps[i + 1:])
        branches = [b for branch in branches for b in _step(branch, by, i, s, later)]
    return branches


def _params(df: DataFrame, by: str, tool: str, col: str | None, params: dict) -> dict:
    """Parameters that leave the tables' column out of what a step looks at."""
    if tool == "drop_duplicates" and (params.get("subset") or col):
        return {**params, "subset": [*(params.get("subset") or [col]), by]}
    if tool == "drop_blank_rows" and not col:
        return {**params, "min_non_null": int(params.get("min_non_null", 1)) + 1}
    if tool == "rename_columns":
        named = params.get("mapping") or {n: snake_case(n) or n for n in df.columns if n != by}
        return {**params, "mapping": {**named, by: by}}
    return params


def _step(branch: Branch, by: str, index: int, step: dict, later: bool) -> list[Branch]:
    started = time.perf_counter()
    df, out = branch.df, []
    col = resolve(step.get("col"), [c for c in df.columns if c != by])
    tool = TOOLS.get(step.get("tool"))

    def ended(run: StepRun, groups: list[str], after: DataFrame) -> None:
        run.duration_ms = round((time.perf_counter() - started) * 1000, 1)
        rows = after if groups == branch.groups else after.where(c_(by).isin(groups))
        out.append(Branch(rows, groups, [*branch.runs, run]))

    def failed(error: Exception, groups: list[str]) -> None:
        ended(StepRun(step, index, col, "error", f"{type(error).__name__}: {error}"), groups, df)

    if tool is None:
        ended(StepRun(step, index, col, "skipped", f"unknown tool: {step.get('tool')}"), branch.groups, df)
        return out
    params = _params(df, by, tool.name, col, step.get("params") or {})
    try:
        if tool.needs_column and col not in df.columns:
            raise ValueError(f"no column '{col}'")
        if tool.check:
            tool.check(params)
        fits: Fits = _fit(df, by, branch.groups, tool, col, params) if tool.fit else dict.fromkeys(branch.groups, {})
        alike: dict[str, list[str]] = {}
        for g in branch.groups:
            alike.setdefault(_kind_of_fit(tool.name, fits[g]), []).append(g)
    except (ValueError, TypeError, KeyError, PySparkException) as exc:
        failed(exc, branch.groups)
        return out
    for groups in alike.values():
        first = fits[groups[0]]
        if isinstance(first, Exception):
            failed(first, groups)
            continue
        try:
            mine = df if groups == branch.groups else df.where(c_(by).isin(groups))
            planner = PLANS.get(tool.name) if tool.fit and "given" not in first else None

            def plan(table: DataFrame, planner=planner, first=first) -> Change:
                if planner:
                    return planner(table, by, col, params, {g: fits[g] for g in groups})
                return tool.plan(table, col, params, first.get("given", first))

            run = StepRun(step, index, col, change=plan(mine), before=mine, replan=plan)
            run.stats = {g: {k: v for k, v in fits[g].items() if isinstance(v, (int, float, str, list))}
                         for g in groups}
            after = run.change.apply(mine)
            if tool.shuffles(params) and later:
                after = stage(after, "recipe")
            run.after = after
            ended(run, groups, after)
        except (ValueError, TypeError, KeyError, PySparkException) as exc:
            failed(exc, groups)
    return out


def _kind_of_fit(tool: str, fit) -> str:
    """Tables with equal kinds share a plan."""
    if isinstance(fit, Exception):
        return f"error {fit}"
    if tool == "drop_blank_columns":
        return repr(fit["columns"])
    return type(fit.get("fill")).__name__ if tool == "impute_missing" else ""


def _fit(df: DataFrame, by: str, groups: list[str], tool, col: str | None, params: dict) -> Fits:
    if tool.name in FITS:
        return FITS[tool.name](df, by, groups, col, params)
    # a user's own step: fitted table by table, in as many jobs as there are tables
    out: Fits = {}
    for g in groups:
        try:
            out[g] = {"given": tool.fit(df.where(c_(by) == g).drop(c_(by)), col, params)}
        except ValueError as exc:
            out[g] = exc
    return out


def _grouped(df: DataFrame, by: str, *columns: Column) -> dict[str, tuple]:
    return {r[0]: tuple(r)[1:] for r in df.groupBy(c_(by)).agg(*columns).collect()}


def _moments(df: DataFrame, by: str, groups: list[str], col: str) -> dict[str, dict]:
    x = cells.finite(cells.as_number(df, col))
    found = _grouped(df, by, F.count(x), F.min(x), F.max(x), F.avg(x), F.stddev_samp(x))
    names = ("n", "min", "max", "mean", "std")
    return {g: dict(zip(names, found.get(g, (0, None, None, None, None)), strict=True)) for g in groups}


def _fit_scale(df, by, groups, col, params) -> Fits:
    out: Fits = {}
    for g, m in _moments(df, by, groups, col).items():
        if m["n"] < 2:
            out[g] = ValueError(f"scaling '{col}' takes two numbers or more")
        elif m["min"] == m["max"]:
            out[g] = ValueError(f"all numbers in '{col}' are equal, so they have no scale")
        else:
            out[g] = m
    return out


def _plan_scale(df, by, col, params, fits) -> Change:
    x = cells.finite(cells.as_number(df, col))
    if params.get("method", "minmax") == "minmax":
        zero = {g: float(f["min"]) for g, f in fits.items()}
        unit = {g: float(f["max"] - f["min"]) for g, f in fits.items()}
    else:
        zero, unit = {g: f["mean"] for g, f in fits.items()}, {g: f["std"] for g, f in fits.items()}
    return Change(assign={col: (x - per_group(by, zero)) / per_group(by, unit)},
                  flags={"rows_affected": x.isNotNull()}, stats={"method": params.get("method", "minmax")})


def _fit_round(df, by, groups, col, params) -> Fits:
    found = _grouped(df, by, F.count(cells.as_number(df, col)))
    return {g: {} if found.get(g, (0,))[0] else ValueError(f"no number to round in '{col}'") for g in groups}


def _fit_outliers(df, by, groups, col, params) -> Fits:
    if params.get("method", "iqr") == "zscore":
        return _moments(df, by, groups, col)
    found = quantiles(df, {col: cells.as_number(df, col)}, [0.25, 0.75], bool(params.get("approximate")), by)
    return {g: dict(zip(("q1", "q3"), found.get(g, {}).get(col, (None, None)), strict=True)) for g in groups}


def _plan_outliers(df, by, col, params, fits) -> Change:
    x = cells.finite(cells.as_number(df, col))
    low, high = {}, {}
    if params.get("method", "iqr") == "zscore":
        mean, std = ({g: f[k] for g, f in fits.items() if f["std"]} for k in ("mean", "std"))
        far = F.abs((x - per_group(by, mean)) / per_group(by, std)) > float(params.get("threshold", 3.0))
    else:
        for g, f in fits.items():
            if f["q1"] is not None and not (params.get("require_spread") and f["q1"] == f["q3"]):
                low[g], high[g] = fences(f["q1"], f["q3"])
        far = (x < per_group(by, low)) | (x > per_group(by, high))
    far = F.coalesce(far, F.lit(False))
    stats = {"method": params.get("method", "iqr")}
    if params.get("action") == "drop":
        return Change(keep=~far, stats=stats | {"action": "drop"})
    return Change(assign={f"{col}_outlier": far}, flags={"rows_affected": far}, stats=stats)


def _fit_impute(df, by, groups, col, params) -> Fits:
    strategy = params.get("strategy", "flag_only")
    if strategy == "flag_only":
        return dict.fromkeys(groups, {})
    if strategy == "constant":
        return dict.fromkeys(groups, {"fill": params["value"]})
    if strategy == "mode":
        counted = df.where(c_(col).isNotNull()).groupBy(c_(by).alias("g"), c_(col).alias("v")).count()
        top = counted.withColumn("r", F.row_number().over(
            Window.partitionBy("g").orderBy(F.desc("count"), F.asc("v")))).where("r = 1")
        found, missing = {r["g"]: r["v"] for r in top.collect()}, f"'{col}' is empty, it has no mode"
    else:
        missing = f"no number in '{col}' to take a {strategy} of"
        if strategy == "mean":
            found = {g: m["mean"] for g, m in _moments(df, by, groups, col).items()}
        else:
            middle = quantiles(df, {col: cells.as_number(df, col)}, [0.5], bool(params.get("approximate")), by)
            found = {g: m[col][0] for g, m in middle.items()}
    return {g: {"fill": found[g]} if found.get(g) is not None else ValueError(missing) for g in groups}


def _plan_impute(df, by, col, params, fits) -> Change:
    missing = c_(col).isNull()
    assign: dict[str, Column] = {f"{col}_missing": missing}
    fills = {g: f["fill"] for g, f in fits.items() if "fill" in f}
    if fills:
        # the widest type that any of the values asks for holds them all
        typed = {g: _fill(df, col, v) for g, v in fills.items()}
        new = None
        for g, c in typed.items():
            new = F.when(c_(by) == g, c) if new is None else new.when(c_(by) == g, c)
        assign[col] = new
    return Change(assign=assign, flags={"rows_affected": missing},
                  stats={"strategy": params.get("strategy", "flag_only")})


def _of_group(by: str, key: Column) -> Column:
    return F.concat(c_(by), F.lit(SEPARATOR), key)


def _fit_standardize(df, by, groups, col, params) -> Fits:
    if params.get("mapping"):
        return dict.fromkeys(groups, {"given": TOOLS["standardize_categories"].fit(df, col, params)})
    lookup = build(canonical_spellings(df, col, by))
    return {g: {"lookup": lookup} for g in groups}


def _plan_standardize(df, by, col, params, fits) -> Change:
    old = cells.as_text(df, col)
    base = attach(df, _of_group(by, cells.fold(old)), next(iter(fits.values()))["lookup"], _OUT)
    new = F.coalesce(c_(_OUT), old)
    return Change(assign={col: new}, base=base, helpers=[_OUT], flags={"rows_affected": cells.changed(old, new)})


def _fit_encode(df, by, groups, col, params) -> Fits:
    order, first = params.get("order", "sorted"), params.get("order_by")
    if order == "appearance" and not first:
        raise ValueError("encode order 'appearance' needs params.order_by: "
                         "a Spark table has no row order of its own")
    found = (df.filter(c_(col).isNotNull()).groupBy(c_(by).alias("g"), cells.as_text(df, col).alias("t"))
             .agg(F.count(F.lit(1)).alias("n"), (F.min(c_(first)) if first else F.lit(None)).alias("first")))
    sort = {"sorted": [F.asc("t")], "frequency": [F.desc("n"), F.asc("t")],
            "appearance": [F.asc_nulls_last("first"), F.asc("t")]}[order]
    # numbered over all tables, then counted from each table's first
    placed = stage(ranked(found, [F.asc("g"), *sort], 0), "codes")
    begin = placed.groupBy("g").agg(F.min("v").alias("begin"))
    table = placed.join(F.broadcast(begin), "g").select(
        F.concat("g", F.lit(SEPARATOR), "t").alias("k"),
        (F.col("v") - F.col("begin") + int(params.get("start", 1))).alias("v"), "n")
    lookup = build(stage(table, "codes"), written=True)
    return {g: {"lookup": lookup} for g in groups}


def _plan_encode(df, by, col, params, fits) -> Change:
    target = f"{col}_code" if params.get("new_column") else col
    base = attach(df, _of_group(by, cells.as_text(df, col)), next(iter(fits.values()))["lookup"], _OUT)
    return Change(assign={target: c_(_OUT)}, base=base, helpers=[_OUT],
                  flags={"rows_affected": c_(col).isNotNull()}, stats={"target": target})


def _fit_blank_columns(df, by, groups, col, params) -> Fits:
    if named := _named(df, col, params):
        return dict.fromkeys(groups, {"columns": named})
    kinds = {n: k for n, k in cells.kinds(df).items() if n != by}
    found = _grouped(df, by, *[F.max(~cells.blank(c_(n), k)) for n, k in kinds.items()])
    return {g: {"columns": [n for n, used in zip(kinds, found.get(g, [None] * len(kinds)), strict=True) if not used]}
            for g in groups}


def _plan_blank_columns(df, by, col, params, fits) -> Change:
    gone = next(iter(fits.values()))["columns"]
    return Change(table=df.drop(*[c_(n) for n in gone]), stats={"columns_dropped": gone})


def _plan_round(df, by, col, params, fits) -> Change:
    return TOOLS["round_numbers"].plan(df, col, params, {})


FITS: dict[str, Callable[..., Fits]] = {
    "scale_numeric": _fit_scale, "round_numbers": _fit_round, "flag_outliers": _fit_outliers,
    "impute_missing": _fit_impute, "standardize_categories": _fit_standardize,
    "encode_categories": _fit_encode, "drop_blank_columns": _fit_blank_columns,
}
PLANS: dict[str, Callable[..., Change]] = {
    "scale_numeric": _plan_scale, "round_numbers": _plan_round, "flag_outliers": _plan_outliers,
    "impute_missing": _plan_impute, "standardize_categories": _plan_standardize,
    "encode_categories": _plan_encode, "drop_blank_columns": _plan_blank_columns,
}
