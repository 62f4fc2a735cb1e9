"""Steps for missing values, outliers and value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.cells import col as c_
from .base import Change, step
from .needs import Need

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _impute_params(params: dict) -> None:
    strategy = params.get("strategy", "flag_only")
    if strategy not in ("flag_only", "mean", "median", "mode", "constant"):
        raise ValueError(f"no such strategy: {strategy}")
    if strategy == "constant" and params.get("value") is None:
        raise ValueError("a constant fill takes params.value")


def _impute_need(params: dict) -> Need | None:
    return {"mode": Need(mode=True), "mean": Need(moments=True),
            "median": Need(probs=(0.5,), approximate=bool(params.get("approximate")))}.get(
        params.get("strategy", "flag_only"))


def _impute_fill(col: str, params: dict, found: dict) -> dict:
    strategy = params.get("strategy", "flag_only")
    if strategy == "flag_only":
        return {}
    if strategy == "constant":
        return {"fill": params["value"]}
    if strategy == "mode":
        if found["mode"] is None:
            raise ValueError(f"'{col}' is empty, it has no mode")
        return {"fill": found["mode"]}
    fill = found["mean"] if strategy == "mean" else found["quantiles"][0]
    if fill is None:
        raise ValueError(f"no number in '{col}' to take a {strategy} of")
    return {"fill": fill}


@step("impute_missing", needs=_impute_need, answer=_impute_fill, check=_impute_params,
      writes=lambda col, params: {col, f"{col}_missing"},
      asked_only=lambda params: params.get("strategy", "flag_only") != "flag_only")
def impute_missing(df: DataFrame, col, params, fitted) -> Change:
    """Always adds ``<col>_missing``; fills only when a strategy is named."""
    missing = c_(col).isNull()
    assign: dict[str, Column] = {f"{col}_missing": missing}
    stats = {"strategy": params.get("strategy", "flag_only")}
    if "fill" in fitted:
        assign[col] = _fill(df, col, fitted["fill"])
        stats["fill_value"] = str(fitted["fill"])
    return Change(assign=assign, flags={"rows_affected": missing}, stats=stats)


def _fill(df: DataFrame, col: str, fill) -> Column:
    """Nulls replaced; a column of whole numbers widens to double when the
    value is not whole, and to text when the value is no number."""
    dtype = df.schema[col].dataType
    if cells.kind_of(dtype) == "text" and not isinstance(fill, str):
        return F.coalesce(c_(col), F.lit(str(fill)))
    if cells.kind_of(dtype) == "number":
        if isinstance(fill, str):
            try:
                fill = float(fill)
            except ValueError:
                return F.coalesce(cells.as_text(df, col), F.lit(fill))
        if isinstance(dtype, _WHOLE) and float(fill) != int(fill):
            return F.coalesce(c_(col).cast("double"), F.lit(float(fill)))
    return F.coalesce(c_(col), F.lit(fill).cast(dtype))


def _outlier_method(params: dict) -> None:
    if params.get("method", "iqr") not in ("iqr", "zscore"):
        raise ValueError("method must be iqr or zscore")


def _outlier_need(params: dict) -> Need:
    if params.get("method", "iqr") == "zscore":
        return Need(moments=True)
    return Need(probs=(0.25, 0.75), approximate=bool(params.get("approximate")))


def _outlier_limits(col: str, params: dict, found: dict) -> dict:
    if params.get("method", "iqr") == "zscore":
        return found
    return dict(zip(("q1", "q3"), found["quantiles"], strict=True))


def fences(q1: float, q3: float) -> tuple[float, float]:
    spread = q3 - q1
    return q1 - 1.5 * spread, q3 + 1.5 * spread


def outlier(x: Column, params: dict, fitted: dict) -> Column:
    """True for a number outside the fences; never null."""
    x = cells.finite(x)
    if params.get("method", "iqr") == "zscore":
        if not fitted["std"]:
            return F.lit(False)
        score = F.abs((x - F.lit(fitted["mean"])) / F.lit(fitted["std"]))
        far = score > float(params.get("threshold", 3.0))
    else:
        if fitted["q1"] is None:
            return F.lit(False)
        if params.get("require_spread") and fitted["q1"] == fitted["q3"]:
            return F.lit(False)
        low, high = fences(fitted["q1"], fitted["q3"])
        far = (x < F.lit(low)) | (x > F.lit(high))
    return F.coalesce(far, F.lit(False))


@step("flag_outliers", needs=_outlier_need, answer=_outlier_limits, check=_outlier_method,
      writes=lambda col, params: None if params.get("action") == "drop" else {f"{col}_outlier"},
      asked_only=lambda params: params.get("action") == "drop")
def flag_outliers(df: DataFrame, col, params, fitted) -> Change:
    """Adds ``<col>_outlier``; with ``action='drop'`` removes those rows."""
    far = outlier(cells.as_number(df, col), params, fitted)
    stats = {"method": params.get("method", "iqr")}
    if params.get("action") == "drop":
        return Change(keep=~far, stats=stats | {"action": "drop"})
    return Change(assign={f"{col}_outlier": far}, flags={"rows_affected": far}, stats=stats)


def outside(number: Column, low, high) -> Column:
    """True where a number lies under ``low`` or over ``high``."""
    out = F.lit(False)
    if low is not None:
        out = out | (number < float(low))
    if high is not None:
        out = out | (number > float(high))
    return out


@step("validate_rule", writes=lambda col, params: {f"{col}_invalid"})
def validate_rule(df: DataFrame, col, params, fitted) -> Change:
    """Adds ``<col>_invalid`` for a range or an allowed list; missing cells
    and text that is no number pass the range."""
    bad = outside(cells.as_number(df, col), params.get("min"), params.get("max"))
    bad = F.coalesce(bad, F.lit(False))
    if "allowed" in params:
        bad = bad | (c_(col).isNotNull() & ~cells.is_one_of(df, col, list(params["allowed"])))
    return Change(assign={f"{col}_invalid": bad}, flags={"rows_affected": bad})
