"""What fits want to know of columns, gathered for many of them at once.

A step that declares a ``Need`` is not fitted by jobs of its own: the needs of
all steps that see the same table are met together.  Moments of any number of
columns are one aggregate, exact quantiles share the narrowing passes, and the
most frequent values of all columns of one type are counted in one grouping.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import col as c_
from .quantiles import quantiles

_MOMENTS = ("n", "min", "max", "mean", "std")


@dataclass(frozen=True)
class Need:
    """Of one column: the moments, some quantiles, the most frequent value."""
    moments: bool = False
    probs: tuple[float, ...] = ()
    approximate: bool = False
    mode: bool = False


def gather(df: DataFrame, wanted: list[tuple[str, Need]]) -> list[dict]:
    """The answers to ``(column, need)`` in their order: ``n``, ``min``, ``max``,
    ``mean`` and ``std`` of the finite numbers, ``quantiles`` (one for each
    probability, None without numbers), ``mode`` (None in an empty column; of
    equally frequent values the least)."""
    found = [{} for _ in wanted]
    moments = _moments(df, list(dict.fromkeys(c for c, n in wanted if n.moments)))
    modes = _modes(df, list(dict.fromkeys(c for c, n in wanted if n.mode)))
    places: dict[bool, dict[str, dict]] = {}
    for approximate in (False, True):
        probs: dict[str, list[float]] = {}
        for c, n in wanted:
            if n.probs and n.approximate == approximate:
                probs[c] = sorted({*probs.get(c, []), *n.probs})
        told = quantiles(df, {c: cells.as_number(df, c) for c in probs}, probs, approximate) if probs else {}
        places[approximate] = {c: dict(zip(probs[c], told[c], strict=True)) for c in probs}
    for answer, (c, n) in zip(found, wanted, strict=True):
        if n.moments:
            answer |= moments[c]
        if n.probs:
            answer["quantiles"] = [places[n.approximate][c][p] for p in n.probs]
        if n.mode:
            answer["mode"] = modes.get(c)
    return found


def _moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    if not columns:
        return {}
    told = []
    for c in columns:
        x = cells.finite(cells.as_number(df, c))
        told += [F.count(x), F.min(x), F.max(x), F.avg(x), F.stddev_samp(x)]
    row = tuple(df.agg(*[t.alias(f"m{i}") for i, t in enumerate(told)]).first())
    width = len(_MOMENTS)
    return {c: dict(zip(_MOMENTS, row[i * width:(i + 1) * width], strict=True)) for i, c in enumerate(columns)}


def _modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Columns of one type are counted together, each value once for its column;
    the least of the most frequent comes from an aggregate with map-side combine."""
    alike: dict[str, list[str]] = {}
    for c in columns:
        alike.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    found: dict[str, object] = {}
    for names in alike.values():
        parts = [part for i, c in enumerate(names) for part in (F.lit(i), c_(c))]
        counted = (df.select(F.stack(F.lit(len(names)), *parts).alias("slot", "v"))
                   .filter("v is not null").groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n")))
        top = counted.groupBy("slot").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("top"))
        found |= {names[r["slot"]]: r["top"]["v"] for r in top.collect()}
    return found
