"""Recipes stored with what they learned, to be replayed without a fit.

A folder holds ``fits.json``, the steps that worked and their constants, and the
mappings of steps that have one as Parquet tables, named relative to the folder,
so that it can be moved.  The tables are written first and the file last: a
reader sees a whole store or the one before it.
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid

from pyspark.sql import SparkSession

from ..operators.lookup import Lookup, build
from ..session import read_text, write_text
from .recipe import RecipeRun, check_steps

VERSION = 1
_TYPES = {"date": datetime.date, "timestamp": datetime.datetime, "decimal": decimal.Decimal}


def save_fits(spark: SparkSession, run: RecipeRun, folder: str) -> str:
    """Store the steps of ``run`` that worked, with their fits.  Failed and
    skipped steps are left out: a replay does what the run did."""
    folder = folder.rstrip("/")
    stored = []
    for r in run.runs:
        if r.status == "ok":
            fits = {}
            for name, value in r.fitted.items():
                if isinstance(value, Lookup):
                    where = f"mappings/{uuid.uuid4().hex}"
                    value.table.select("k", "v", "n").write.parquet(f"{folder}/{where}")
                    fits[name] = {"mapping": where}
                else:
                    fits[name] = _packed(value)
            stored.append({"step": {**r.step, "col": r.col}, "fits": fits})
    write_text(spark, f"{folder}/fits.json",
               json.dumps({"fits": VERSION, "steps": stored}, indent=2, ensure_ascii=False))
    return folder


def load_fits(spark: SparkSession, folder: str) -> tuple[list[dict], list[dict]]:
    """``(steps, fitted)`` for ``run_recipe(df, steps, fitted)``."""
    folder = folder.rstrip("/")
    data = json.loads(read_text(spark, f"{folder}/fits.json"))
    if data.get("fits") != VERSION:
        raise ValueError(f"{folder}: fits of version {data.get('fits')}, known is {VERSION}")
    steps = check_steps([s["step"] for s in data["steps"]], allow=True)
    return steps, [{n: _read(spark, folder, v) for n, v in s["fits"].items()} for s in data["steps"]]


def _packed(value):
    """JSON has no dates and no decimals; those carry their type."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, list):
        return [_packed(v) for v in value]
    for name in ("timestamp", "date", "decimal"):  # a timestamp is a date, too
        if isinstance(value, _TYPES[name]):
            return {name: str(value) if name == "decimal" else value.isoformat()}
    raise ValueError(f"a fit of type {type(value).__name__} cannot be stored")


def _read(spark: SparkSession, folder: str, value):
    if isinstance(value, list):
        return [_read(spark, folder, v) for v in value]
    if not isinstance(value, dict):
        return value
    (name, inner), = value.items()
    if name == "mapping":
        return build(spark.read.parquet(f"{folder}/{inner}"), written=True)
    return decimal.Decimal(inner) if name == "decimal" else _TYPES[name].fromisoformat(inner)
