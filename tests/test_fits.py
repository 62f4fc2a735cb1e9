"""Recipes stored with their fits: replayed elsewhere, nothing is fitted again."""

import dataclasses
import datetime
import decimal
import os

import pytest
from pyspark.sql import functions as F

from scrubline.operators import lookup
from scrubline.operators.base import TOOLS
from scrubline.plans.fits import load_fits, save_fits
from scrubline.plans.recipe import run_recipe


def s(tool, col=None, **params):
    return {"tool": tool, "col": col, "params": params, "reason": ""}


STEPS = [
    s("drop_blank_columns"), s("standardize_categories", "word"), s("encode_categories", "word"),
    s("encode_categories", "name", new_column=True), s("impute_missing", "day", strategy="mode"),
    s("impute_missing", "price", strategy="mode"), s("impute_missing", "at", strategy="mode"),
    s("impute_missing", "x", strategy="median"), s("flag_outliers", "x"), s("scale_numeric", "x"),
    s("impute_missing", "gone", strategy="mean"), s("no_such"),
]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def train(spark):
    i = F.col("id")
    return spark.range(60).select(
        "id", F.when(i % 2 == 0, "Red").when(i % 3 == 0, "red ").otherwise("blue").alias("word"),
        F.concat(F.lit("é"), (i % 9).cast("string")).alias("name"), F.lit(None).cast("string").alias("blank"),
        F.when(i % 4 > 0, F.lit(datetime.date(2021, 3, 4))).alias("day"),
        F.when(i % 4 > 0, F.lit(decimal.Decimal("1.10"))).alias("price"),
        F.when(i % 4 > 0, F.lit(datetime.datetime(2021, 3, 4, 5, 6, 7, 89))).alias("at"),
        F.when(i % 5 > 0, i / 7).alias("x"))


@pytest.fixture
def no_fit(monkeypatch):
    def fail(*_):
        raise AssertionError("fitted again")

    def stop():
        for name, tool in list(TOOLS.items()):
            if tool.fit:
                monkeypatch.setitem(TOOLS, name, dataclasses.replace(tool, fit=fail, answer=fail))
    return stop


@pytest.mark.parametrize("large", [False, True])
def test_replay_in_another_session(spark, train, tmp_path, monkeypatch, no_fit, large):
    if large:
        monkeypatch.setattr(lookup, "MAX_ROWS", 1)
        monkeypatch.setattr(lookup, "IN_PLAN", 1)
    run = run_recipe(train, STEPS)
    assert [r.status for r in run.runs[-2:]] == ["error", "skipped"]
    save_fits(spark, run, f"file:{tmp_path}/one/")
    later = train.where("id < 20")
    no_fit()
    want = rows(run_recipe(later, STEPS[:-2], run.fitted[:-2]).df)
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    steps, fitted = load_fits(other, f"file:{tmp_path}/one")
    assert [t["tool"] for t in steps] == [t["tool"] for t in STEPS[:-2]]
    again = run_recipe(later, steps, fitted)
    assert [r.status for r in again.runs] == ["ok"] * len(steps)
    assert rows(again.df) == want


def test_the_folder_can_be_moved_and_written_again(spark, train, tmp_path):
    run = run_recipe(train, STEPS[:3])
    folder = f"{tmp_path}/a"
    save_fits(spark, run, folder)
    save_fits(spark, run, folder)
    os.rename(folder, f"{tmp_path}/b")
    steps, fitted = load_fits(spark, f"{tmp_path}/b")
    assert rows(run_recipe(train, steps, fitted).df) == rows(run.df)


def test_unknown_version(spark, tmp_path):
    (tmp_path / "fits.json").write_text('{"fits": 99, "steps": []}')
    with pytest.raises(ValueError, match="version 99"):
        load_fits(spark, str(tmp_path))
