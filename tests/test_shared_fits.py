"""Fits of many steps in the passes of one, against steps fitted one by one."""

import pytest
from pyspark.sql import functions as F

from scrubline.operators import apply_step
from scrubline.operators.base import TOOLS, Change, own_column, plan_step, step
from scrubline.plans.recipe import run_recipe, together


def s(tool, col=None, **params):
    return {"tool": tool, "col": col, "params": params, "reason": ""}


@pytest.fixture(scope="module")
def wide(spark):
    """Fifty number columns, three of text and one of lists."""
    x = F.col("id")
    numbers = [((x * (i + 3) * 7919) % 1009 / (i + 1)).alias(f"c{i}") for i in range(50)]
    return spark.range(400).repartition(3).select(
        x, *numbers,
        F.when(x % 5 > 0, F.concat(F.lit("w"), (x % 7 % 4).cast("string"))).alias("word"),
        F.when(x % 3 > 0, F.concat(F.lit("v"), (x % 2).cast("string"))).alias("other"),
        F.lit(None).cast("string").alias("empty"), F.array(x).alias("listed"))


def one_by_one(df, steps):
    for t in steps:
        df = plan_step(df, t["tool"], t["col"], t["params"]).apply(df)
    return df


def same(a, b):
    assert a.columns == b.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(a) == rows(b)


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, "")
    try:
        out = work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_fifty_steps_take_the_passes_of_one(spark, wide):
    few, many = [[s("flag_outliers", f"c{i}") for i in range(n)] for n in (2, 50)]
    _, two = jobs_of(spark, "two steps", lambda: run_recipe(wide, few))
    run, fifty = jobs_of(spark, "fifty steps", lambda: run_recipe(wide, many))
    # an aggregate is one scan and two jobs
    assert 0 < fifty == two <= 12
    assert [r.status for r in run.runs] == ["ok"] * 50
    some = [f"c{i}_outlier" for i in (0, 17, 49)]
    same(run.df.select("id", *some), one_by_one(wide, [many[i] for i in (0, 17, 49)]).select("id", *some))


MIXED = [
    s("impute_missing", "word", strategy="mode"), s("impute_missing", "other", strategy="mode"),
    s("flag_outliers", "c1"), s("flag_outliers", "c2", method="zscore", threshold=1.0),
    s("impute_missing", "c3", strategy="median"), s("impute_missing", "c4", strategy="mean"),
    s("scale_numeric", "c1"), s("flag_outliers", "c1"),           # c1 is another column now
    s("encode_categories", "word"), s("impute_missing", "word", strategy="mean"),
    s("impute_missing", "c5", strategy="median", approximate=True), s("flag_outliers", "c5"),
    s("flag_outliers", "c6", action="drop"), s("scale_numeric", "c7", method="zscore"),
    s("rename_columns"), s("scale_numeric", "c8"),
]


def test_mixed_steps(wide):
    run = run_recipe(wide, MIXED)
    assert [r.status for r in run.runs] == ["ok"] * len(MIXED)
    same(run.df, one_by_one(wide, MIXED))


def test_what_can_be_fitted_together(wide):
    assert list(together(wide, MIXED, 0)) == [0, 1, 2, 3, 4, 5, 6, 10, 12]
    assert list(together(wide, MIXED, 13)) == [13]        # names change after it
    known = [None] * 4 + [{"fill": 1.0}] + [None] * 11
    assert 4 not in together(wide, MIXED, 0, known)
    upper = [s("scale_numeric", "c1"), s("flag_outliers", "C1")]
    assert list(together(wide, upper, 0)) == [0]


def test_a_step_that_fails_fails_alone(wide):
    steps = [s("flag_outliers", "c0"), s("impute_missing", "empty", strategy="mode"),
             s("scale_numeric", "word"), s("flag_outliers", "c1", method="none"),
             s("no_such"), s("flag_outliers", "c2"), s("flag_outliers", "gone"), s("scale_numeric", "c3")]
    run = run_recipe(wide, steps)
    assert [r.status for r in run.runs] == ["ok", "error", "error", "error", "skipped", "ok", "error", "ok"]
    assert "no mode" in run.runs[1].error and "no column 'gone'" in run.runs[6].error
    same(run.df, one_by_one(wide, [steps[0], steps[5], steps[7]]))


def test_a_column_no_aggregate_takes(wide):
    steps = [s("scale_numeric", "c0"), s("impute_missing", "listed", strategy="median"), s("scale_numeric", "c1")]
    run = run_recipe(wide, steps)
    assert [r.status for r in run.runs][::2] == ["ok", "ok"]
    kept = [t for t, r in zip(steps, run.runs, strict=True) if r.status == "ok"]
    same(run.df, one_by_one(wide, kept))


def test_an_own_step_ends_the_search_unless_it_says_what_it_writes(wide):
    def negate(df, col, params, fitted):
        return Change(assign={col: -F.col(col)})

    try:
        step("negate")(negate)
        steps = [s("scale_numeric", "c0"), s("negate", "c1"), s("scale_numeric", "c2")]
        assert list(together(wide, steps, 0)) == [0]
        step("negate", writes=own_column)(negate)
        assert list(together(wide, steps, 0)) == [0, 2]
    finally:
        TOOLS.pop("negate", None)


def test_no_rows(wide):
    run = run_recipe(wide.limit(0), [s("flag_outliers", "c0"), s("impute_missing", "word", strategy="mode"),
                                     s("flag_outliers", "c1", method="zscore")])
    assert [r.status for r in run.runs] == ["ok", "error", "ok"] and run.df.count() == 0


def test_chained_calls_add_up(wide):
    """Each call guards against NaN anew; the plan grows by a guard, not by a factor."""
    df = wide.select("id", "c0")
    for _ in range(20):
        df = apply_step(df, "validate_rule", "c0", {"min": 1})
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 5000
    nan = df.select(F.lit(float("nan")).alias("c0"), F.lit(float("nan")).cast("float").alias("f"))
    got = apply_step(nan, "impute_missing", "c0")
    assert got.dtypes[:2] == [("c0", "double"), ("f", "float")]
    assert got.first() == (None, None, True)
