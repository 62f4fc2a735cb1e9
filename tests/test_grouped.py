"""Many tables in one against the same tables one by one."""

import pytest
from pyspark.sql import functions as F

from scrubline.catalog.views import view
from scrubline.operators.quantiles import exact_quantiles
from scrubline.plans.contract import validate
from scrubline.plans.grouped import run_recipe_by
from scrubline.plans.profile import profile, profile_by
from scrubline.plans.recipe import audit_by, run_recipe
from scrubline.plans.verify import verify_by, verify_profiles
from scrubline.session import Workspace

SF = "/root/testdata/sf0.001"
BY = "__table"


def step(tool, col=None, **params):
    return {"tool": tool, "col": col, "params": params, "reason": ""}


@pytest.fixture(scope="module")
def tables(spark):
    """Four tables of one shape: plain, with a blank column, with one number, without rows."""
    df = view(spark, SF, "dirty_orders").cache()
    key = df.columns[0]
    return {"a": df.where(F.col(key) % 3 == 0), "b é.csv": df.where(F.col(key) % 3 == 1).withColumn(
        "active", F.lit(None).cast("string")), "none": df.limit(0)}


@pytest.fixture(scope="module")
def together(tables):
    out = None
    for name, df in tables.items():
        df = df.withColumn(BY, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def told(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_quantiles_by_group(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"),
        F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 1009 / 7)).alias("x"),
        (F.col("id") % 4).alias("y"))
    columns, probs = {"x": F.col("x"), "y": F.col("y")}, [0.25, 0.5, 0.9]
    for small in (20, 50_000):
        got = exact_quantiles(df, columns, probs, small, by="g")
        for g in ("g0", "g1", "g2"):
            assert got[g] == exact_quantiles(df.where(F.col("g") == g), columns, probs)


def test_many_columns_are_sorted_by_many_tasks(spark):
    wide = spark.range(200).select(*[(F.col("id") * (i + 3) % 211).alias(f"c{i}") for i in range(500)])
    got = exact_quantiles(wide, {c: F.col(c) for c in wide.columns}, [0.5])
    want = wide.agg(*[F.expr(f"percentile({c}, 0.5)").alias(c) for c in wide.columns]).first().asDict()
    assert {c: v[0] for c, v in got.items()} == want


def test_profiles(tables, together):
    got = profile_by(together, BY, list(tables)).collect()
    for name, df in tables.items():
        assert told(tuple(r)[1:] for r in got if r["group"] == name) == told(profile(df).collect())


STEPS = [step("drop_blank_rows"), step("drop_blank_columns"), step("drop_duplicates"),
         step("trim_whitespace", "priority"), step("standardize_categories", "priority"),
         step("normalize_dates", "order_date"), step("normalize_currency", "total"),
         step("impute_missing", "total", strategy="median"), step("flag_outliers", "total"),
         step("flag_outliers", "total", method="zscore", threshold=2.0), step("scale_numeric", "total"),
         step("encode_categories", "priority", order="frequency", new_column=True),
         step("impute_missing", "active", strategy="mode"), step("round_numbers", "phone"),
         step("rename_columns"), step("drop_rows_where", "priority", equals="HIGH"), step("no_such_tool")]


def test_recipes_audits_and_verdicts(spark, tables, together):
    tables = {g: df for g, df in tables.items() if g != "none"}  # a table without rows loses all its columns
    together = together.where(F.col(BY) != "none")
    with Workspace(spark):
        branches = run_recipe_by(together, BY, list(tables), STEPS)
        assert sorted(g for b in branches for g in b.groups) == sorted(tables)
        assert len(branches) <= 3
        for branch in branches:
            audits = audit_by(branch.runs, BY, branch.groups, spark).collect()
            after = profile_by(branch.df, BY, branch.groups)
            verdicts = verify_by(profile_by(together, BY, list(tables)), after, branch.groups).collect()
            for g in branch.groups:
                alone = run_recipe(tables[g], STEPS)
                mine = branch.df.where(F.col(BY) == g).drop(BY)
                assert dict(mine.dtypes) == dict(alone.df.dtypes)
                names = sorted(mine.columns)
                rows = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*names).collect()]
                        for d in (mine, alone.df)]
                assert told(rows[0]) == told(rows[1]), g
                keep = ("step", "tool", "col", "status", "rows_affected")
                assert [[r[k] for k in keep] for r in audits if r["group"] == g] == [
                    [r[k] for k in keep] for r in alone.audit().orderBy("step").collect()], g
                want = verify_profiles(profile(tables[g]), profile(alone.df)).collect()
                assert told(tuple(r)[1:] for r in verdicts if r["group"] == g) == told(want), g


def test_contracts(tables, together):
    contract = {"columns": {"priority": {"not_null": True, "allowed": ["HIGH", "LOW"]}, "total": {"regex": r"\d+"},
                            "phone": {"unique": True, "min": 3}, "gone": {}}, "table": {"min_rows": 10, "no_duplicate_rows": True}}
    got = validate(together, contract, BY, list(tables)).collect()
    for name, df in tables.items():
        assert told(tuple(r)[1:] for r in got if r["group"] == name) == told(validate(df, contract).collect())
