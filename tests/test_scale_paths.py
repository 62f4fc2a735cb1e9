"""The ways taken for data that does not fit one task or the driver."""

import random

import numpy as np
import pytest
from conftest import SF, values
from pyspark.sql import functions as F

from scrubline.catalog.views import view
from scrubline.operators import apply_step, categories, lookup
from scrubline.operators.quantiles import exact_quantiles
from scrubline.plans.recipe import run_recipe


def skewed(kind):
    rng = np.random.default_rng(3)
    return {
        "smooth": rng.normal(size=4000),
        "hot": np.concatenate([rng.normal(size=2000), np.full(2000, 0.25)]),
        "constant": np.full(3000, 7.0),
        "heavy": np.concatenate([rng.normal(size=3000), rng.normal(size=900) * 1e9]),
        "few": rng.integers(0, 4, size=4000).astype(float),
    }[kind]


@pytest.mark.parametrize("kind", ["smooth", "hot", "constant", "heavy", "few"])
def test_narrowing_is_exact(spark, monkeypatch, kind):
    from scrubline.operators import quantiles
    monkeypatch.setattr(quantiles, "ACCURACY", 50)  # coarse sketches, several rounds
    v = skewed(kind)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = exact_quantiles(df, {"v": F.col("v")}, probs, small=50)["v"]
    assert np.allclose(got, np.quantile(v, probs), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("inf"),)], "v double")
    assert exact_quantiles(df, {"v": F.col("v")}, [0.5]) == {"v": [None]}


@pytest.fixture
def tiny_limits(monkeypatch):
    monkeypatch.setattr(lookup, "MAX_ROWS", 5)
    monkeypatch.setattr(lookup, "IN_PLAN", 2)


def words(n=400):
    rng = random.Random(5)
    forms = [str.upper, str.lower, str.title, lambda s: f" {s}"]
    return [None if i % 9 == 0 else "hot" if i % 3 == 0 else
            rng.choice(forms)(f"word {rng.randint(0, 40)}") for i in range(n)]


def test_large_mapping_equals_small(column, monkeypatch):
    df = column(words())
    small = values(apply_step(df, "standardize_categories", "c"))
    monkeypatch.setattr(lookup, "IN_PLAN", 2)
    assert values(apply_step(df, "standardize_categories", "c")) == small
    monkeypatch.setattr(lookup, "MAX_ROWS", 5)
    assert values(apply_step(df, "standardize_categories", "c")) == small


@pytest.mark.parametrize("order", ["sorted", "frequency", "appearance"])
def test_large_codes_equal_small(column, monkeypatch, order):
    df, params = column(words()), {"order": order, "order_by": "i", "start": 3}
    small = values(apply_step(df, "encode_categories", "c", params))
    monkeypatch.setattr(lookup, "MAX_ROWS", 5)
    assert values(apply_step(df, "encode_categories", "c", params)) == small


def test_audit_of_a_large_mapping_equals_a_small(column, monkeypatch):
    df = column(words())
    steps = [{"tool": "standardize_categories", "col": "c"},
             {"tool": "encode_categories", "col": "c", "params": {"order": "appearance", "order_by": "i"}}]
    found = []
    for most in (10_000, 5):
        monkeypatch.setattr(lookup, "MAX_ROWS", most)
        one, two = (r["stats"] for r in run_recipe(df, steps).audit().collect())
        mapping = df.sparkSession.read.parquet(two.pop("mapping_table"))
        found.append((one, two, sorted(mapping.collect())))
    assert found[0] == found[1] and int(found[0][1]["n_categories"]) == len(found[0][2])


def test_categories_never_ordered_come_last(spark, monkeypatch):
    df = spark.createDataFrame([("a", None), ("b", 2), ("c", 1), ("b", None), (None, 0)], "c string, i int")
    for most in (10_000, 1):
        monkeypatch.setattr(lookup, "MAX_ROWS", most)
        codes = categories.category_codes(df, "c", "appearance", 1, "i")
        assert {r["k"]: r["v"] for r in codes.table.collect()} == {"c": 1, "b": 2, "a": 3}
    none = categories.category_codes(df.limit(0), "c")
    assert none.size == 0 and categories.mapping_path(none)


def test_decode_of_a_large_mapping(column, tiny_limits):
    df = column(words())
    codes = categories.category_codes(df, "c")
    assert not codes.small
    coded = apply_step(df, "encode_categories", "c", {"new_column": True},
                       fitted={"lookup": codes})
    back = categories.decode_categories(coded, "c_code", codes, "back")
    assert back.filter(~F.col("c").eqNullSafe(F.col("back"))).count() == 0


def test_long_texts_are_grouped_by_digest(spark):
    from scrubline.plans.profile import profile
    long = "lorem " * 100
    df = spark.createDataFrame([(long,), (long,), (long.upper(),), ("x",)], "t string")
    rows = {(r.signal, r.detail): r for r in profile(df).collect()}
    assert rows["n_unique", None].value == 3
    assert rows["casing_folded", None].value == 2
    assert rows["top_value", "1"].value == 2 and rows["top_value", "1"].text == long
    assert rows["duplicate_rows", None].value == 1


COLUMN_STEPS = [
    ("trim_whitespace", "priority", {}), ("normalize_dates", "order_date", {}),
    ("normalize_phone", "phone", {}), ("normalize_currency", "total", {}),
    ("standardize_categories", "priority", {}), ("fix_dtypes", "qty_text", {}),
    ("impute_missing", "active", {}), ("flag_outliers", "order_id", {})]


@pytest.mark.parametrize("tool,col,params", COLUMN_STEPS)
def test_steps_keep_rows_and_ignore_partitioning(spark, tool, col, params):
    df = view(spark, SF, "dirty_orders")
    one = apply_step(df.coalesce(1), tool, col, params)
    many = apply_step(df.repartition(7), tool, col, params)
    assert one.count() == df.count()
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


@pytest.mark.parametrize("tool,col", [
    ("trim_whitespace", "priority"), ("normalize_dates", "order_date"),
    ("normalize_phone", "phone"), ("standardize_categories", "priority"),
    ("drop_blank_rows", None), ("drop_duplicates", None)])
def test_steps_are_idempotent(spark, tool, col):
    once = apply_step(view(spark, SF, "dirty_orders"), tool, col)
    twice = apply_step(once, tool, col)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans(spark):
    """Column steps need no shuffle, and scans read only what is used."""
    df = view(spark, SF, "dirty_orders")
    for tool, col, params in COLUMN_STEPS:
        assert "Exchange hash" not in plan_of(apply_step(df, tool, col, params)), tool
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    flagged = apply_step(lines, "flag_outliers", "l_tax").select("l_tax_outlier")
    assert "ReadSchema: struct<l_tax:double>" in plan_of(flagged)
    first = apply_step(df, "drop_duplicates", params={"subset": ["phone"],
                                                      "order_by": ["order_id"]})
    assert "WindowGroupLimit" in plan_of(first)
