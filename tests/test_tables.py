"""Profile, issues, suggestions, verdicts, contracts, differences."""

import json

import pytest
from pyspark.sql import functions as F

from scrubline.operators.rows import row_loss
from scrubline.plans import columnstats, diff, suggest
from scrubline.plans.contract import check_contract, contract_summary, load_contract, validate
from scrubline.plans.profile import as_dict, profile
from scrubline.plans.recipe import run_recipe
from scrubline.plans.suggest import collect_steps, issue_list, suggest_steps
from scrubline.plans.verify import (follow_up_steps, targeted_verdicts, verify_profiles)
from scrubline.session import write_text


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(
        [("2021-01-01", "₱1,200.00", "Male", 30), ("03/04/2021", "PHP 500", "male", 31),
         ("2021-01-05", "₱99.00", "MALE", 29), ("2021-02-01", "₱1.00", "Female", 32),
         ("2021-02-02", "PHP 2", "female", 30), ("2021-02-03", "₱3.00", "Male", 3000)],
        "`Order Date` string, amount string, sex string, age int")


def test_profile(messy):
    p = as_dict(profile(messy))
    json.dumps(p)
    assert p["n_rows"] == 6 and p["columns"]["Order Date"]["bad_name"]
    assert p["columns"]["Order Date"]["date_formats"] == {
        "ISO (YYYY-MM-DD)": 5, "US (MM/DD/YYYY)": 1}
    assert p["columns"]["amount"]["currency_like"] == 6
    assert p["columns"]["sex"]["casing_folded"] == 2
    assert p["columns"]["age"]["iqr_outliers"] == 1


def test_profile_of_little(spark):
    empty = as_dict(profile(spark.createDataFrame([], "a int, b string")))
    assert empty["n_rows"] == 0 and empty["columns"]["b"]["null_pct"] == 0
    nulls = as_dict(profile(spark.createDataFrame([(None, None)], "a int, b string")))
    assert nulls["columns"]["b"]["blank_column"] == 1 and nulls["blank_rows"] == 1
    nan = as_dict(profile(spark.createDataFrame([(float("nan"),), (1.0,)], "x double")))
    assert nan["columns"]["x"]["null_pct"] == 50


def test_profile_keeps_secrets(spark):
    secrets = ["juandc@gmail.com", "09171234567", "Juan Dela Cruz", "1234567890"]
    df = spark.createDataFrame([(s, s) for s in secrets], "note string, contact string")
    shown = json.dumps(as_dict(profile(df)), ensure_ascii=False)
    assert not [s for s in secrets if s in shown]


def test_other_types_pass_through(spark):
    df = spark.sql("select map('a', 1) as m, array(1) as a, timestamp'2024-01-01' as t, 'x' as s")
    p = as_dict(profile(df.drop("m")))
    assert p["columns"]["a"]["null_pct"] == 0 and p["columns"]["t"]["n_unique"] == 1


def test_steps_in_order(messy):
    steps = collect_steps(suggest_steps(profile(messy)))
    assert [(s["tool"], s["col"]) for s in steps] == [
        ("rename_columns", None), ("normalize_dates", "order_date"),
        ("normalize_currency", "amount"), ("standardize_categories", "sex"),
        ("flag_outliers", "age")]
    assert {r.issue for r in issue_list(profile(messy)).collect()} == {
        "mixed date formats", "currency strings", "category casing variants",
        "statistical outliers"}


def test_verdicts_and_follow_up(spark):
    dirty = spark.createDataFrame(
        [(d, x) for d, x in zip(["03/04/2021", "2021-01-01", "March 4, 2021"] * 4,
                                [1.0, None, 3.0, 4.0] * 3)], "d string, x double")
    before = profile(dirty)
    steps = collect_steps(suggest_steps(before))
    after = profile(run_recipe(dirty, steps).df)
    verdicts = verify_profiles(before, after)
    found = {(r.issue, r.col): r.verdict for r in verdicts.collect()}
    assert found["mixed_date_formats", "d"] == "resolved" and found["nulls", "x"] == "flagged"
    # Rows that became equal by cleaning are reported and followed up.
    assert found["duplicates", None] == "new_issue"
    assert [s["tool"] for s in collect_steps(follow_up_steps(verdicts, after))] == [
        "drop_duplicates"]
    nothing = verify_profiles(before, before)
    again = collect_steps(follow_up_steps(nothing, before))
    assert "normalize_dates" in [s["tool"] for s in again]
    aimed = targeted_verdicts(verdicts, [s for s in steps if s["tool"] == "normalize_dates"])
    assert {r.issue for r in aimed.collect()} == {"mixed_date_formats", "duplicates"}


def test_contract(spark):
    rules = check_contract({
        "columns": {"age": {"min": 0, "max": 120, "not_null": True},
                    "seg": {"allowed": ["A", "B"]}, "id": {"unique": True, "required": True}},
        "table": {"min_rows": 2, "no_duplicate_rows": True}})
    good = spark.createDataFrame([(30, "A", 1), (40, "B", 2)], "age int, seg string, id int")
    assert contract_summary(validate(good, rules)).first().passed
    bad = spark.createDataFrame([(30, "A", 1), (999, "C", 1), (None, "A", 2)],
                                "age int, seg string, id int")
    failed = {(r.rule, r.col) for r in validate(bad, rules).filter("not passed").collect()}
    assert failed == {("range", "age"), ("not_null", "age"), ("allowed", "seg"),
                      ("unique", "id")}
    text = spark.createDataFrame([("x",), ("5",)], "age string")
    assert validate(text, {"columns": {"age": {"min": 1}}}).first().violations == 1
    with pytest.raises(ValueError):
        check_contract({"columns": {"a": {"explode": True}}})


def test_contract_file(spark, tmp_path):
    path = f"file:{tmp_path}/c.json"
    write_text(spark, path, '{"columns": {"ghost": {"not_null": true}}}')
    row = validate(spark.range(1), load_contract(spark, path)).first()
    assert (row.rule, row.col, row.passed) == ("column_exists", "ghost", False)


def test_differences(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)],
                                   "k int, t string, x double")
    after = spark.createDataFrame([(1, "a", "1.0", 5), (2, "B", "7.5", 5)],
                                  "k int, t string, x string, n int")
    cells = {(r.key, r.col): (r.before, r.after)
             for r in diff.diff_cells(before, after, "k").collect()}
    assert cells == {("2", "t"): ("b", "B"), ("2", "x"): (None, "7.5")}
    assert [r.key for r in diff.removed_rows(before, after, "k").collect()] == [3]
    assert diff.new_columns(before, after) == ["n"]


def test_repeated_keys_make_no_pairs(spark):
    before = spark.createDataFrame([(1, "a")] * 50 + [(None, "z")] * 50, "k int, t string")
    after = spark.createDataFrame([(1, "b")] * 50 + [(None, "y")] * 50, "k int, t string")
    assert diff.diff_cells(before, after, "k").count() == 1


def test_patches(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, t string, n int")
    edits = spark.createDataFrame([(1, "t", "A"), (2, "t", ""), (2, "n", "9"), (7, "t", "?")],
                                  "key int, col string, value string")
    assert sorted(map(tuple, diff.patch_cells(df, edits, "k").collect())) == [
        (1, "A", 1), (2, None, 9)]
    left = diff.delete_rows(df, spark.createDataFrame([(2,), (2,)], "key int"), "k")
    assert [r.k for r in left.collect()] == [1]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "x double")
    assert [r.n for r in columnstats.column_histogram(df, "x").orderBy("bin").collect()] == [10] * 10
    flat = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert sum(r.n for r in columnstats.column_histogram(flat, "x").collect()) == 2


def test_row_loss():
    assert row_loss(10, 9) is None and "5 of 10" in row_loss(10, 5)
    with pytest.raises(ValueError):
        row_loss(10, 0)


def test_snake_expression_equals_function(spark):
    from scrubline.functions.text import snake_case
    from scrubline.plans.verify import snake
    names = ["First Name", "orderID", "ok_col", "__a--B c", "ÀBc De", "x1Y", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(snake(F.col("n"))).collect()] == [
        snake_case(n) for n in names]
    assert suggest.VALUES


def test_names_differ_without_case():
    from scrubline.functions.text import distinct_names

    assert distinct_names(["id", "ID", "Id_2"]) == ["id", "ID_3", "Id_2"]
