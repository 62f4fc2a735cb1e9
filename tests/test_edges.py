"""Cells and parameters that earlier versions got wrong."""

import pytest

from conftest import values
from scrubline.functions.regex import java_pattern
from scrubline.operators import apply_step
from scrubline.plans.diff import patch_cells, rejected_edits

NAN = float("nan")


def test_nan_is_missing(column):
    df = column([1.0, NAN, 3.0], "double")
    assert values(apply_step(df, "impute_missing", "c", {"strategy": "mean"})) == [1.0, 2.0, 3.0]
    assert apply_step(df, "drop_blank_rows", "c").count() == 2
    assert apply_step(df, "drop_rows_where", "c", {"is_null": True}).count() == 2


def test_false_is_a_value(column):
    df = column([True, False, None], "boolean")
    assert values(apply_step(df, "drop_rows_where", "c", {"equals": False})) == [True, None]
    with pytest.raises(ValueError, match="no condition"):
        apply_step(df, "drop_rows_where", "c", {"is_null": False})


def test_numbers_allowed_on_text_match_nothing(column):
    df = apply_step(column(["1", "x", None]), "validate_rule", "c", {"allowed": [1, 2]})
    assert values(df, "c_invalid") == [True, True, False]


def test_patterns_java_refuses_fail_early(spark):
    with pytest.raises(ValueError):
        java_pattern(r"(?<=a+)b(")
    assert "(?<" in java_pattern(r"(?P<a_b>x)(?P=a_b)")


def test_edits_that_do_not_fit_leave_the_cell(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k long, v double")
    edits = spark.createDataFrame([(1, "v", "abc", 1), (2, "v", "9", 1), (2, "v", "10", 2)],
                                  "key long, col string, value string, n int")
    got = patch_cells(df, edits, "k", "n")
    assert sorted(map(tuple, got.collect())) == [(1, 5.0), (2, 10.0)]
    assert [r["value"] for r in rejected_edits(df, edits).collect()] == ["abc"]
    with pytest.raises(ValueError, match="unknown column"):
        patch_cells(df, edits.replace("v", "w", "col"), "k")
