"""Golden cases of the cleaning steps."""

import pytest
from conftest import values

from scrubline.operators import apply_step, plan_step
from scrubline.operators.base import count_if


def affected(df, tool, col, params=None, metric="rows_affected"):
    change = plan_step(df, tool, col, params)
    base = change.base if change.base is not None else df
    return base.agg(count_if(change.flags[metric])).first()[0]


def test_dates(column):
    df = column(["2021-03-04", "03/04/2021", "March 4, 2021", "20210304"])
    assert values(apply_step(df, "normalize_dates", "c")) == ["2021-03-04"] * 4
    assert affected(df, "normalize_dates", "c") == 3
    df = column(["03/04/2021", "2021-01-01", "garbage", None, "03/04/2021"])
    assert affected(df, "normalize_dates", "c") == 2
    assert affected(df, "normalize_dates", "c", metric="parse_failures") == 1
    assert values(apply_step(df, "normalize_dates", "c"))[2] == "garbage"


@pytest.mark.parametrize("text,want", [
    ("13/02/2021", "2021-02-13"), ("2021-02-30", "2021-02-30"), ("99/99/2021", "99/99/2021"),
    ("5", "5"), ("2021-03-04 10:00:00", "2021-03-04"), ("2021-03-04T10:00:00Z", "2021-03-04"),
    ("4 Mar 2021", "2021-03-04"), ("Sept 4 2021", "2021-09-04"), ("04-Mar-2021", "2021-03-04"),
    (" 2021/3/4 ", "2021-03-04"), ("May 4th, 2021", "2021-05-04"), ("25:61", "25:61"),
    ("01/02/21", "2021-01-02"), ("Mar 5, 21", "2021-03-05"), ("Mon 5 Jan 2021", "2021-01-05"),
    ("Thursday, 4 March 2021", "2021-03-04"), ("sat. 03/06/2021", "2021-03-06"), ("12/31/75", "2075-12-31"),
    ("12/31/76", "1976-12-31"), ("31.12.99", "1999-12-31"), ("4th-Mar-21 10:30", "2021-03-04"),
    ("1/2-21", "1/2-21"), ("Mon", "Mon"), ("Mar 21", "Mar 21"), ("sunny 5 Mar 2021", "sunny 5 Mar 2021"),
    ("13/13/21", "13/13/21")])
def test_date_spellings(column, text, want):
    assert values(apply_step(column([text]), "normalize_dates", "c")) == [want]


def test_years_of_two_digits(column):
    df = column(["01/02/21", "5 Mar 99", "2021-01-02"])
    assert values(apply_step(df, "normalize_dates", "c", {"pivot_year": None}))[:2] == ["01/02/21", "5 Mar 99"]
    assert values(apply_step(df, "normalize_dates", "c", {"pivot_year": 1999})) == [
        "1921-01-02", "1999-03-05", "2021-01-02"]
    with pytest.raises(ValueError, match="pivot_year"):
        apply_step(df, "normalize_dates", "c", {"pivot_year": "2000"})


def test_dates_dayfirst(column):
    df = column(["03/04/2021", "2021-03-04", "12/31/2021"])
    got = values(apply_step(df, "normalize_dates", "c", {"dayfirst": True}))
    assert got == ["2021-04-03", "2021-03-04", "2021-12-31"]
    assert str(values(apply_step(df, "normalize_dates", "c", {"as_date": True}))[0]) == "2021-03-04"


def test_phone(column):
    df = column(["09171234567", "+639171234567", "63-917-123-4567", "0917 123 4567", "12345"])
    assert values(apply_step(df, "normalize_phone", "c")) == ["+639171234567"] * 4 + ["12345"]
    assert affected(df, "normalize_phone", "c", metric="parse_failures") == 1


def test_currency(column):
    df = column(["₱1,200.00", "PHP 1200", "1200", None, "$5", "oops"])
    out = apply_step(df, "normalize_currency", "c", {"keep_raw": True})
    assert values(out) == [1200.0, 1200.0, 1200.0, None, 5.0, None]
    assert values(out, "c_currency") == ["PHP", "PHP", "PHP", None, "USD", None]
    assert values(out, "c_raw")[-1] == "oops"


def test_categories(column):
    df = column(["Male", "male", "MALE", "Male", "Female"])
    assert set(values(apply_step(df, "standardize_categories", "c"))) == {"Male", "Female"}
    df = column(["M", "F", "x", None])
    got = values(apply_step(df, "standardize_categories", "c",
                            {"mapping": {"M": "Male", "F": "Female"}}))
    assert got == ["Male", "Female", "x", None]


def test_dtypes(column):
    df = column(["1,234", " 5.5 ", "oops", None, "1d"])
    assert values(apply_step(df, "fix_dtypes", "c")) == [1234.0, 5.5, None, None, None]
    assert affected(df, "fix_dtypes", "c", metric="coercion_failures") == 2
    df = column(["true", "FALSE", "yes", "no", None])
    assert values(apply_step(df, "fix_dtypes", "c", {"target": "bool", "as_int": True})) == [
        1, 0, 1, 0, None]
    with pytest.raises(ValueError):
        apply_step(df, "fix_dtypes", "c", {"target": "date"})


def test_impute(column):
    df = column([1.0, None, 3.0], "double")
    out = apply_step(df, "impute_missing", "c")
    assert values(out) == [1.0, None, 3.0] and values(out, "c_missing") == [False, True, False]
    assert values(apply_step(df, "impute_missing", "c", {"strategy": "median"})) == [1, 2, 3]
    whole = column([1, None, 2], "int")
    assert values(apply_step(whole, "impute_missing", "c", {"strategy": "mean"})) == [1, 1.5, 2]
    ties = column(["b", "a", "b", "a", None])
    assert values(apply_step(ties, "impute_missing", "c", {"strategy": "mode"}))[-1] == "a"
    with pytest.raises(ValueError):
        apply_step(column(["x"]), "impute_missing", "c", {"strategy": "mean"})
    with pytest.raises(ValueError):
        apply_step(df, "impute_missing", "c", {"strategy": "constant"})


def test_outliers(column):
    df = column([10, 11, 12, 10, 11, 9000], "int")
    assert values(apply_step(df, "flag_outliers", "c"), "c_outlier") == [False] * 5 + [True]
    out = apply_step(df, "flag_outliers", "c", {"action": "drop"})
    assert out.columns == ["i", "c"] and out.count() == 5
    flat = column([5.0] * 4, "double")
    z = apply_step(flat, "flag_outliers", "c", {"method": "zscore"})
    assert values(z, "c_outlier") == [False] * 4
    infinite = column([1.0, 2.0, float("inf"), 3.0], "double")
    assert not any(values(apply_step(infinite, "flag_outliers", "c"), "c_outlier"))


def test_trim(column):
    df = column(["  a  b ", "José", "x  y", None])
    assert values(apply_step(df, "trim_whitespace", "c")) == ["a b", "José", "x y", None]
    assert affected(df, "trim_whitespace", "c") == 3


def test_validate_rule(column):
    df = column(["30", "150", "-2", None, "n/a"])
    got = values(apply_step(df, "validate_rule", "c", {"min": 0, "max": 120}), "c_invalid")
    assert got == [False, True, True, False, False]


def test_rename(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`First Name` int, orderID int, ok_col int, `A b` int")
    df = df.withColumnRenamed("ok_col", "a_b")
    assert apply_step(df, "rename_columns").columns == ["first_name", "order_id", "a_b", "a_b_2"]


def test_blank_rows_and_columns(spark):
    df = spark.createDataFrame(
        [(0, "x", None), (None, "  ", None), (3, "y", None), (None, None, "   ")],
        "a int, b string, empty string")
    assert sorted(r.a for r in apply_step(df, "drop_blank_rows").collect()) == [0, 3]
    assert apply_step(df, "drop_blank_columns").columns == ["a", "b"]
    with pytest.raises(ValueError):
        apply_step(df, "drop_blank_columns", params={"columns": ["nope"]})


def test_replace(column):
    df = column(["N/A", "n/a", "id-7", "banana", None])
    run = lambda **p: values(apply_step(df, "replace_values", "c", p))
    assert run(find="N/A", replace="")[:2] == ["", "n/a"]
    assert run(find="N/A", replace="?", match_case=False)[:2] == ["?", "?"]
    assert run(find="^id-", regex=True)[2] == "7"
    assert run(find="a", replace="b", contains=True)[3] == "bbnbnb"
    assert run(find="(?P<x>ban)", replace=r"\g<x>$", regex=True)[3] == "ban$ana"
    with pytest.raises(ValueError):
        run(replace="x")
    with pytest.raises(ValueError):
        run(find="(", regex=True)


def test_encode(column):
    df = column(["Sales", "HR", "Sales", "IT", None])
    assert values(apply_step(df, "encode_categories", "c")) == [3, 1, 3, 2, None]
    out = apply_step(df, "encode_categories", "c", {"new_column": True, "start": 0})
    assert values(out, "c_code") == [2, 0, 2, 1, None]
    got = apply_step(df, "encode_categories", "c", {"order": "frequency"})
    assert values(got)[0] == 1
    got = apply_step(df, "encode_categories", "c", {"order": "appearance", "order_by": "i"})
    assert values(got) == [1, 2, 1, 3, None]
    assert values(apply_step(column(["10", "9"]), "encode_categories", "c")) == [1, 2]


def test_drop_rows_where(column):
    df = column(["a", "A", "ab", None, "7"])
    run = lambda **p: values(apply_step(df, "drop_rows_where", "c", p))
    assert run(equals="a") == ["A", "ab", None, "7"]
    assert run(equals="a", match_case=False) == ["ab", None, "7"]
    assert run(contains="a", keep=True) == ["a", "ab"]
    assert run(is_null=True) == ["a", "A", "ab", "7"]
    assert run(regex=r"^\d+$") == ["a", "A", "ab", None]
    assert run(max=5) == ["a", "A", "ab", None]
    with pytest.raises(ValueError):
        run()


def test_scale_and_round(column):
    df = column([10.0, 20.0, 30.0, None], "double")
    assert values(apply_step(df, "scale_numeric", "c")) == [0, 0.5, 1, None]
    z = values(apply_step(df, "scale_numeric", "c", {"method": "zscore"}))
    assert z == [-1.0, 0.0, 1.0, None]
    with pytest.raises(ValueError):
        apply_step(column([1.0, 1.0], "double"), "scale_numeric", "c")
    text = column(["1.239", "2.5", "n/a", None, "12345678.16"])
    assert values(apply_step(text, "round_numbers", "c", {"decimals": 1})) == [
        "1.2", "2.5", "n/a", None, "12345678.2"]
    with pytest.raises(ValueError):
        apply_step(column(["x"]), "round_numbers", "c")


@pytest.mark.parametrize("text", [
    "ana CRUZ", "o'neil mary-jane 3rd", "ßtraße", "élan vital", "x", "", "1st 2nd", "a.b.c"])
def test_casing_agrees_with_python(column, text):
    df = column([text])
    assert values(apply_step(df, "format_text", "c", {"case": "title"})) == [text.title()]
    assert values(apply_step(df, "format_text", "c", {"case": "upper"})) == [text.upper()]
    sentence = text[:1].upper() + text[1:].lower()
    assert values(apply_step(df, "format_text", "c", {"case": "sentence"})) == [sentence]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x", 3), (1, "x", 3), (2, "y", 1), (2, "y", 0)],
                               "a int, b string, t int")
    assert apply_step(df, "drop_duplicates").count() == 3
    kept = apply_step(df, "drop_duplicates", params={"subset": ["a"], "order_by": ["t"]})
    assert sorted((r.a, r.t) for r in kept.collect()) == [(1, 3), (2, 0)]


def test_unknown_tool_and_column(column):
    with pytest.raises(ValueError):
        apply_step(column(["x"]), "no_such_tool", "c")
    with pytest.raises(ValueError):
        apply_step(column(["x"]), "trim_whitespace", "nope")
