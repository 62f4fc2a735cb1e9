"""Declarative expectations and the violations a table has against them.

    {"columns": {"l_discount": {"min": 0, "max": 0.1, "not_null": true},
                 "l_comment": {"regex": "[a-z ]+", "required": false}},
     "table": {"min_rows": 1000}}
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import col as c_
from ..functions.regex import java_pattern
from ..operators.base import count_if
from ..operators.missing import outside
from ..session import read_text, small_table
from .profile import duplicate_rows, repeated_by

# --- fixed values -----------------------------------------------------------
RULES = {"min", "max", "allowed", "not_null", "unique", "regex", "required"}
# --- end of fixed values ----------------------------------------------------


def check_contract(contract: dict) -> dict:
    if not isinstance(contract, dict) or "columns" not in contract:
        raise ValueError("a contract is a mapping with 'columns'")
    for col, rules in contract["columns"].items():
        if unknown := sorted(set(rules) - RULES):
            raise ValueError(f"no such rules on '{col}': {unknown}")
        if "regex" in rules:
            java_pattern(rules["regex"])
    return contract


def load_contract(spark: SparkSession, path: str) -> dict:
    """A contract from a JSON (or, with PyYAML at hand, YAML) file that any
    file system of the session can hold."""
    text = read_text(spark, path)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise ValueError("YAML contracts need PyYAML; use JSON") from exc
        return check_contract(yaml.safe_load(text))
    return check_contract(json.loads(text))


def range_violation(df: DataFrame, col: str, rules: dict) -> Column:
    """Outside the range, or present without being a number."""
    number = cells.as_number(df, col)
    return (outside(number, rules.get("min"), rules.get("max"))
            | (c_(col).isNotNull() & number.isNull()))


def allowed_violation(df: DataFrame, col: str, rules: dict) -> Column:
    return c_(col).isNotNull() & ~cells.is_one_of(df, col, list(rules["allowed"]))


def regex_violation(df: DataFrame, col: str, rules: dict) -> Column:
    """The pattern must match from the start of the cell."""
    pattern = "^(?:" + java_pattern(rules["regex"]) + ")"
    return ~cells.as_text(df, col).rlike(pattern)


def repeated_values(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """``n``: cells beyond the first of each value, nulls being equal."""
    key = cells.group_key(c_(col)) if cells.kind(df, col) == "text" else c_(col)
    if by is not None:
        return (df.groupBy(c_(by).alias("group"), key.alias("k")).agg(F.count(F.lit(1)).alias("m"))
                .groupBy("group").agg(F.sum(F.col("m") - 1).alias("n")))
    return (df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("m"))
            .agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n")))


def validate(df: DataFrame, contract: dict, by: str | None = None,
             groups: list[str] | None = None) -> DataFrame:
    """``(rule, col, violations, passed, detail)``, one row per rule.

    All row-wise rules are one aggregate; each ``unique`` rule and the
    duplicate test add a group-by of their own.  With ``by`` every table that it
    tells apart is tested in the same passes, and ``group`` comes first; ``groups``
    names the tables, those without rows too.
    """
    check_contract(contract)
    df = cells.nan_to_null(df)
    table = contract.get("table") or {}
    counts: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    singles: list[DataFrame] = []
    rules: list[tuple[str, str | None, Column, Column]] = []

    def rule(name: str, col: str | None, count: Column, detail: Column | str = "") -> None:
        detail = F.lit(detail) if isinstance(detail, str) else detail
        rules.append((name, col, count, detail))

    def rows(condition: Column) -> Column:
        name = f"c{len(counts)}"
        counts.append(count_if(condition).alias(name))
        return F.col(name)

    def single(one_row: DataFrame) -> Column:
        singles.append(one_row)
        return F.col(f"s{len(singles) - 1}")

    if "min_rows" in table:
        need = int(table["min_rows"])
        rule("min_rows", None, (F.col("n_rows") < need).cast("bigint"),
             F.concat(F.col("n_rows").cast("string"), F.lit(f" rows, need >= {need}")))
    if table.get("no_duplicate_rows"):
        rule("no_duplicate_rows", None, single(duplicate_rows(df) if by is None else _repeated_rows(df, by)))
    for col, r in contract["columns"].items():
        if col not in df.columns or col == by:
            if r.get("required", True):
                rule("column_exists", col, F.lit(1), "column is missing")
            continue
        if r.get("not_null"):
            rule("not_null", col, rows(c_(col).isNull()))
        if r.get("unique"):
            rule("unique", col, single(repeated_values(df, col, by)))
        if "min" in r or "max" in r:
            rule("range", col, rows(range_violation(df, col, r)),
                 f"[{r.get('min', '-inf')}, {r.get('max', 'inf')}]")
        if "allowed" in r:
            rule("allowed", col, rows(allowed_violation(df, col, r)),
                 f"allowed: {r['allowed']}")
        if "regex" in r:
            rule("regex", col, rows(regex_violation(df, col, r)), r["regex"])

    schema = "rule string, col string, violations bigint, passed boolean, detail string"
    head = [] if by is None else ["group"]
    if not rules:
        return small_table(df.sparkSession, [], "group string, " * len(head) + schema)
    if by is None:
        measured = df.agg(*counts)
        for i, one in enumerate(singles):
            measured = measured.withColumn(f"s{i}", one.scalar())
    else:
        named = small_table(df.sparkSession, [(g,) for g in groups or []], "group string")
        measured = named.join(df.groupBy(c_(by).alias("group")).agg(*counts), "group", "left")
        for i, one in enumerate(singles):  # one row for each table
            measured = measured.join(one.withColumnRenamed("n", f"s{i}"), "group", "left")
        measured = measured.fillna(0)
    return measured.select(*head, F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(col).cast("string").alias("col"),
                 n.cast("bigint").alias("violations"), (n == 0).alias("passed"),
                 detail.alias("detail"))
        for name, col, n, detail in rules
    ])))


def _repeated_rows(df: DataFrame, by: str) -> DataFrame:
    return small_table(df.sparkSession, list(repeated_by(df, by).items()), "group string, n bigint")


def contract_summary(results: DataFrame) -> DataFrame:
    """``(passed, n_violations, n_rules)`` as one row."""
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
                       F.coalesce(F.sum("violations"), F.lit(0)).alias("n_violations"),
                       F.count(F.lit(1)).alias("n_rules"))
