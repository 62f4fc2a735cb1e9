"""How well a cleaning run repaired the errors listed in a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import col as c_
from ..session import small_table

# --- fixed values -----------------------------------------------------------
EXPECTED_TOOL = {
    "duplicate": "drop_duplicates",
    "mixed_date_format": "normalize_dates",
    "phone_format": "normalize_phone",
    "currency_format": "normalize_currency",
    "category_casing": "standardize_categories",
    "dtype_corruption": "fix_dtypes",
    "outlier": "flag_outliers",
    "whitespace": "trim_whitespace",
    "null": "impute_missing",
}
FLAG_SUFFIX = {"null": "_missing", "outlier": "_outlier"}
TOLERANCE = 1e-9
# --- end of fixed values ----------------------------------------------------


def score_detection(manifest: DataFrame, steps: list[dict]) -> DataFrame:
    """The manifest with ``detected``: the plan holds the tool that answers
    this error on this column."""
    planned = {(s["tool"], s.get("col")) for s in steps}
    tools = {t for t, _ in planned}
    tool = F.lit(None).cast("string")
    for kind, name in EXPECTED_TOOL.items():
        tool = F.when(F.col("type") == kind, F.lit(name)).otherwise(tool)
    pairs = [F.concat_ws("/", F.lit(t), F.lit(c)) for t, c in planned if c]
    on_column = F.concat_ws("/", tool, "col").isin(*pairs) if pairs else F.lit(False)
    anywhere = (F.col("type") == "duplicate") & F.lit("drop_duplicates" in tools)
    return manifest.withColumn("detected", on_column | anywhere)


def same_cell(a: Column, b: Column, a_kind: str, b_kind: str, dtype_a, dtype_b) -> Column:
    """Equal as numbers within a relative tolerance, else equal as text; two
    missing cells are equal."""
    def text(c, kind, dtype):
        return c if kind == "text" else cells.number_text(c, dtype)

    def number(c, kind):
        if kind == "text":
            return cells.text_to_number(c)
        return c.cast("double") if kind in ("number", "bool") else F.lit(None).cast("double")

    x, y = number(a, a_kind), number(b, b_kind)
    close = F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y))
    as_text = text(a, a_kind, dtype_a) == text(b, b_kind, dtype_b)
    same = F.coalesce(close, F.lit(False)) | F.coalesce(as_text, F.lit(False))
    return same | (a.isNull() & b.isNull())


def aligned(clean: DataFrame, output: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Per clean row: how often the output has its key, which shared columns
    are equal, which flags are set, and its errors.

    Output rows and errors are reduced to one row per key before the joins,
    so all three meet on the key without multiplying rows.
    """
    shared = [c for c in clean.columns if c in output.columns and c != key]
    flags = [c for c in output.columns
             if any(c == s + e for s in clean.columns for e in FLAG_SUFFIX.values())]
    fields = [c_(c).alias(f"o{i}") for i, c in enumerate(shared)]
    marks = [c_(c).alias(f"f{i}") for i, c in enumerate(flags)]
    first = (output.groupBy(c_(key).cast("string").alias("k"))
             .agg(F.count(F.lit(1)).alias("copies"),
                  F.min(F.struct(*fields, *marks, F.lit(0).alias("z"))).alias("o")))
    errors = manifest.groupBy(F.col("key").alias("ek")).agg(
        F.collect_list(F.struct("type", "col", "detected")).alias("errors"))
    joined = (clean.withColumn("_k", c_(key).cast("string"))
              .join(first, F.col("_k") == F.col("k"), "left")
              .join(errors, F.col("_k") == F.col("ek"), "left"))
    ka, kb = cells.kinds(clean), cells.kinds(output)
    equal = F.array(*[
        F.struct(F.lit(c).alias("col"), same_cell(
            c_(c), F.col(f"o.o{i}"), ka[c], kb[c],
            clean.schema[c].dataType, output.schema[c].dataType).alias("same"))
        for i, c in enumerate(shared)
    ])
    set_flags = F.array_compact(F.array(F.lit(None).cast("string"), *[
        F.when(F.col(f"o.f{i}"), F.lit(c)) for i, c in enumerate(flags)
    ]))
    return joined.select(
        F.col("_k").alias("key"), F.coalesce("copies", F.lit(0)).alias("copies"),
        equal.alias("equal"), set_flags.alias("flags"),
        F.coalesce("errors", F.array().cast(
            "array<struct<type:string,col:string,detected:boolean>>")).alias("errors"))


def score_fix(rows: DataFrame) -> DataFrame:
    """``(type, col, key, detected, fixed)`` per error."""
    e = rows.select("key", "copies", "equal", "flags", F.explode("errors").alias("e")).select(
        "key", "copies", "equal", "flags", "e.*")
    suffix = F.when(F.col("type") == "null", "_missing").when(F.col("type") == "outlier",
                                                              "_outlier")
    repaired = F.exists("equal", lambda q: (q["col"] == F.col("col")) & q["same"])
    fixed = (F.when(F.col("copies") == 0, False)
             .when(F.col("type") == "duplicate", F.col("copies") == 1)
             .when(suffix.isNotNull(), F.array_contains("flags", F.concat("col", suffix)))
             .otherwise(repaired))
    return e.select("type", "col", "key", "detected",
                    F.coalesce(fixed, F.lit(False)).alias("fixed"))


def score_false_fix(rows: DataFrame) -> DataFrame:
    """``(n_clean_cells, n_false_fixes, false_fix_rate)``: cells no error was
    put into that differ from the clean table all the same."""
    hurt = F.transform(F.filter("errors", lambda e: e["type"] != "duplicate"),
                       lambda e: e["col"])
    untouched = F.filter("equal", lambda q: ~F.array_contains(F.col("hurt"), q["col"]))
    counted = (rows.filter("copies > 0").withColumn("hurt", hurt)
               .withColumn("untouched", untouched).agg(
                   F.coalesce(F.sum(F.size("untouched")), F.lit(0)).alias("n_clean_cells"),
                   F.coalesce(F.sum(F.size(F.filter("untouched", lambda q: ~q["same"]))),
                              F.lit(0)).alias("n_false_fixes")))
    return counted.withColumn("false_fix_rate", F.round(F.coalesce(
        F.try_divide(F.col("n_false_fixes"), F.col("n_clean_cells")), F.lit(0.0)), 4))


def score_summary(fixes: DataFrame) -> DataFrame:
    """Counts and rates per error type, and over all types as ``overall``."""
    return fixes.rollup("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("detected"),
        F.count_if("fixed").alias("fixed"), F.grouping("type").alias("g"),
    ).select(
        F.when(F.col("g") == 1, "overall").otherwise(F.col("type")).alias("type"),
        "n", "detected", "fixed",
        F.round(F.try_divide("detected", "n"), 4).alias("detection_rate"),
        F.round(F.try_divide("fixed", "n"), 4).alias("fix_rate"))


def score(clean: DataFrame, output: DataFrame, manifest: DataFrame, steps: list[dict],
          key: str) -> tuple[DataFrame, DataFrame]:
    """``score_summary`` and ``score_false_fix`` of one run."""
    rows = aligned(clean, output, score_detection(manifest, steps), key)
    return score_summary(score_fix(rows)), score_false_fix(rows)


def steps_table(spark, steps: list[dict]) -> DataFrame:
    return small_table(spark, [(s["tool"], s.get("col")) for s in steps],
                       "tool string, col string")
