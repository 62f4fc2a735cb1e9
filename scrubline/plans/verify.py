"""Verdicts: what became of each issue between two profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snake_case
from ..session import small_table
from .suggest import by_column, by_table, suggest_steps

# --- fixed values -----------------------------------------------------------
HELPER_SUFFIXES = ["_missing", "_outlier", "_invalid", "_currency", "_code"]
FLAGGED_BY = {"nulls": "_missing", "outliers": "_outlier"}
OPEN_VERDICTS = ["unresolved", "partially_resolved", "new_issue"]
TOOL_ISSUES = {
    "drop_duplicates": ["duplicates"],
    "drop_blank_rows": ["blank_rows"],
    "trim_whitespace": ["whitespace"],
    "normalize_dates": ["mixed_date_formats"],
    "normalize_phone": ["phone_format_chaos"],
    "normalize_currency": ["currency_strings", "numeric_as_string"],
    "fix_dtypes": ["numeric_as_string", "bool_as_string"],
    "standardize_categories": ["casing_variants"],
    "impute_missing": ["nulls"],
    "flag_outliers": ["outliers"],
}
FOLLOW_UP_TOOL = {
    "mixed_date_formats": "normalize_dates",
    "phone_format_chaos": "normalize_phone",
    "currency_strings": "normalize_currency",
    "numeric_as_string": "fix_dtypes",
    "bool_as_string": "fix_dtypes",
    "whitespace": "trim_whitespace",
    "casing_variants": "standardize_categories",
    "nulls": "impute_missing",
    "outliers": "flag_outliers",
    "blank_rows": "drop_blank_rows",
    "duplicates": "drop_duplicates",
}
# --- end of fixed values ----------------------------------------------------


def snake(c: Column) -> Column:
    """:func:`snake_case` as an expression."""
    words = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(words, r"(?U)[\W_]+", "_"), "^_|_$", ""))


def issue_sizes(profile: DataFrame) -> DataFrame:
    """``(col, issue, size)`` for every issue a profile shows."""
    def size(signal: str) -> Column:
        return F.col(signal)

    sizes = {
        "mixed_date_formats": F.when(F.col("date_formats_odd") > 0, F.col("date_formats")),
        "phone_format_chaos": F.when(F.col("phone_formats_odd") > 0, F.col("phone_formats")),
        "currency_strings": size("currency_like"),
        "numeric_as_string": size("numeric_as_string"),
        "bool_as_string": size("bool_as_string"),
        "whitespace": F.col("whitespace") + F.col("non_nfc"),
        "casing_variants": F.col("casing_raw") - F.col("casing_folded"),
        "nulls": size("null_pct"),
        "outliers": size("iqr_outliers"),
    }
    whole = {"duplicates": F.col("duplicate_rows"), "blank_rows": F.col("blank_rows")}

    def rows(df: DataFrame, col: Column, found: dict[str, Column]) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(col.alias("col"), F.lit(issue).alias("issue"),
                     v.cast("double").alias("size")) for issue, v in found.items()
        ]))).filter("size > 0")

    return rows(by_column(profile), F.col("col"), sizes).unionByName(
        rows(by_table(profile), F.lit(None).cast("string"), whole))


def column_names(profile: DataFrame) -> DataFrame:
    return profile.filter("signal = 'dtype'").select("col")


def verify_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(issue, col, before, after, verdict)`` by a full join of the issues.

    Columns are matched by name, else by their snake_case name.  A column that
    is gone counts as resolved.  Issues in new columns are new, unless the
    column is one a step added on purpose.
    """
    return _verdicts(column_names(before), issue_sizes(before), column_names(after), issue_sizes(after))


def verify_by(before: DataFrame, after: DataFrame, groups: list[str]) -> DataFrame:
    """``(group, issue, ...)``: the verdicts of many tables, from the profiles that
    ``profile_by`` made of them.

    A table's number stands before its column names while they are matched; its
    own issues go under the number alone.
    """
    numbers = small_table(before.sparkSession, [(g, f"t{i:06d}_") for i, g in enumerate(groups)],
                          "group string, mark string")

    def marked(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = profile.join(F.broadcast(numbers), "group")
        keyed = known.withColumn("col", F.concat("mark", "col"))
        # one table's own rows are kept apart by a column of that name
        own = known.where("col is null").withColumn("detail", F.col("signal")).groupBy("mark").agg(
            *[F.max(F.when(F.col("signal") == s, F.col("value"))).alias(s) for s in ("duplicate_rows", "blank_rows")])
        whole = own.select(F.inline(F.array(
            F.struct(F.col("mark").alias("col"), F.lit("duplicates").alias("issue"), F.col("duplicate_rows").alias("size")),
            F.struct(F.col("mark").alias("col"), F.lit("blank_rows").alias("issue"), F.col("blank_rows").alias("size"))
        ))).filter("size > 0")
        columns = issue_sizes(keyed.where("col is not null").drop("group", "mark")).where("col is not null")
        names = column_names(keyed).unionByName(numbers.select(F.col("mark").alias("col")))
        return names, columns.unionByName(whole)

    found = _verdicts(*marked(before), *marked(after))
    return (found.withColumn("mark", F.substring("col", 1, 8)).join(F.broadcast(numbers), "mark")
            .withColumn("name", F.expr("substring(col, 9)"))
            .select("group", "issue", F.when(F.col("name") != "", F.col("name")).alias("col"),
                    "before", "after", "verdict"))


def _verdicts(names_before: DataFrame, sizes_before: DataFrame, names: DataFrame,
              sizes_after: DataFrame) -> DataFrame:
    names_after = names.select(F.col("col").alias("name"))
    matched = (names_before
               .join(F.broadcast(names_after), F.col("col") == F.col("name"), "left")
               .withColumn("there", F.coalesce("name", snake(F.col("col"))))
               .select("col", "there"))
    b = sizes_before.withColumnRenamed("size", "b").join(
        F.broadcast(matched), "col", "left")
    a = sizes_after.withColumnRenamed("size", "a").select(
        F.col("col").alias("there"), "issue", "a")
    known = matched.select("col", "there")
    known_names = known.select(F.col("there")).union(known.select("col")).distinct()

    shared = a.join(F.broadcast(known_names), "there", "left_semi").unionByName(
        a.filter("there is null"))
    back = F.broadcast(matched.select(F.col("there").alias("t"), F.col("col").alias("origin")))
    joined = (b.alias("b").join(
        shared.alias("a"),
        F.col("b.there").eqNullSafe(F.col("a.there")) & (F.col("b.issue") == F.col("a.issue")),
        "full")
        .select(F.coalesce("b.issue", "a.issue").alias("issue"),
                F.col("b.col").alias("col_b"),
                F.coalesce("b.there", "a.there").alias("there"),
                F.coalesce("b", F.lit(0.0)).alias("before"),
                F.coalesce("a", F.lit(0.0)).alias("after"))
        .join(back, F.col("there") == F.col("t"), "left")
        .withColumn("col", F.coalesce("col_b", "origin", "there")))

    suffix = F.lit(None).cast("string")
    for issue, end in FLAGGED_BY.items():
        suffix = F.when(F.col("issue") == issue, F.lit(end)).otherwise(suffix)
    flags = F.broadcast(names_after.select(F.col("name").alias("flag")))
    joined = joined.join(flags, F.concat("there", suffix) == F.col("flag"), "left")
    by_flag = F.col("issue").isin(list(FLAGGED_BY))
    verdict = (
        F.when(by_flag & F.col("flag").isNotNull(), "flagged")
        .when(F.col("after") == 0, "resolved")
        .when(by_flag, "unresolved")
        .when(F.col("before") == 0, "new_issue")
        .when(F.col("after") < F.col("before"), "partially_resolved")
        .otherwise("unresolved")
    )
    old = joined.select("issue", "col", "before", "after", verdict.alias("verdict"))
    return old.unionByName(new_column_issues(a, known_names))


def new_column_issues(sizes: DataFrame, known_names: DataFrame) -> DataFrame:
    """Issues of columns the first profile does not know, helpers excluded."""
    helper = F.lit(False)
    for end in HELPER_SUFFIXES:
        helper = helper | F.col("there").endswith(end)
    return (sizes.filter("there is not null").filter(~helper)
            .filter(~F.col("issue").isin(list(FLAGGED_BY)))
            .join(F.broadcast(known_names), "there", "left_anti")
            .select("issue", F.col("there").alias("col"), F.lit(0.0).alias("before"),
                    F.col("a").alias("after"), F.lit("new_issue").alias("verdict")))


def _pairs(df: DataFrame, pairs: list[tuple[str, str]], names: str) -> DataFrame:
    return F.broadcast(small_table(df.sparkSession, pairs, names))


def follow_up_steps(verdicts: DataFrame, after: DataFrame) -> DataFrame:
    """Suggested steps on the new profile that aim at issues still open."""
    tools = _pairs(verdicts, list(FOLLOW_UP_TOOL.items()), "issue string, tool string")
    names = column_names(after).select(F.col("col").alias("name"))
    aims = (verdicts.filter(F.col("verdict").isin(OPEN_VERDICTS)).join(tools, "issue")
            .join(F.broadcast(names), F.col("col") == F.col("name"), "left")
            .select(F.col("tool").alias("t"),
                    F.coalesce("name", snake(F.col("col"))).alias("c")).distinct())
    steps = suggest_steps(after)
    return steps.join(
        F.broadcast(aims),
        (F.col("tool") == F.col("t")) & F.col("col").eqNullSafe(F.col("c")), "left_semi")


def targeted_verdicts(verdicts: DataFrame, steps: list[dict]) -> DataFrame:
    """Verdicts the given steps aimed at, plus every new issue."""
    aims = [(issue, snake_case(s["col"]) if s.get("col") else None)
            for s in steps for issue in TOOL_ISSUES.get(s["tool"], [])]
    table = _pairs(verdicts, sorted(set(aims), key=str), "i string, c string")
    hit = (F.col("issue") == F.col("i")) & (
        F.col("c").isNull() | F.col("col").isNull() | (snake(F.col("col")) == F.col("c")))
    is_new = F.col("verdict") == "new_issue"
    return verdicts.filter(is_new).unionByName(
        verdicts.filter(~is_new).join(table, hit, "left_semi"))
