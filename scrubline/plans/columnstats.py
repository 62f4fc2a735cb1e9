"""Statistics of a single column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import col as c_
from ..operators.quantiles import quantiles
from ..session import small_table

BINS = 10
TOP = 8


def column_stats(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """One row: counts and shares, and a numeric summary where at least 90 %
    of the filled cells are numbers."""
    df = cells.nan_to_null(df)
    x, number = c_(name), cells.as_number(df, name)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("filled"),
        F.count(number).alias("numbers"), F.min(number).alias("min"),
        F.max(number).alias("max"), F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"))
    key = cells.group_key(x) if cells.kind(df, name) == "text" else x
    unique = (df.filter(x.isNotNull()).groupBy(key.alias("k")).agg(F.lit(1).alias("one"))
              .agg(F.count(F.lit(1)).alias("unique")))
    q1, median, q3 = quantiles(df.select(x), {name: number}, [0.25, 0.5, 0.75],
                               approximate)[name]

    def share(a: str, b: str):
        return F.coalesce(F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 1), F.lit(0.0))

    numeric = (F.col("numbers") >= F.floor(0.9 * F.col("filled"))) & (F.col("numbers") > 0)

    def when_numeric(c):
        return F.when(numeric, F.round(c, 4))

    return row.withColumn("unique", unique.scalar()).select(
        F.lit(name).alias("col"), "n", (F.col("n") - F.col("filled")).alias("nulls"),
        F.coalesce(F.round(F.try_divide(100.0 * (F.col("n") - F.col("filled")), F.col("n")), 1),
                   F.lit(0.0)).alias("null_pct"),
        "unique", share("unique", "filled").alias("unique_pct"),
        share("filled", "n").alias("fill_pct"),
        when_numeric(F.col("min")).alias("min"), when_numeric(F.col("max")).alias("max"),
        when_numeric(F.col("mean")).alias("mean"),
        when_numeric(F.lit(median).cast("double")).alias("median"),
        F.when(numeric, F.coalesce(F.round("std", 4), F.lit(0.0))).alias("std"),
        when_numeric(F.lit(q1).cast("double")).alias("q1"),
        when_numeric(F.lit(q3).cast("double")).alias("q3"))


def column_histogram(df: DataFrame, name: str, bins: int = BINS) -> DataFrame:
    """``(bin, low, high, n)``: equal-width bins closed on the right, empty
    ones included.  The range is a one-row aggregate; the counts are a group-by
    over at most ``bins`` keys."""
    x = cells.finite(cells.as_number(df, name))
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    spark = df.sparkSession
    if lo is None:
        return small_table(spark, [], "bin bigint, low double, high double, n bigint")
    if lo == hi:  # a constant column sits in the middle of a small range
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
    width = (hi - lo) / bins
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((x - F.lit(lo)) / F.lit(width))))
    counted = (df.filter(x.isNotNull()).groupBy(place.cast("bigint").alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    frame = spark.range(1, bins + 1, numPartitions=1).withColumnRenamed("id", "bin")
    return frame.join(counted, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("low"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def column_top_values(df: DataFrame, name: str, top: int = TOP) -> DataFrame:
    """``(value, n, pct)``: the most frequent values and their share."""
    counted = (df.filter(c_(name).isNotNull()).groupBy(cells.as_text(df, name).alias("value"))
               .agg(F.count(F.lit(1)).alias("n")))
    total = df.agg(F.count(c_(name))).scalar()
    best = counted.orderBy(F.desc("n"), "value").limit(top)
    return best.select("value", "n", F.round(100.0 * F.col("n") / total, 1).alias("pct"))
