"""Where personal data lives in a table: counts only, no values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, masks
from ..functions import patterns as P
from ..functions.cells import col as c_
from .profile import _long

# --- fixed values -----------------------------------------------------------
DETECTORS = {"email": P.EMAIL, "ph_phone": P.PH_PHONE, "person_name": P.PERSON_NAME}
RISK_ORDER = ["high", "medium", "low"]
# --- end of fixed values ----------------------------------------------------


def detect(c: Column, kind: str) -> Column:
    found = c.rlike(P.U + DETECTORS[kind])
    return F.contains(c, F.lit("@")) & found if kind == "email" else found


def scannable(df: DataFrame) -> list[str]:
    return [n for n, k in cells.kinds(df).items() if k in ("text", "number")]


def pii_counts(df: DataFrame) -> DataFrame:
    """``(col, n_cells, email, ph_phone, person_name)``: one pass over all
    cells, a row per column and partition in the shuffle."""
    x = F.col("x")
    values = _long(df, {n: cells.as_text(df, n) for n in scannable(df)}).filter("x is not null")
    return values.groupBy("col").agg(
        F.count(F.lit(1)).alias("n_cells"),
        *[F.count_if(detect(x, k)).alias(k) for k in DETECTORS])


def with_risk(counts: DataFrame) -> DataFrame:
    """Adds ``sensitive_name`` and ``risk``; columns without either drop out."""
    hits = [F.col(k) for k in DETECTORS]
    top = F.greatest(*hits)
    named = F.col("col").rlike(P.SENSITIVE_COLUMN)
    contact = (F.col("email") > 0) | (F.col("ph_phone") > 0)
    risk = (F.when(contact & (top > 0.5 * F.col("n_cells")), "high")
            .when(named & (top > 0), "high")
            .when(top > 0, "medium")
            .when(named, "low"))
    return (counts.withColumn("sensitive_name", named).withColumn("risk", risk)
            .filter("risk is not null"))


def pii_scan(df: DataFrame) -> DataFrame:
    """``(col, n_cells, email, ph_phone, person_name, sensitive_name, risk)``."""
    return with_risk(pii_counts(cells.nan_to_null(df)))


def risk_rank(c: Column) -> Column:
    rank = F.lit(len(RISK_ORDER))
    for i, r in enumerate(RISK_ORDER):
        rank = F.when(c == r, i).otherwise(rank)
    return rank


def pii_summary(findings: DataFrame, n_columns: int) -> DataFrame:
    """``(n_columns_scanned, n_columns_with_pii, highest_risk)``."""
    best = F.min(F.struct(risk_rank(F.col("risk")).alias("i"), F.col("risk")))
    return findings.agg(
        F.lit(n_columns).cast("bigint").alias("n_columns_scanned"),
        F.count(F.lit(1)).alias("n_columns_with_pii"),
        F.coalesce(best["risk"], F.lit("none")).alias("highest_risk"))


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(risk_rank(F.col("risk")), "col")


def pii_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with personal data, with the kinds found in ``pii_kinds``."""
    names = columns or scannable(df)
    kinds = F.array_compact(F.array(*[
        F.when(_any(*[F.coalesce(detect(cells.as_text(df, n), k), F.lit(False))
                      for n in names]), F.lit(k))
        for k in DETECTORS
    ]))
    return df.withColumn("pii_kinds", kinds).filter(F.size("pii_kinds") > 0)


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def mask_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns masked: whole cells where the name is sensitive, matches
    inside the text elsewhere."""
    names = columns or [n for n, k in cells.kinds(df).items() if k == "text"]
    return df.withColumns({n: masks.mask_sample(c_(n), n) for n in names})
