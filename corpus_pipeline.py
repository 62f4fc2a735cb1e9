"""Documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, as written Parquet; all but the last
return the columns of ``documents``.  Toxic documents, near-duplicates but one
of each group, and documents that hold a benchmark passage go; secrets are
replaced by a mark; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm.common import table
from scrubline.llm.op1_decontaminate import remove_contaminated
from scrubline.llm.op4_minhash_odd_sketch import keep_one
from scrubline.llm.op5_secret_scan import redact
from scrubline.llm.op7_packing import op7_packing
from scrubline.llm.op8_toxic_crf import keep_clean
from scrubline.session import stage

#: Toxicity, de-duplication and packing have no SQL form.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_packing(spark, sf_dir, docs)


STAGES = [("toxicity", toxicity), ("near-dedup", near_dedup), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
