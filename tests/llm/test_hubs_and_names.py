"""Hot keys, clashing column names, and models that do not depend on the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.llm import op1_decontaminate as op1
from scrubline.llm import op4_minhash_odd_sketch as op4
from scrubline.llm import op8_toxic_crf as op8
from scrubline.llm.common import table
from scrubline.llm.graph import components

SF = "/root/testdata/sf0.001"


def test_components_of_a_hub(spark):
    """One node that a third of all links meet in, chains, and links by themselves."""
    rows = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(200)] + [
        (5000 + 2 * k, 5001 + 2 * k) for k in range(300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(400)) and all(found[1000 + k] == 1000 for k in range(201))
    assert all(found[5001 + 2 * k] == 5000 + 2 * k for k in range(300)) and len(found) == 400 + 201 + 600


def test_stages_take_documents_with_any_column(spark):
    text = " ".join(f"w{k}" for k in range(30))
    names = ["_id", "_dg", "id", "dg", "root", "node", "near id", "hit id"]
    df = spark.createDataFrame([(k, t, *"abcdefgh") for k, t in enumerate([text, text, text + " z", "other words here"])],
                               ["doc_id", "text", *names])
    kept = op4.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3]
    benchmark = spark.createDataFrame([("x", "other words here")], "item_id string, text string")
    left = op1.remove_contaminated(df, benchmark)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2]


def test_toxicity_model_does_not_depend_on_the_partitioning(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    # equal texts under ids of either label
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    more = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn(
        "toxic", (1 - F.col("toxic")).cast(labels.schema["toxic"].dataType)))
    scores = [op8.score(docs, op8.train(twice.repartition(n), more.repartition(n))).select(
        "doc_id", "score").toPandas().sort_values("doc_id").reset_index(drop=True) for n in (3, 7)]
    pd.testing.assert_frame_equal(scores[0], scores[1])
    assert np.isfinite(scores[0].score).all()
    assert pytest.approx(scores[0].score.iloc[0], abs=1) == 0.5
