"""The pipeline's stages, each against its own input."""

import corpus_pipeline
from scrubline.llm import op1_decontaminate as op1
from scrubline.llm import op4_minhash_odd_sketch as op4
from scrubline.llm import op5_secret_scan as op5
from scrubline.llm.common import table
from scrubline.session import stage

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near-dedup", "decontamination", "secrets", "packing"]
    kept = [docs]
    for name, function in corpus_pipeline.STAGES:
        kept.append(stage(function(spark, kept[-1], SF), name))
        if name != "packing":
            assert kept[-1].columns == columns
    clean, single, uncontaminated, redacted, packed = kept[1:]
    assert 0 < clean.count() < docs.count()
    assert op4.near_duplicates(single).where("not kept").count() == 0
    assert single.count() == op4.near_duplicates(clean).where("kept").count()
    bench = table(spark, SF, "benchmark")
    assert op1.decontaminate(uncontaminated, bench).where("contaminated").count() == 0
    assert uncontaminated.count() == op1.decontaminate(single, bench).where("not contaminated").count()
    assert op5.secret_scan(redacted).where("size(spans) > 0").count() == 0
    assert redacted.count() == uncontaminated.count()
    assert packed.select("doc_id").distinct().count() == redacted.count()


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), name)
    assert docs.count() == 0


def test_one_document_of_each_group(spark):
    """Near copies without ids, and under one repeated id that is the least."""
    words = [f"w{k}" for k in range(300)]

    def copies(mark, ids):
        return [(i, " ".join([mark, *words[:k], f"{mark}{k}", *words[k + 1:]])) for k, i in enumerate(ids, 5)]

    other = [(9, "another text without any copy"), (9, "another text without any copy"), (None, ""), (None, None), (8, " ")]
    for ids, kept in (([None] * 4, {None}), ([1, 1, 1, 2], {1}), ([None, 3, 4, None], {3})):
        docs = spark.createDataFrame(copies("a", ids) + other, "doc_id long, text string")
        left = [(r["doc_id"], r["text"]) for r in op4.keep_one(docs).collect()]
        assert {i for i, t in left if t and t[0] == "a" and "w9" in t} == kept
        assert len(left) == 5 and len(set(left)) == 5
