"""Recipes, automatic cleaning, error injection with scores, sources, feed."""

import json
import os

import pytest
from conftest import SF
from pyspark.sql import functions as F

from scrubline.catalog.views import view
from scrubline.plans.autoclean import auto_clean
from scrubline.plans.inject import HashPick, inject
from scrubline.plans.recipe import check_steps, load_recipe, run_recipe, save_recipe
from scrubline.plans.score import score
from scrubline.session import stage
from scrubline.sources import (dedupe_column_names, pick_table, read_csv, read_path, read_table,
                               write_cleaned, write_csv)
from scrubline.streaming.feed import (Feed, feed_audit, feed_log, feed_rejected, feed_verdicts,
                                      process_batch, result_path)


def step(tool, col=None, **params):
    return {"tool": tool, "col": col, "params": params, "reason": "test"}


def test_run_and_audit(spark):
    df = spark.createDataFrame(
        [("03/04/2021", 1, " Ana Cruz"), ("2021-01-01", 1, "Ana Cruz"), (None, 2, "x"),
         (None, 2, "x"), (None, None, " ")], "d string, x int, `Full Name` string")
    run = run_recipe(df, [
        step("drop_blank_rows"), step("normalize_dates", "d"), step("bogus_tool", "x"),
        step("drop_duplicates"), step("drop_rows_where", "x", max=1), step("scale_numeric", "x"),
        step("trim_whitespace", "full_name"), step("impute_missing", "d")])
    audit = {r.step: r for r in run.audit().collect()}
    assert [audit[i].status for i in range(8)] == [
        "ok", "ok", "skipped", "ok", "ok", "error", "ok", "ok"]
    assert [audit[i].rows_affected for i in range(8)] == [1, 1, None, 1, 1, None, 1, 0]
    assert "equal" in audit[5].error
    assert audit[6].stats["col_resolved_to"] == "Full Name"
    assert "Ana" not in str(audit[6].examples) and len(audit[6].examples) == 1
    assert df.count() == 5 and run.df.count() == 2


def test_frozen_fits(spark):
    train = spark.createDataFrame([(float(x),) for x in (10, 11, 12, 10, 11, 9000)], "x double")
    steps = [step("flag_outliers", "x"), step("impute_missing", "x", strategy="median")]
    fitted = run_recipe(train, steps).fitted
    later = spark.createDataFrame([(8999.0,), (None,)], "x double")
    rows = run_recipe(later, steps, fitted).df.collect()
    assert {(r.x, r.x_outlier) for r in rows} == {(8999.0, True), (11.0, False)}


def test_recipe_file(spark, tmp_path):
    steps = [step("drop_duplicates"), step("normalize_phone", "phone")]
    path = save_recipe(spark, steps, f"file:{tmp_path}/r.json", "x.csv")
    assert load_recipe(spark, path) == steps
    assert json.loads((tmp_path / "r.json").read_text())["source"] == "x.csv"
    (tmp_path / "bad.json").write_text(json.dumps({"steps": [step("rm_rf")]}))
    with pytest.raises(ValueError):
        load_recipe(spark, f"file:{tmp_path}/bad.json")


@pytest.mark.parametrize("bad", [
    step("drop_rows_where", "a", equals="x"), step("impute_missing", "a", strategy="mean"),
    step("flag_outliers", "a", action="drop"), step("format_text", "a"),
    step("trim_whitespace", "nope"), step("trim_whitespace"), {"tool": "drop_duplicates"},
    step("replace_values", "a"), step("drop_blank_columns", columns=["nope"])])
def test_unsafe_or_wrong_steps(bad):
    with pytest.raises(ValueError):
        check_steps([bad], ["a", "b"])


def test_allowed_when_asked():
    assert check_steps([step("format_text", "A b")], ["A b"], allow=True)
    assert check_steps([step("trim_whitespace", "a_b")], ["A b"])


SPEC = {"dates": ["signup"], "phones": ["phone"], "currency": ["spend"], "casing": ["segment"],
        "dtype": ["points"], "outliers": ["age"], "whitespace": ["full_name"],
        "nulls": ["email"], "duplicates": ["customer_id"]}


def test_quality_of_automatic_cleaning(spark):
    """Injected errors are found, repaired, and nothing else is touched."""
    clean = stage(view(spark, "/root/testdata/sf0.01", "clean_customers").withColumn(
        "email", F.concat(F.lit("c"), F.col("customer_id").cast("string"), F.lit("@m.org"))))
    made = inject(clean, "customer_id", SPEC, HashPick(0.10, 42))
    dirty, manifest = stage(made.df), stage(made.manifest)
    assert manifest.count() > 1000
    result = auto_clean(dirty)
    summary, false_fix = score(clean, result.df, manifest, result.steps, "customer_id")
    rates = {r.type: r for r in summary.collect()}
    assert len(rates) == 10
    assert rates["overall"].detection_rate == 1.0
    assert rates["overall"].fix_rate >= 0.973
    assert false_fix.first().n_false_fixes == 0
    assert result.n_open() == 0


def test_few_rows_still_get_errors(spark):
    df = spark.createDataFrame([(i, f"w {i}") for i in range(20)], "k int, t string")
    made = inject(df, "k", {"whitespace": ["t"]}, HashPick(0.0001))
    assert made.manifest.count() == 3
    with pytest.raises(ValueError):
        inject(df, "k", {"nulls": ["k"]})


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,a,n,flag,t\n1,x,1.5,true," a ""q"", b"\nN/A,y,,False,null\n')
    df = read_csv(spark, f"file:{path}")
    assert df.columns == ["a", "a_2", "n", "flag", "t"]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1, "x", 1.5, True, ' a "q", b'), (None, "y", None, False, None)]
    out = write_cleaned(df, f"file:{path}")
    assert os.path.isdir(tmp_path / "x_cleaned.csv")
    assert read_path(spark, out).exceptAll(df).isEmpty()
    with pytest.raises(Exception):
        write_cleaned(df, f"file:{path}")
    with pytest.raises(ValueError):
        read_path(spark, "x.xlsx")


def test_tables(spark):
    assert dedupe_column_names(spark.range(1).selectExpr("id as a", "id as a", "id as a_2")
                               ).columns == ["a", "a_3", "a_2"]
    with pytest.raises(ValueError):
        pick_table(["a", "b"])
    spark.range(3).createOrReplaceTempView("three")
    assert read_table(spark, table="three").count() == 3


def test_feed(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    good = "id,phone,age\n" + "".join(f"{i},0917123{i:04d},{20 + i % 5}\n" for i in range(40))
    (landing / "good.csv").write_text(good)
    (landing / "other schema.csv").write_text("totally,different\n1,2\n")
    (landing / "breach.csv").write_text(good.replace(",20\n", ",999\n"))
    (landing / "good_cleaned.csv").write_text(good)
    (landing / "broken.parquet").write_text("not parquet")
    (landing / "empty.csv").write_text("\n")
    (landing / "breaks é.csv").write_text(good.replace("id,phone", 'id,"phone').replace("phone,", 'phone",'))
    (landing / "notes.txt").write_text("skip me")
    spark.createDataFrame([(1, "09171230001", 21)], "id long, phone string, age long").coalesce(1).write.parquet(
        f"file:{landing}/sub/p.parquet")
    feed = Feed(*[f"file:{tmp_path}/{n}" for n in
                  ("landing", "out", "quarantine", "log", "checkpoint")],
                steps=[step("normalize_phone", "phone"), step("flag_outliers", "age")],
                contract={"columns": {"age": {"max": 120}}})
    feed.start(spark).awaitTermination()
    log = {r.file: r for r in feed_log(spark, feed.log).collect()}
    parquet = [f for f in log if f.startswith("sub@-p.parquet@-part-")]
    assert set(log) == {"good.csv", "other schema.csv", "breach.csv", "broken.parquet", "empty.csv",
                        "breaks é.csv", *parquet} and len(parquet) == 1
    assert log["good.csv"].status == log["breaks é.csv"].status == log[parquet[0]].status == "cleaned"
    assert log["good.csv"].rows == log["breaks é.csv"].rows == 40 and log[parquet[0]].rows == 1
    assert "steps need other columns" in log["other schema.csv"].reason
    assert log["breach.csv"].reason == "broken rules: range of age (8)"
    assert "not processed" in log["broken.parquet"].reason and "not processed" in log["empty.csv"].reason
    for name in ("good.csv", "breaks é.csv"):
        cleaned = read_csv(spark, result_path(feed.out, name), infer=False)
        assert cleaned.filter("phone like '+639%'").count() == 40
    assert read_csv(spark, result_path(feed.quarantine, "breach.csv")).count() == 40
    rejected = {r.file: r["count"] for r in feed_rejected(spark, feed.log).groupBy("file").count().collect()}
    assert rejected == {"breach.csv": 40, "other schema.csv": 1}
    audit = {(r.file, r.tool): r.rows_affected for r in feed_audit(spark, feed.log).collect()}
    assert audit["good.csv", "normalize_phone"] == 40 and audit["breach.csv", "flag_outliers"] == 8
    assert ("breach.csv", "outliers", "age", "flagged") in {
        (r.file, r.issue, r.col, r.verdict) for r in feed_verdicts(spark, feed.log).collect()}

    (landing / "later.csv").write_text(good)
    feed.start(spark).awaitTermination()
    names = [r.file for r in feed_log(spark, feed.log).collect()]
    assert sorted(names) == sorted([*log, "later.csv"])
    # a batch without its manifest is no part of the log
    os.remove(tmp_path / "log" / "commits" / "1.json")
    assert "later.csv" not in [r.file for r in feed_log(spark, feed.log).collect()]


def test_jobs_of_a_batch_do_not_grow_with_its_files(spark, tmp_path):
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for n in (4, 40):
        landing = tmp_path / f"landing{n}"
        landing.mkdir()
        for k in range(n):
            rows = "".join(f"{i},0917123{i:04d},{20 + i % 5 + (900 if i == k % 9 else 0)}\n" for i in range(30))
            (landing / f"f{k}.csv").write_text("id,phone,age\n" + rows)
        feed = Feed(f"file:{landing}", *[f"file:{tmp_path}/{x}{n}" for x in ("out", "quarantine", "log", "checkpoint")],
                    steps=[step("normalize_phone", "phone"), step("flag_outliers", "age"),
                           step("standardize_categories", "phone"), step("impute_missing", "age")])
        spark.sparkContext.setJobGroup(f"feed{n}", "")
        process_batch(spark, [f"file:{landing}/f{k}.csv" for k in range(n)], feed, 0)
        jobs[n] = len(tracker.getJobIdsForGroup(f"feed{n}"))
        assert [r.status for r in feed_log(spark, feed.log).collect()] == ["cleaned"] * n
        assert len(os.listdir(tmp_path / f"out{n}")) >= n
    spark.sparkContext.setJobGroup("", "")
    # Spark lists more than 32 paths by a job of its own, for lines and for cells
    assert 0 < jobs[4] <= jobs[40] <= jobs[4] + 3


def test_csv_keeps_line_breaks(spark, tmp_path):
    rows = [(1, 'a\nb "c"\n\n'), (2, "c"), (3, 'x, "y"'), (4, '"'), (5, "\n")]
    for part in (rows, rows[1:3]):
        path = f"file:{tmp_path}/lines{len(part)}.csv"
        write_csv(spark.createDataFrame(part, "i bigint, t string"), path)
        assert sorted(map(tuple, read_csv(spark, path).collect())) == part


def test_csv_keeps_margins(spark, tmp_path):
    df = view(spark, SF, "dirty_customers")
    write_csv(df, f"file:{tmp_path}/c")
    assert read_csv(spark, f"file:{tmp_path}/c").exceptAll(df).isEmpty()
