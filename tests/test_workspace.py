"""Staged tables have an owner that deletes them."""

import os

import pytest

from scrubline.session import Workspace, shared_folder, stage


def listed(spark):
    folder = shared_folder(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return set(os.listdir(folder))


def test_staged_tables_go_with_their_workspace(spark):
    before = listed(spark)
    with Workspace(spark):
        stage(spark.range(3), "a")
        with Workspace(spark) as inner:
            stage(spark.range(4), "b")
            kept = inner.keep(stage(spark.range(5), "c"))
        assert {f.split("-")[0] for f in listed(spark) - before} == {"a", "c"}
        assert kept.count() == 5
    assert listed(spark) == before


def test_result_outlives_all(spark):
    before = listed(spark)
    with Workspace(spark) as work:
        out = work.result(stage(spark.range(3), "a"), "out")
    assert {f.split("-")[0] for f in listed(spark) - before} == {"out"}
    assert out.count() == 3


def test_nothing_stays_after_an_error(spark):
    before = listed(spark)
    with pytest.raises(Exception), Workspace(spark):  # noqa: B017
        stage(spark.range(3), "a")
        stage(spark.range(3).selectExpr("raise_error('no') as x"), "b")
    assert listed(spark) == before


def test_without_a_workspace_the_caller_owns(spark):
    before = listed(spark)
    stage(spark.range(2), "mine")
    assert {f.split("-")[0] for f in listed(spark) - before} == {"mine"}
