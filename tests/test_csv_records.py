"""CSV records that go over lines and splits, against Spark's whole-file reader."""

import random

import pytest

from scrubline.sources import read_csv, write_csv
from scrubline.sources.records import after, opens, records, split_states, start_states
from scrubline.session import stage


def whole_file(spark, path):
    """What one task that reads a whole file makes of it."""
    return spark.read.option("multiLine", True).option("escape", '"').option("nullValue", "").option(
        "header", True).csv(path)


def by_characters(line, inside):
    """Whether the line ends in an open cell, one character at a time."""
    state = "quoted" if inside else "start"
    steps = {("quoted", '"'): "quote", ("quote", '"'): "quoted", ("start", '"'): "quoted",
             ("start", ","): "start", ("plain", ","): "start", ("quote", ","): "start"}
    for c in line:
        state = steps.get((state, c), "quoted" if state == "quoted" else "plain")
    return state == "quoted"


def test_a_line_from_both_states():
    rng = random.Random(4)
    lines = ["", '"', '""', '"""', 'a,"b', '5" pipe,"open', '"a"b"c,"d', ',"",', '"' * 9999, 'a,"' + '""' * 50_000]
    lines += ["".join(rng.choice('"",a b') for _ in range(rng.randrange(14))) for _ in range(5000)]
    for line in lines:
        assert after(line, False) is by_characters(line, False) and opens(line) is after(line, False), line[:50]
        assert after(line, True) is by_characters(line, True), line[:50]


def random_cell(rng):
    kind = rng.random()
    if kind < 0.3:
        return str(rng.randrange(10 ** rng.randrange(1, 6)))
    letters = 'ab "\n,é' if kind < 0.6 else "abc d"
    return "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_any_split_gives_the_whole_file_reader_s_rows(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(k, *[random_cell(rng) or None for _ in range(3)]) for k in range(120)]
    path = f"file:{tmp_path}/c.csv"
    write_csv(spark.createDataFrame(rows, "k long, a string, b string, c string").coalesce(1), path)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        want = sorted(map(tuple, whole_file(spark, path).collect()), key=repr)
        got = read_csv(spark, path, infer=False)
        tasks = got.rdd.getNumPartitions()
        assert sorted(map(tuple, got.collect()), key=repr) == [
            tuple(None if v in ("null", "NULL", "None") else v for v in r) for r in want]
        assert tasks > 3 or size > 40
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_cell_over_many_splits(spark, tmp_path):
    """Splits that lie inside one cell as a whole, quotes at their edges."""
    big = "\n".join(['say ""no""' if k % 9 == 0 else f"line {k}" for k in range(400)])
    (tmp_path / "x.csv").write_text(f'k,t\n1,"{big}"\n2,plain\n3,"two\nlines"\n4,"{big}"\n')
    path = f"file:{tmp_path}/x.csv"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = {r["k"]: r["t"] for r in read_csv(spark, path).collect()}
        states = stage(split_states(spark, [path]), "states")
        starts = start_states(states).collect()
        assert len(starts) > 20 and sum(r["inside"] for r in starts) > 15
        assert records(spark, [path], stage(start_states(states), "starts")).count() == 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {1: big.replace('""', '"'), 2: "plain", 3: "two\nlines", 4: big.replace('""', '"')}


def test_files_with_and_without_line_breaks(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a one.csv").write_text('k,t\r\n1,x\r\n2,"y"\r\n')
    (folder / "b.csv").write_text('k,t\n3,"p\nq"\n\n4,5" pipe\n')
    (folder / "empty.csv").write_text("")
    got = sorted(map(tuple, read_csv(spark, f"file:{folder}").collect()))
    assert got == [(1, "x"), (2, "y"), (3, "p\nq"), (4, '5" pipe')]
