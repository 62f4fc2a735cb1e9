"""Profiles of larger tables: small tasks, texts looked at once for each value."""

from pyspark.sql import functions as F

from scrubline.functions import cells
from scrubline.plans import profile as P
from scrubline.session import TASK_BYTES, prepare_session


def test_tasks_read_little(spark):
    """neither a scan nor a coalesced shuffle gives a task more than TASK_BYTES."""
    fresh = spark.newSession()
    name = "spark.sql.files.maxPartitionBytes"
    fresh.conf.set(name, "1m")
    prepare_session(fresh)
    assert fresh.conf.get(name) == "1m"
    assert int(fresh.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").rstrip("b")) <= TASK_BYTES


def rows():
    long = "Ab  cé " * 40
    texts = ["2020-01-02", "01/02/2020", " Yes", "yes", "yes", "1,200", "12", "P 12.50", "café", "", None,
             long, long, long.upper() + "x", "=", "#x", "09123456789", "a\tb  c"]
    return [(i, t, str(i * 7 % 13)) for i, t in enumerate(texts * 3)]


def table(spark):
    return spark.createDataFrame(rows(), "i int, t string, num string").repartition(3)


def test_folded_keys(spark):
    """the folded form, of short and of long texts, is that of the text itself."""
    df = table(spark)
    got = {(r["col"], r["k"], r["f"], r["n"]) for r in P.value_frequencies(df).collect()}
    x = F.col("x")
    plain = (df.select(F.stack(F.lit(2), F.lit("t"), F.col("t"), F.lit("num"), F.col("num")).alias("col", "x"))
             .where("x is not null").groupBy("col", cells.group_key(x).alias("k"),
                                             cells.group_key(cells.fold(x)).alias("f")).count())
    numbers = {("i", f"={i}", f"={i}", 1) for i, *_ in rows()}
    assert got == {tuple(r) for r in plain.collect()} | numbers


def test_texts_are_looked_at_once(spark):
    """the signals of distinct texts are those of all cells."""
    df = table(spark)
    values = P.counted_texts(df, P.value_frequencies(df))
    filled = sum(r[1] is not None for r in rows())
    assert values.where("col = 't'").agg(F.sum("n")).first()[0] == filled
    assert values.where("col = 'num'").count() == 13

    def told(found):
        return sorted(map(repr, found.collect()))

    assert told(P.text_signals(df, values=values)) == told(P.text_signals(df))
    assert told(P.nfc_signals(df, values=values)) == told(P.nfc_signals(df)) != []


def test_outliers_of_texts(spark):
    """text columns are parsed once, before the quantile passes."""
    texts = [f"{k % 50 + 100:,}" for k in range(400)] + ["9,000", "-5", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "amount string")
    found = [r["value"] for r in P.profile(df).where("signal = 'iqr_outliers'").collect()]
    assert found == [2.0]
