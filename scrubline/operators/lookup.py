"""Value mappings that may be small or as large as the data.

A mapping has columns ``k`` (key text), ``v`` (what it becomes) and ``n`` (rows
with that key).  A few entries travel inside the plan, a bounded table is
broadcast, and a larger one is joined by shuffle with its most frequent keys
taken out first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import small_table, stage

IN_PLAN = 64            # entries written into the expression itself
MAX_ROWS = 10_000       # entries a broadcast may hold ...
MAX_CHARS = 500         # ... each of at most this many characters
SPREAD = 100_000


@dataclass
class Lookup:
    table: DataFrame
    rows: list[Row] | None  # None when the mapping is too large for the driver

    @property
    def small(self) -> bool:
        return self.rows is not None

    @cached_property
    def size(self) -> int:
        """Entries, whatever their number."""
        return len(self.rows) if self.small else self.table.count()


def bounded_rows(table: DataFrame) -> list[Row] | None:
    """The mapping's rows if few and short, else None.

    Never moves more than ``MAX_ROWS`` + 1 rows of bounded length: a long
    text is replaced by null on the executor and only its presence is seen.
    """
    text = [f.name for f in table.schema.fields if f.dataType.typeName() == "string"]
    long = F.lit(False)
    for c in text:
        long = long | F.coalesce(F.length(c) > MAX_CHARS, F.lit(False))
    probe = table.withColumn("_long", long).withColumns(
        {c: F.when(~F.col("_long"), F.col(c)) for c in text})
    rows = probe.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS or any(r["_long"] for r in rows):
        return None
    return rows


def build(table: DataFrame, written: bool = False) -> Lookup:
    """Size the mapping; a large one is written once, unless it was already, so
    that the joins below read it instead of computing it again."""
    rows = bounded_rows(table)
    return Lookup(table if written or rows is not None else stage(table, "lookup"), rows)


def attach(df: DataFrame, key: Column, lookup: Lookup, out: str) -> DataFrame:
    """``df`` with column ``out``: the mapped value, null where none applies."""
    if lookup.small:
        return _attach_small(df, key, lookup, out)
    return _attach_large(df, key, lookup.table, out)


def _attach_small(df: DataFrame, key: Column, lookup: Lookup, out: str) -> DataFrame:
    value_type = lookup.table.schema["v"].dataType
    if not lookup.rows:
        return df.withColumn(out, F.lit(None).cast(value_type))
    if len(lookup.rows) <= IN_PLAN:
        pairs = [F.lit(x) for r in lookup.rows for x in (r["k"], r["v"])]
        return df.withColumn(out, F.try_element_at(F.create_map(*pairs), key).cast(value_type))
    schema = lookup.table.select(F.col("k").alias("_k"), F.col("v").alias(out)).schema
    table = small_table(df.sparkSession, [(r["k"], r["v"]) for r in lookup.rows], schema)
    return (df.withColumn("_key", key)
              .join(F.broadcast(table), F.col("_key") == F.col("_k"), "left")
              .drop("_key", "_k"))


def _attach_large(df: DataFrame, key: Column, table: DataFrame, out: str) -> DataFrame:
    """Shuffle join that no frequent key can overload.

    The most frequent keys are mapped by a bounded broadcast.  Rows they
    served, and rows without a key, go to the second join under a salt that
    spreads them evenly and matches nothing.  The salt is a hash of the row, so
    a repeated task sends each row where the first attempt did.
    """
    short = (F.length("k") <= MAX_CHARS)
    if table.schema["v"].dataType.typeName() == "string":
        short = short & (F.length("v") <= MAX_CHARS)
    hot = table.filter(short).orderBy(F.desc("n"), "k").limit(MAX_ROWS)
    hot = hot.select(F.col("k").alias("_hk"), F.col("v").alias("_hv"))
    cold = table.select(F.col("k").alias("_k"), F.col("v").alias("_cv"),
                        F.lit(0).cast("bigint").alias("_s"))
    served = df.withColumn("_key", key).join(
        F.broadcast(hot), F.col("_key") == F.col("_hk"), "left")
    salt = F.when(
        F.col("_hk").isNotNull() | F.col("_key").isNull(),
        1 + F.pmod(F.xxhash64(*_hashable(df)), F.lit(SPREAD)),
    ).otherwise(F.lit(0)).cast("bigint")
    served = served.withColumn("_salt", salt)
    joined = served.join(
        cold, (F.col("_key") == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    return joined.withColumn(out, F.coalesce("_hv", "_cv")).drop(
        "_key", "_hk", "_hv", "_salt", "_k", "_cv", "_s")


def _hashable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields
            if "map<" not in f.dataType.simpleString()]


def ranked(distinct: DataFrame, order: list[Column], start: int = 1) -> DataFrame:
    """``distinct`` with ``v`` = position in the global order, counted from
    ``start``, without sorting everything in one task.

    The rows are range-partitioned and numbered inside each partition in a
    written copy; the partitions' row counts, one small row each, give the
    offsets.
    """
    numbered = stage(
        distinct.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(numbered.groupBy(part.alias("p")).count().collect())
    offset, pairs = start, []
    for r in sizes:
        pairs.append((r["p"], offset))
        offset += r["count"]
    offsets = small_table(distinct.sparkSession, pairs, "p bigint, o bigint")
    return (numbered.withColumn("_p", part)
            .join(F.broadcast(offsets), F.col("_p") == F.col("p"))
            .withColumn("v", F.col("o") + place).drop("_id", "_p", "p", "o"))
