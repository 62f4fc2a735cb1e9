"""CSV records whose quoted cells hold line breaks, read by many tasks a file.

A line alone does not say whether it starts a record or goes on inside a quoted
cell; that depends on everything before it in the file.  But a line can only do
two things: it turns each of the two states it may start in, between records or
inside quotes, into one of them.  These functions compose, so

1. every split of a file is scanned by itself for the state it would end in, for
   either state at its start (two bits for a split);
2. a running composition over the splits of each file, one small row for each
   split, gives the state every split really starts in;
3. the splits are scanned again: records that end where they began are complete,
   and the pieces of those that cross a split are put together by one group-by,
   at most one record for each split.

Quotes inside a cell are doubled.  A quote inside a cell that does not start with
one is an ordinary character, as it is for Spark's reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = ["_metadata.file_path as file", "_metadata.file_block_start as block"]
# From the start of a record to a quoted cell that is still open at the line's end.
_CELLS = r'(?:(?!")[^,]*+,|"[^"]*+(?:""[^"]*+)*+"[^,]*+,)*+'
_OPENS = re.compile(_CELLS + r'"[^"]*+(?:""[^"]*+)*+\Z', re.S)
# The rest of an open cell, and what stands between it and the next cell.
_CLOSES = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,|\Z)', re.S)


def opens(line: str, start: int = 0) -> bool:
    """Whether a line that starts between cells leaves a quoted cell open."""
    return _OPENS.match(line, start) is not None


def after(line: str, inside: bool) -> bool:
    """Whether the line leaves a quoted cell open, for either state at its start."""
    if '"' not in line:
        return inside
    if not inside:
        return opens(line)
    closed = _CLOSES.match(line)
    return closed is None or opens(line, closed.end())


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).selectExpr(*_PLACE, "value")


def split_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, block, outer, inner, breaks, head``: the state after a split for
    either state before it, whether any line leaves a cell open when read from a
    record's start, and a file's first line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, outer, inner, breaks, head, found = None, False, True, False, None, []

        def out(rows):
            columns = zip(*rows, strict=True)
            types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["file", "block", "outer", "inner", "breaks", "head"])

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != place:
                    if place is not None:
                        found.append((*place, outer, inner, breaks, head))
                    place, outer, inner, breaks = (file, block), False, True, False
                    head = line if block == 0 else None
                if '"' in line:
                    breaks = breaks or opens(line)
                    outer, inner = after(line, outer), after(line, inner)
        if place is not None:
            found.append((*place, outer, inner, breaks, head))
        if found:
            yield out(found)

    return _lines(spark, paths).mapInArrow(
        run, "file string, block bigint, outer boolean, inner boolean, breaks boolean, head string")


def start_states(states: DataFrame) -> DataFrame:
    """``file, block, number, inside``: the state every split starts in.

    A split that ends alike from both states forgets what was before, the others
    keep or swap it; so the state is the last forgetful split's, swapped as often
    as splits since then say.  One row for each split goes through the window.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("file").orderBy("block")
    fixed = F.when(F.col("outer") == F.col("inner"), F.col("outer"))
    swaps = (F.col("outer") & ~F.col("inner")).cast("int")
    running = F.sum(swaps).over(order)
    at_fixed = states.withColumn("fixed", fixed).withColumn("swapped", running).withColumn(
        "mark", F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swapped")))
    last = F.last("mark", ignorenulls=True).over(before)
    total = F.coalesce(F.sum(swaps).over(before), F.lit(0))
    known = at_fixed.withColumn("last", last).withColumn("total", total)
    inside = F.coalesce(F.col("last.fixed"), F.lit(False)) != (
        (F.col("total") - F.coalesce(F.col("last.swapped"), F.lit(0))) % 2 == 1)
    return known.select("file", "block", (F.row_number().over(order) - 1).alias("number"), inside.alias("inside"))


def records(spark: SparkSession, paths: list[str], states: DataFrame) -> DataFrame:
    """``file, first, record``: the text of every record; ``first`` marks a file's
    first one, its header.  Empty lines between records are no records.

    ``states`` is the written result of ``start_states``; its rows are bounded by
    the splits, and few bytes each.
    """
    starts = {(r["file"], r["block"]): (r["number"], r["inside"]) for r in states.collect()}
    shared = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        place, inside, number, first, cell = None, False, 0, False, []
        part = 0  # the pieces of a crossing record: 0 its head, then the splits' numbers

        def piece(kind: int) -> tuple:
            return (place[0], number, kind, first, "\n".join(cell))

        for batch in batches:
            rows = []
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != place:
                    if cell:
                        rows.append(piece(part))  # goes on in the next split
                    place, cell = (file, block), []
                    number, inside = starts[place]
                    first, part = number == 0, 2 if inside else 1
                cell.append(line)
                inside = after(line, inside)
                if not inside:
                    rows.append(piece(3 if part == 2 else 0))
                    cell, part, first = [], 1, False
            if rows:
                yield _pieces(rows)
        if cell:
            yield _pieces([piece(part)])

    pieces = _lines(spark, paths).mapInArrow(
        run, "file string, number bigint, kind int, first boolean, record string")
    whole = pieces.where("kind = 0").select("file", "first", "record")
    return whole.unionByName(_stitched(pieces.where("kind > 0"))).withColumn(
        "record", F.regexp_replace("record", r"\r\z", "")).where(F.trim("record") != "")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
        names=["file", "number", "kind", "first", "record"])


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records that cross splits: a head (kind 1), whole splits inside the cell
    (kind 2) and the tail (kind 3), in the order of the splits.

    A tail comes before the head of the same split's next record, so the heads so
    far, without the piece's own split, name the record.
    """
    before = Window.partitionBy("file").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    heads = F.last(F.when(F.col("kind") == 1, F.col("number")), ignorenulls=True)
    named = pieces.withColumn("head", F.when(F.col("kind") == 1, F.col("number")).otherwise(heads.over(before)))
    return named.groupBy("file", "head").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "record"))),
                                 lambda p: p["record"]), "\n").alias("record")
    ).select("file", "first", "record")
