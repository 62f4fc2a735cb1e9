"""Tables from files, from the catalog and from databases."""

from __future__ import annotations

import csv
import io
import posixpath
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions import patterns as P
from ..functions.cells import col as c_
from ..functions.text import distinct_names
from ..session import Workspace, stage
from .records import opens, records, split_states, start_states

SUFFIXES = (".csv", ".parquet")


def dedupe_column_names(df: DataFrame) -> DataFrame:
    """``a, a`` becomes ``a, a_2``; done before any column is named."""
    names = distinct_names(df.columns)
    return df if names == df.columns else df.toDF(*names)


def _header(reader: DataFrameReader, path: str) -> list[str]:
    """Column names of a CSV file as they stand, before Spark renames repeats."""
    return reader.option("header", False).csv(path).first().asDict().values()


def _csv(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("escape", '"').option("nullValue", "")


def _names(header: list[str | None]) -> list[str]:
    return distinct_names([n if n is not None else f"_c{i}" for i, n in enumerate(header)])


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with a header.  The words that mean a missing cell become null
    first, so that a number column with ``N/A`` in it is still numbers.

    Large files are read by many tasks, with and without line breaks in their
    cells: one scan tells which files have any; the others are read line by line,
    these record by record (see :mod:`.records`).  Types are inferred in one
    aggregate over all columns: a column is whole numbers, numbers or booleans if
    every filled cell is.
    """
    with Workspace(spark) as work:
        states = stage(split_states(spark, [path]), "states")
        broken = [r["file"] for r in states.where("breaks").select("file").distinct().collect()]
        if not broken:
            names = _names(_header(_csv(spark), path))
            raw = _csv(spark).option("header", True).csv(path)
        else:
            raw, names = _by_records(spark, path, states, set(broken), work)
    return _typed(raw, names, infer)


def _by_records(spark: SparkSession, path: str, states: DataFrame, broken: set[str],
                work: Workspace) -> tuple[DataFrame, list[str]]:
    """Files with line breaks in cells by records, the others line by line."""
    files = {unquote(r["file"]): r["file"] for r in states.select("file").distinct().collect()}
    paths = [f for f, named in files.items() if named in broken]
    starts = work.keep(stage(start_states(states.where(F.col("file").isin(list(broken)))), "starts"))
    cut = records(spark, paths, starts)
    header = cut.where("first").select("record").limit(1).collect()
    names = _names(_cells(header[0]["record"]) if header else [])
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"escape": '"', "nullValue": "", "multiLine": "true"}
    raw = cut.where("not first").select(F.from_csv("record", text.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    others = [f for f, named in files.items() if named not in broken]
    if others:
        plain = _csv(spark).option("header", True).schema(text).csv(others)
        raw = raw.unionByName(plain)
    return raw, names


def read_csv_files(spark: SparkSession, paths: list[str], by: str) -> tuple[list[DataFrame], dict[str, str]]:
    """Many CSV files as few tables: those of one header stand in one, as text,
    with the file's path in column ``by``; and the files that have no header.

    One scan of all files finds headers and line breaks, whatever their number.
    The staged states belong to the open workspace.
    """
    states = stage(split_states(spark, paths), "states")
    seen = states.groupBy("file").agg(F.max("head").alias("head"), F.max("breaks").alias("breaks")).collect()
    shapes: dict[tuple, list] = {}
    for r in seen:
        cells_ = _cells((r["head"] or "").rstrip("\r").removeprefix("\ufeff"))
        if r["breaks"] and opens(r["head"] or ""):  # the header itself goes over lines
            cells_ = list(_header(_csv(spark).option("multiLine", True), unquote(r["file"])))
        if cells_:
            shapes.setdefault(tuple(_names(cells_)), []).append(r)
    known = {unquote(r["file"]) for files in shapes.values() for r in files}
    missing = {p: "no header" for p in paths if _same_path(p) not in {_same_path(k) for k in known}}
    starts = None
    out = []
    for names, files in shapes.items():
        text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        parts = []
        if whole := [unquote(r["file"]) for r in files if not r["breaks"]]:
            parts.append(_csv(spark).option("header", True).schema(text).csv(whole).select(
                *text.names, F.col("_metadata.file_path").alias(by)))
        if broken := [r["file"] for r in files if r["breaks"]]:
            if starts is None:
                starts = stage(start_states(states), "starts")
            cut = records(spark, [unquote(f) for f in broken], starts.where(F.col("file").isin(broken)))
            ddl = ", ".join(f"{n} string" for n in text.names)
            parts.append(cut.where("not first").select(
                F.from_csv("record", ddl, {"escape": '"', "nullValue": "", "multiLine": "true"}).alias("r"),
                F.col("file").alias(by)).select("r.*", by))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        df = df.toDF(*names, by)
        out.append((df.select(*[F.when(~c_(n).isin(P.NULL_WORDS), c_(n)).alias(n) for n in names], by),
                    [unquote(r["file"]) for r in files]))
    return out, missing


def _same_path(path: str) -> str:
    return urlparse(path).path.replace("//", "/")


def infer_types_by(df: DataFrame, by: str, groups: list[str]) -> list[tuple[DataFrame, list[str]]]:
    """``infer_types`` of many tables in one aggregate; tables of other types come
    back in tables of their own."""
    names = [n for n, k in cells.kinds(df).items() if k == "text" and n != by]
    tests = [_is_whole, lambda c: cells.text_to_number(c).isNotNull(), lambda c: F.lower(c).isin("true", "false")]
    found = {r[0]: tuple(r)[1:] for r in df.groupBy(c_(by)).agg(*[
        F.coalesce(F.bool_and(F.when(c_(n).isNotNull(), test(c_(n)))), F.lit(False)).alias(f"t{i}_{j}")
        for i, n in enumerate(names) for j, test in enumerate(tests)]).collect()}
    alike: dict[tuple, list[str]] = {}
    for g in groups:
        flags = found.get(g, (False,) * (3 * len(names)))
        kinds = tuple(next((j for j in range(3) if flags[3 * i + j]), None) for i in range(len(names)))
        alike.setdefault(kinds, []).append(g)
    casts = (lambda c: F.trim(c).cast("bigint"), cells.text_to_number, lambda c: F.lower(c).cast("boolean"))
    out = []
    for kinds, mine in alike.items():
        typed = {n: casts[k](c_(n)) for n, k in zip(names, kinds, strict=True) if k is not None}
        rows = df if len(alike) == 1 else df.where(c_(by).isin(mine))
        out.append((rows.withColumns(typed) if typed else rows, mine))
    return out


def _cells(record: str) -> list[str | None]:
    return [c or None for c in next(csv.reader([record], strict=False), [])] if "\n" not in record else [
        c or None for c in next(csv.reader(io.StringIO(record, newline="")), [])]


def _typed(raw: DataFrame, names: list[str], infer: bool) -> DataFrame:
    df = raw.toDF(*names)
    df = df.select(*[F.when(~c_(n).isin(P.NULL_WORDS), c_(n)).alias(n) for n in names])
    return infer_types(df) if infer else df


def _is_whole(c: Column) -> Column:
    return c.rlike(r"^\s*[+-]?\d{1,19}\s*$") & F.trim(c).try_cast("bigint").isNotNull()


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest of bigint, double and boolean that
    loses nothing."""
    names = [n for n, k in cells.kinds(df).items() if k == "text"]
    if not names:
        return df
    tests: list[tuple[str, Callable[[Column], Column]]] = [
        ("w", _is_whole), ("n", lambda c: cells.text_to_number(c).isNotNull()),
        ("b", lambda c: F.lower(c).isin("true", "false")),
    ]
    row = df.agg(*[
        F.coalesce(F.bool_and(F.when(c_(n).isNotNull(), test(c_(n)))), F.lit(False))
        .alias(f"{tag}{i}")
        for i, n in enumerate(names) for tag, test in tests
    ]).first()
    typed = {}
    for i, n in enumerate(names):
        if row[f"w{i}"]:
            typed[n] = F.trim(c_(n)).cast("bigint")
        elif row[f"n{i}"]:
            typed[n] = cells.text_to_number(c_(n))
        elif row[f"b{i}"]:
            typed[n] = F.lower(c_(n)).cast("boolean")
    return df.withColumns(typed) if typed else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return cells.nan_to_null(dedupe_column_names(spark.read.parquet(path)))


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """A table from a path, by its suffix."""
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".parquet":
        return read_parquet(spark, path)
    raise ValueError(f"unsupported file type: {suffix or path}")


def pick_table(names: list[str], wanted: str | None = None) -> str:
    if wanted is not None:
        if wanted not in names:
            raise ValueError(f"no table '{wanted}' among {sorted(names)}")
        return wanted
    if len(names) != 1:
        raise ValueError(f"several tables, name one: {sorted(names)}")
    return names[0]


def read_table(spark: SparkSession, database: str | None = None,
               table: str | None = None) -> DataFrame:
    """A catalog table or view; the only one if none is named."""
    names = [t.name for t in spark.catalog.listTables(database)]
    name = pick_table(names, table)
    views = {t.name for t in spark.catalog.listTables(database) if t.isTemporary}
    full = name if name in views or database is None else f"{database}.{name}"
    return cells.nan_to_null(dedupe_column_names(spark.read.table(full)))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 64,
              **options: str) -> DataFrame:
    """A database table; with a numeric ``key`` and its bounds the read is
    split into parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = (reader.option("partitionColumn", key).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", partitions))
    return cells.nan_to_null(dedupe_column_names(reader.options(**options).load()))


def for_each_table(tables: dict[str, DataFrame],
                   job: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, str]]:
    """Run one job over several tables: the results under a ``table_name`` column,
    and the errors of tables that failed without stopping the others."""
    out, failed = None, {}
    for name, df in tables.items():
        try:
            part = job(df).withColumn("table_name", F.lit(name))
        except Exception as exc:  # noqa: BLE001 - one bad table must not stop the rest
            failed[name] = f"{type(exc).__name__}: {exc}"
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"every table failed: {failed}")
    return out, failed


def cleaned_path(source: str) -> str:
    stem, suffix = posixpath.splitext(source.rstrip("/"))
    return f"{stem}_cleaned{suffix}"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV that reads back cell by cell: blanks at the ends are kept."""
    (flat(df).write.mode(mode).option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def flat(df: DataFrame) -> DataFrame:
    """CSV holds flat values only: nested columns are written as JSON."""
    nested = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({n: F.to_json(c_(n)) for n in nested}) if nested else df


def write_cleaned(df: DataFrame, source: str) -> str:
    """Write beside the source, in its format; never over anything."""
    out = cleaned_path(source)
    suffix = posixpath.splitext(out)[1].lower()
    if suffix == ".csv":
        write_csv(df, out)
    elif suffix == ".parquet":
        df.write.mode("errorifexists").parquet(out)
    else:
        raise ValueError(f"unsupported file type: {suffix}")
    return out
