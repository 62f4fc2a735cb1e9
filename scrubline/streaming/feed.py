"""A landing folder whose files are cleaned with a recipe as they arrive.

A streaming query finds the new files; its checkpoint remembers them.  Each
micro-batch hands over paths only.  Files of one shape (column names and types)
then stand in one table with the file's name as a column, and every pass is
grouped by it: types, profiles, fits, verdicts, contract and audit take as many
jobs for forty files as for four.  A file that cannot be read is found when its
shape's table fails: the files are halved until it is alone.

Folders of a feed::

    out/__file=<name>/            cleaned rows, CSV with a header
    quarantine/__file=<name>/     the cleaned attempt of a rejected file
    log/rejected/batch=<n>/       file, reason, row: a rejected file's rows as they came, JSON
    log/audit/batch=<n>/          file and the audit of every step
    log/verdicts/batch=<n>/       file and the verdict on every issue
    log/files/batch=<n>/          file, status, reason, rows
    log/commits/<n>.json          the manifest of a finished batch, written last

Everything of a batch is overwritten if it runs again after a failure, and the
readers below take only batches that have a manifest, so a log never holds half
a batch.
"""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import cells
from ..plans.contract import validate
from ..plans.grouped import Branch, run_recipe_by
from ..plans.profile import profile_by
from ..plans.recipe import AUDIT, audit_by, check_steps
from ..plans.verify import OPEN_VERDICTS, verify_by
from ..session import Workspace, files_under, small_table, stage, write_text
from ..sources.tables import SUFFIXES, dedupe_column_names, flat, infer_types_by, read_csv_files

BY = "__file"
LOG = "file string, status string, reason string, rows bigint"
VERDICTS = "file string, issue string, col string, before double, after double, verdict string"
REJECTED = "file string, reason string, row string"
SKIPPED = ("_cleaned", "_attempt")
FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass
class Feed:
    """Where files come from and go to, and what is done to them."""

    landing: str
    out: str
    quarantine: str
    log: str
    checkpoint: str
    steps: list[dict]
    contract: dict | None = None
    files_per_batch: int = 64

    def start(self, spark: SparkSession, once: bool = True) -> StreamingQuery:
        """Follow the folder; ``once`` takes what is there and stops."""
        files = (spark.readStream.format("binaryFile").schema(FILES_SCHEMA)
                 .option("recursiveFileLookup", "true")
                 .option("maxFilesPerTrigger", self.files_per_batch)
                 .load(self.landing).select("path"))
        writer = (files.writeStream.foreachBatch(self._batch)
                  .option("checkpointLocation", self.checkpoint))
        writer = writer.trigger(availableNow=True) if once else writer
        return writer.start()

    def _batch(self, paths: DataFrame, batch_id: int) -> None:
        """One micro-batch; it names at most ``files_per_batch`` files."""
        found = sorted(unquote(r["path"]) for r in paths.filter(_wanted()).collect())
        if found:
            process_batch(paths.sparkSession, found, self, batch_id)


@dataclass
class _Result:
    """What a batch found out, by file."""
    status: dict[str, tuple] = field(default_factory=dict)  # status, reason, rows
    audits: list[DataFrame] = field(default_factory=list)
    verdicts: list[DataFrame] = field(default_factory=list)
    sources: list[tuple[DataFrame, list[str]]] = field(default_factory=list)
    cleaned: list[Branch] = field(default_factory=list)

    def refuse(self, files: list[str], reason: str) -> None:
        self.status.update({f: ("quarantined", reason, None) for f in files})


def _wanted():
    """Table files, without the feed's own output names."""
    name = F.lower(F.col("path"))
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    wanted = F.lit(False)
    for s in SUFFIXES:
        wanted = wanted | name.endswith(s)
    for s in SKIPPED:
        wanted = wanted & ~stem.endswith(s)
    return wanted


def _name(path: str, landing: str) -> str:
    """The file's path below the landing folder, as one flat name that may be
    part of a folder's: no two files share one."""
    full, root = urlparse(path).path, urlparse(landing).path.rstrip("/") + "/"
    inner = full[len(root):] if full.startswith(root) else posixpath.basename(full)
    return re.sub(r"[^\w. -]", lambda m: "@-" if m[0] == "/" else f"@{ord(m[0]):x}@", inner)


def _shapes(spark: SparkSession, paths: list[str], result: _Result,
            named: dict[str, str]) -> list[tuple[DataFrame, list[str]]]:
    """Tables of one shape with the file's name in ``BY``, and their files' names."""
    out = []
    csv = [p for p in paths if p.lower().endswith(".csv")]
    if csv:
        try:
            tables, missing = read_csv_files(spark, csv, BY)
        except PySparkException as exc:
            if len(csv) > 1:
                half = len(csv) // 2
                rest = [p for p in paths if p not in csv]
                return (_shapes(spark, csv[:half] + rest, result, named)
                        + _shapes(spark, csv[half:], result, named))
            tables, missing = [], {csv[0]: f"{type(exc).__name__}: {exc}"}
        for path, why in missing.items():
            result.refuse([named[path]], f"not processed, {why}")
        out += [(_with_names(df, named), [named[_known(p, named)] for p in files]) for df, files in tables]
    shapes: dict[str, list[str]] = {}
    for path in paths:
        if path not in csv:
            try:
                shapes.setdefault(_footer(spark, path), []).append(path)
            except Exception as exc:  # noqa: BLE001 - a broken file must not stop the feed
                result.refuse([named[path]], f"not processed, {type(exc).__name__}: {str(exc)[:500]}")
    for files in shapes.values():
        df = spark.read.parquet(*files)
        names = df.columns
        df = dedupe_column_names(df.select("*", F.col("_metadata.file_path").alias(BY))
                                 .toDF(*names, BY))
        out.append((_with_names(cells.nan_to_null(df), named), [named[f] for f in files]))
    return out


def _known(path: str, named: dict[str, str]) -> str:
    wanted = urlparse(path).path
    return next(p for p in named if urlparse(p).path == wanted)


def _with_names(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """File names in place of paths; at most ``files_per_batch`` of them."""
    pairs = [F.lit(x) for p, n in named.items() for x in (urlparse(p).path, n)]
    bare = F.regexp_replace(F.url_decode(F.replace(F.col(BY), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")
    scheme = F.when(F.col(BY).rlike("^[a-z0-9]+://[^/]"), F.regexp_replace(bare, "^/[^/]*", "")).otherwise(bare)
    return df.withColumn(BY, F.element_at(F.create_map(*pairs), scheme))


def _footer(spark: SparkSession, path: str) -> str:
    """A Parquet file's schema, from its footer alone."""
    jvm = spark._jvm
    _, where = files_under(spark, path)
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return str(reader.getFileMetaData().getSchema())
    finally:
        reader.close()


def process_batch(spark: SparkSession, paths: list[str], feed: Feed, batch_id: int) -> None:
    """Clean the files of one batch and write all that is known about them."""
    named = {p: _name(p, feed.landing) for p in paths}
    result = _Result()
    with Workspace(spark):
        for df, files in _shapes(spark, paths, result, named):
            if df.columns.count(BY) > 1:
                result.refuse(files, f"a column is named {BY}")
                continue
            _clean_shape(df, files, feed, result)
        _write(spark, feed, batch_id, result)


def _clean_shape(df: DataFrame, files: list[str], feed: Feed, result: _Result) -> None:
    """The files of one shape; if their table fails, halves of them."""
    try:
        source = stage(df, "feed")  # the files are parsed once, all passes read columns
        try:
            check_steps(feed.steps, [c for c in source.columns if c != BY], allow=True)
        except ValueError as exc:
            result.refuse(files, f"the steps need other columns: {exc}")
            result.sources.append((source, files))
            return
        found = _Result()
        for typed, mine in infer_types_by(source, BY, files):
            before = profile_by(typed, BY, mine)
            for branch in run_recipe_by(typed, BY, mine, feed.steps):
                _judge(Branch(stage(branch.df, "feed"), branch.groups, branch.runs), before, feed, found)
    except Exception as exc:  # noqa: BLE001 - a broken file must not stop the feed
        if len(files) == 1:
            result.refuse(files, f"not processed, {type(exc).__name__}: {str(exc)[:500]}")
            return
        for half in (files[:len(files) // 2], files[len(files) // 2:]):
            _clean_shape(df.where(F.col(BY).isin(half)), half, feed, result)
        return
    result.sources.append((source, files))
    result.status |= found.status
    for mine, theirs in ((result.audits, found.audits), (result.verdicts, found.verdicts),
                         (result.cleaned, found.cleaned)):
        mine += theirs


def _judge(branch: Branch, before: DataFrame, feed: Feed, result: _Result) -> None:
    """Verdicts, contract and status of every file of a branch."""
    spark, files = branch.df.sparkSession, branch.groups
    counted = {r[BY]: r["n"] for r in branch.df.groupBy(BY).agg(F.count(F.lit(1)).alias("n")).collect()}
    verdicts = verify_by(before.where(F.col("group").isin(files)),
                         profile_by(branch.df, BY, files), files).collect()
    reasons = {}
    for f in files:
        n_open = sum(r["group"] == f and r["verdict"] in OPEN_VERDICTS for r in verdicts)
        if n_open:
            reasons[f] = f"verdicts still open: {n_open}"
    if feed.contract is not None:
        broken: dict[str, list] = {}
        for r in validate(branch.df, feed.contract, BY, files).filter("not passed").collect():
            broken.setdefault(r["group"], []).append(r)
        for f, rules in broken.items():
            if f not in reasons:
                rules.sort(key=lambda r: (r["rule"], r["col"] or ""))
                reasons[f] = "broken rules: " + ", ".join(
                    f"{r['rule']} of {r['col'] or 'the table'} ({r['violations']})" for r in rules)
    for f in files:
        result.status[f] = ("quarantined" if f in reasons else "cleaned", reasons.get(f), counted.get(f, 0))
    result.verdicts.append(small_table(spark, [tuple(r) for r in verdicts], VERDICTS))
    result.audits.append(audit_by(branch.runs, BY, files, spark).withColumnRenamed("group", "file"))
    result.cleaned.append(branch)


def _write(spark: SparkSession, feed: Feed, batch_id: int, result: _Result) -> None:
    status = result.status
    for branch in result.cleaned:
        for folder, kind in ((feed.out, "cleaned"), (feed.quarantine, "quarantined")):
            mine = [f for f in branch.groups if status[f][0] == kind]
            if mine:
                (flat(branch.df.where(F.col(BY).isin(mine))).repartition(BY).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy(BY).option("header", True)
                 .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
                 .option("ignoreTrailingWhiteSpace", False).csv(folder))
    rejected = small_table(spark, [], REJECTED)
    for source, files in result.sources:
        gone = {f: status[f][1] for f in files if status[f][0] == "quarantined"}
        if gone:
            why = F.create_map(*[F.lit(x) for pair in gone.items() for x in pair])
            data = F.struct(*[F.col(f"`{c}`") for c in source.columns if c != BY])
            rejected = rejected.unionByName(source.where(F.col(BY).isin(list(gone))).select(
                F.col(BY).alias("file"), F.element_at(why, F.col(BY)).alias("reason"), F.to_json(data).alias("row")))
    _put(rejected, feed, "rejected", batch_id)
    _put(_all(spark, result.audits, "file string, " + AUDIT), feed, "audit", batch_id)
    _put(_all(spark, result.verdicts, VERDICTS), feed, "verdicts", batch_id)
    rows = [(f, *s) for f, s in sorted(status.items())]
    _put(small_table(spark, rows, LOG).coalesce(1), feed, "files", batch_id)
    write_text(spark, f"{feed.log}/commits/{batch_id}.json", json.dumps({
        "batch": batch_id, "files": [dict(zip(("file", "status", "reason", "rows"), r, strict=True)) for r in rows],
        "steps": len(feed.steps)}, ensure_ascii=False))


def _all(spark: SparkSession, tables: list[DataFrame], schema: str) -> DataFrame:
    out = small_table(spark, [], schema)
    for t in tables:
        out = out.unionByName(t)
    return out.coalesce(1)


def _put(df: DataFrame, feed: Feed, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").json(f"{feed.log}/{name}/batch={batch_id}")


def _committed(spark: SparkSession, log: str) -> list[int]:
    fs, where = files_under(spark, f"{log}/commits")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def feed_table(spark: SparkSession, log: str, name: str, schema: str) -> DataFrame:
    """One of the log's tables, of finished batches only."""
    done = _committed(spark, log)
    if not done:
        return small_table(spark, [], schema)
    return spark.read.schema(schema + ", batch bigint").json(f"{log}/{name}").where(
        F.col("batch").isin(done)).drop("batch")


def feed_log(spark: SparkSession, log: str) -> DataFrame:
    """``(file, status, reason, rows)`` of every file seen so far."""
    return feed_table(spark, log, "files", LOG)


def feed_audit(spark: SparkSession, log: str) -> DataFrame:
    return feed_table(spark, log, "audit", "file string, " + AUDIT)


def feed_verdicts(spark: SparkSession, log: str) -> DataFrame:
    return feed_table(spark, log, "verdicts", VERDICTS)


def feed_rejected(spark: SparkSession, log: str) -> DataFrame:
    """``(file, reason, row)``: the rows of rejected files as they came."""
    return feed_table(spark, log, "rejected", REJECTED)


def result_path(folder: str, file: str) -> str:
    return f"{folder}/{BY}={file}"
