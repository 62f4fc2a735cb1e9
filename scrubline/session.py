"""Session settings and tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
TASK_BYTES = 16 << 20
_TASK_INPUT = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    Python call sites in error messages are off: recording them takes longer
    than building the plans, which hold hundreds of columns.
    """
    return prepare_session(
        SparkSession.builder.master(f"local[{cores}]").appName("scrubline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate())


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the results rely on: one time zone, adaptive execution.

    A task reads ``TASK_BYTES`` of a file or a shuffle at most, as far as these
    are cut so finely, less if the session says so: its hash tables stay small
    on large tables, where there are more tasks instead of larger ones.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name in _TASK_INPUT:
        if to_bytes(spark.conf.get(name)) > TASK_BYTES:
            spark.conf.set(name, str(TASK_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be out of reach of the executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scrubline-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_OWNER: ContextVar[Workspace | None] = ContextVar("workspace", default=None)


class Workspace:
    """Owner of the tables that are staged while it is open.

    ``with Workspace(spark) as work:`` deletes at its end, also after an error,
    every folder that ``stage`` wrote inside the block, but for what ``keep``
    named; those pass to the enclosing workspace if there is one.  A folder is
    known before its first byte is written, so a write that fails leaves nothing.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.kept = spark, [], set()
        self._token = None

    def __enter__(self) -> Workspace:
        self._outer = _OWNER.get()
        self._token = _OWNER.set(self)
        return self

    def keep(self, staged: DataFrame) -> DataFrame:
        """A staged table that outlives the block."""
        self.kept.update(_folder_names(staged))
        return staged

    def result(self, df: DataFrame, label: str = "result") -> DataFrame:
        """Write a result that is still a plan over staged tables, and keep it."""
        path = new_folder(self.spark, label)
        self.kept.add(path.rsplit("/", 1)[1])
        return _write(df, path)

    def __exit__(self, *error) -> None:
        _OWNER.reset(self._token)
        for folder in self.folders:
            if folder.rsplit("/", 1)[1] not in self.kept:
                delete_folder(self.spark, folder)
            elif self._outer is not None:
                self._outer.folders.append(folder)
        self.folders.clear()


def _folder_names(staged: DataFrame) -> set[str]:
    return {f.rsplit("/", 2)[1] for f in staged.inputFiles()}


def _write(df: DataFrame, path: str) -> DataFrame:
    owner = _OWNER.get()
    if owner is not None:
        owner.folders.append(path)
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, "false")
    conf.set(_FREE_SHUFFLES, "true")  # what was shuffled for the copy goes when it is written
    try:
        df.write.parquet(path)
    finally:
        conf.set(_FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a table once and go on from the written copy.

    Cuts the lineage in a way that survives lost executors, and gives later
    passes columnar files to read only their columns from.  The copy belongs to
    the open ``Workspace``; without one, the caller deletes it.
    """
    return _write(df, new_folder(df.sparkSession, label))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A broadcast hint if, and only if, the table was counted to be small.

    At most ``BROADCAST_ROWS`` + 1 rows are looked at.  A larger table comes
    back without a hint, to be joined by shuffle.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.select(size.alias("b")).limit(BROADCAST_ROWS + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")).first()
    small = seen["rows"] <= BROADCAST_ROWS and seen["bytes"] <= BROADCAST_BYTES
    return F.broadcast(df) if small else df


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, on whatever file system the path names."""
    fs, where = files_under(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def small_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A few driver rows as a local relation, which the optimizer can fold and
    size without running a job."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    pairs = [isinstance(f.dataType, T.MapType) for f in schema.fields]
    columns = [
        pa.array([list(r[i].items()) if pair and r[i] is not None else r[i] for r in rows],
                 type=arrow.field(i).type)
        for i, pair in enumerate(pairs)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def files_under(spark: SparkSession, path: str):
    """The Hadoop file system and path objects of ``path``."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(staged: DataFrame) -> None:
    """Delete the folder behind a staged table."""
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        delete_folder(staged.sparkSession, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    fs, where = files_under(spark, folder)
    fs.delete(where, True)
