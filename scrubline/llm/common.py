"""Small helpers of the operators in this folder.

Words and tokens are cut on bytes: ``bytes.lower`` changes A-Z alone and
``bytes.split`` cuts at x20 and x09-x0D alone, which is what the contracts say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import prepare_session

SHINGLE_WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Python batches hold at most 1,000 rows."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text: str | None) -> list[bytes]:
    """The lower-cased tokens of a text; null has none."""
    return text.encode().lower().split() if text else []


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a batch's columns to output columns.

    ``make`` runs once in each task and returns a function that takes the
    columns as lists and returns lists or arrays, one for each output field.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if batch.num_rows:
                columns = function(*[c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)],
                    schema=arrow)

    return df.mapInArrow(run, fields)


def map_groups(df: DataFrame, key: str, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``function(key, rows) -> rows`` over groups that are known to be small.

    Groups are shuffled and sorted by ``key``, then streamed, so that many small
    groups share a batch.  Rows are lists of the other columns, in their order.
    """
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        current, rows = None, []

        def out(found):
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        for batch in batches:
            found = []
            keys, *columns = (c.to_pylist() for c in batch.columns)
            for k, *row in zip(keys, *columns, strict=True):
                if k != current:
                    if rows:
                        found += function(current, rows)
                    current, rows = k, []
                rows.append(row)
            if found:
                yield out(found)
        if rows and (found := function(current, rows)):
            yield out(found)

    others = [c for c in df.columns if c != key]
    sorted_rows = df.select(key, *others).repartition(key).sortWithinPartitions(key)
    return sorted_rows.mapInArrow(run, fields)


class Bounded(dict):
    """A cache that is emptied when it holds ``most`` entries; keys of over
    ``longest`` characters or bytes are worked out anew each time."""

    def __init__(self, function: Callable, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes.

    ``size`` words make a shingle; a text of fewer words is one shingle; a text
    without words has none.
    """

    def __init__(self, size: int = SHINGLE_WORDS):
        self.size = size
        self.hashes = Bounded(xxhash.xxh64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = tokens_of(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.size + 1
        out = h[:n].copy()
        for k in range(1, self.size):
            out *= _STEP
            out += h[k:k + n]
            out ^= out >> _SHIFT
        out *= _MIX
        out ^= out >> _SHIFT
        return np.unique(out)


class MinHasher:
    """``count`` universal hash permutations; the minimum of each over a set."""

    BLOCK = 512

    def __init__(self, count: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, count, np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), self.BLOCK):
            x = np.multiply.outer(self.a, shingles[i:i + self.BLOCK])
            x += self.b[:, None]
            np.minimum(low, x.min(axis=1), out=low)
        return low
