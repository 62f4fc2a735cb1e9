"""Document fingerprints by MinHash.

A fingerprint is ``HASHES`` minima of universal hash permutations over a text's
five-word shingles, worked out in numpy, the upper 16 bits each, in hexadecimal; of two
fingerprints the share of equal minima estimates the Jaccard similarity.
:func:`similar_pairs` joins signature bands in Spark and verifies the Jaccard
similarity of the shingle sets; :func:`similar_classes` names what they connect.

The query compares each document with an edited text (its last half replaced by
the start of the next document) and with the next document itself.  "Next" needs
the order of ids: rows are dealt into ranges of ids, the first row of each range
is also sent to the range before it, and each task reads its range in order with
two texts in hand.  Texts cross the shuffle once.

Null counts as an empty text; an empty text has a fingerprint of its own, and
two texts without words are alike.  Rows of equal id follow each other by text;
null ids come first.  Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import small_table, stage
from .common import MinHasher, Shingler, map_groups, map_rows, table, tokens_of
from .graph import components

HASHES, BANDS = 128, 32
BLOCK = 256


class Fingerprinter:
    def __init__(self):
        self.shingles, self.minhash = Shingler(), MinHasher(HASHES, seed=7)

    def __call__(self, text: str | None) -> np.ndarray:
        return (self.minhash(self.shingles(text)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        fingerprint = Fingerprinter()
        return lambda ids, texts: (ids, [fingerprint(t).tobytes().hex() for t in texts])

    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, fingerprint string")


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  similarity: float = 0.75) -> DataFrame:
    """``a, b, jaccard``: verified links between different texts, each named by its
    least id; as many as connect every two texts that share a band and are similar.

    1. Every member of a bucket is verified against the bucket's least one.
    2. In buckets that still hold several components, members of different
       components are compared by their fingerprints, in cells of bounded size,
       and verified as long as they are not yet connected.

    So a bucket of any size yields no more links than it has members, and no link
    is lost but by the bands themselves.  That a pair's fingerprints agree in six
    standard deviations less than ``similarity`` is taken as not similar.
    Texts without words are linked with nothing.
    """
    texts = distinct_texts(df, id_col, text_col)
    ids = texts.select("node", "id")
    return links(texts, similarity).join(ids.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(
        ids.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b").select(
        F.col("ia").alias("a"), F.col("ib").alias("b"), "jaccard")


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: float = 0.75) -> DataFrame:
    """id and ``class_id`` of every row: the least id, null only if there is no
    other, of the texts that it is connected with by links."""
    texts = distinct_texts(df, id_col, text_col)
    roots = stage(components(links(texts, similarity).select("a", "b")), "roots")
    rooted = texts.select("node", "id").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    named = rooted.join(least, "root").select("node", "class_id")
    rows = df.select(F.col(id_col), F.sha2(F.col(text_col), 256).alias("node"))
    return rows.join(named, "node", "left").select(
        id_col, F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"))


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` (its digest), ``id`` (its least) and ``text`` of every distinct text."""
    found = df.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(
        F.min(id_col).alias("id"))
    return stage(found.select(F.sha2("text", 256).alias("node"), "id", "text"), "classes")


def links(texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b, jaccard``: the links of :func:`similar_pairs`, between nodes."""
    signed = stage(signatures(texts), "signatures")
    buckets = signed.select("node", F.posexplode_outer("keys").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(
        F.col("first") != F.col("last"))
    members = stage(buckets.join(shared.select("key", "first"), "key"), "members")
    led = members.where(F.col("node") != F.col("first")).select(
        F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    found = stage(verify(led, texts, similarity), "links")
    roots = stage(components(found), "roots")
    rest = stage(in_open_buckets(members, signed, roots, similarity), "candidates")
    if rest.isEmpty():
        return found
    return found.unionByName(stage(verify_cells(rest, texts, similarity), "links"))


def signatures(texts: DataFrame) -> DataFrame:
    """node, fingerprint and band keys of every text that has words."""
    def make():
        fingerprint = Fingerprinter()
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)

        def bands(nodes, texts):
            prints, keys = [], []
            for text in texts:
                f = fingerprint(text)
                key = salt.copy()
                for k in range(HASHES // BANDS):
                    key = (key ^ f[k::HASHES // BANDS].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(32)
                prints.append(f.tobytes() if tokens_of(text) else None)
                keys.append(key.view(np.int64))
            return nodes, prints, keys
        return bands

    return map_rows(texts.select("node", "text"), make,
                    "node string, print binary, keys array<long>").where("print is not null")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough, and ``jaccard``."""
    def make():
        shingles = Shingler()

        def check(a, b, text_a, text_b):
            return a, b, [jaccard(shingles(x), shingles(y)) for x, y in zip(text_a, text_b, strict=True)]
        return check

    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return map_rows(full.select("a", "b", "ta", "tb"), make, LINK).where(F.col("jaccard") >= similarity)


class Cell:
    """The members of two parts of one bucket, and the pairs that may be similar."""

    def __init__(self, cell: dict, rows: list, similarity: float):
        band, part, self.node, root, prints, keys = zip(*(r[:6] for r in rows), strict=True)
        self.whole = cell["i"] == cell["j"]
        part = np.array(part)
        self.left, self.right = (np.flatnonzero(part == cell[k]) for k in "ij")
        self.root = np.unique(np.array(root, object), return_inverse=True)[1]
        self.prints = np.frombuffer(b"".join(prints), np.uint16).reshape(len(rows), HASHES)
        self.earlier = np.array(keys, np.int64)[:, :band[0]]
        self.least = HASHES * (similarity - 6 * (similarity * (1 - similarity) / HASHES) ** 0.5)

    def pairs(self):
        """(member, the others it may be similar to, their equal minima)."""
        if self.root.max(initial=0) == 0:
            return
        for x in self.left:
            y = self.right[self.right > x] if self.whole else self.right
            y = y[self.root[y] != self.root[x]]
            if len(y):
                equal = (self.prints[y] == self.prints[x]).sum(axis=1)
                # a pair that meets in several buckets is compared in the first
                keep = (equal >= self.least) & ~(self.earlier[y] == self.earlier[x]).any(axis=1)
                if keep.any():
                    yield x, y[keep], equal[keep]


LINK = "a string, b string, jaccard double"
CELL = "cell struct<key:long,i:int,j:int>"
MEMBER = "band int, part int, node string, root string, print binary, keys array<long>"


def in_open_buckets(members: DataFrame, signed: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The members that must be compared, cell by cell, in the buckets that hold
    more than one component; dealt like those of op4."""
    rooted = members.join(roots, "node", "left").select(
        "key", "band", "node", F.coalesce("root", "node").alias("root"))
    open_keys = rooted.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where(
        "lo <> hi").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    rows = rooted.join(open_keys, "key").join(signed, "node").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.struct("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).alias("cell"),
        "band", "part", "node", "root", "print", "keys")

    def make():
        def asked(key, rows):
            needed = {k for x, y, _ in Cell(key, rows, similarity).pairs() for k in (x, *y)}
            return [(key, *rows[k]) for k in sorted(needed)]
        return asked

    return map_groups(cells, "cell", make, f"{CELL}, {MEMBER}")


def verify_cells(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified links of each cell: as many as connect what its similar pairs
    connect, the likeliest first."""
    def make():
        shingles = Shingler()

        def found(key, rows):
            cell = Cell(key, rows, similarity)
            sets = [shingles(r[-1]) for r in rows]
            head = list(range(int(cell.root.max()) + 1))  # components that have met here

            def find(x):
                while head[x] != x:
                    head[x] = x = head[head[x]]
                return x

            pairs = [(-e, x, y) for x, ys, equal in cell.pairs()
                     for y, e in zip(ys.tolist(), equal.tolist(), strict=True)]
            out = []
            for _, x, y in sorted(pairs):
                a, b = find(int(cell.root[x])), find(int(cell.root[y]))
                if a != b and (likeness := jaccard(sets[x], sets[y])) >= similarity:
                    head[a] = b
                    out.append((cell.node[x], cell.node[y], likeness))
            return out
        return found

    return map_groups(rows.join(texts.select("node", "text"), "node").select(
        "cell", "band", "part", "node", "root", "print", "keys", "text"), "cell", make, LINK)


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, tail, id, text``: ranges of ids, one after the other in its task,
    each in order and closed by a tail, a copy of the row that follows it."""
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in rows.approxQuantile(
        "id", [k / count for k in range(1, count)], 1 / (4 * count))})
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<long>")
    bucket = F.when(F.col("id").isNull(), 0).otherwise(
        F.size(F.filter(edges, lambda e: e <= F.col("id"))))
    dealt = rows.withColumn("bucket", bucket)
    # one row for each range, so as many as there are partitions
    order = F.struct(F.col("id").isNotNull(), "id", F.col("text"))
    firsts = dealt.groupBy("bucket").agg(F.min(order).alias("f")).select(
        "bucket", F.col("f.id").alias("id"), F.xxhash64("f.text").alias("dg")).orderBy("bucket").collect()
    tails = small_table(spark, [(r["bucket"], r["id"], r["dg"], firsts[k - 1]["bucket"])
                                for k, r in enumerate(firsts)], "b int, i long, dg long, before int")
    first = (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("i")) & (
        F.xxhash64("text") == F.col("dg"))
    sent = dealt.join(F.broadcast(tails), first, "left").select("id", "text", F.explode_outer(F.array_compact(F.array(
        F.struct("bucket", F.lit(0).alias("tail")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail")))
    ))).alias("to"))
    return sent.select("to.bucket", "to.tail", "id", "text").repartitionByRange(
        count, "bucket").sortWithinPartitions("bucket", "tail", "id", "text")


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its fingerprint, its edited text's digest and fingerprint,
    and its likeness to that and to the next row."""
    fields = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    arrow = to_arrow_schema(T.StructType.fromDDL(f"id long, {fields}"))

    def run(batches):
        fingerprint = Fingerprinter()
        last = None
        for batch in batches:
            out = []
            for _, tail, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and last is None:
                    continue  # a repeat of the row that closed the range
                own = fingerprint(text)
                if last is not None:
                    before, last_text, last_print = last
                    half = len(last_text) // 2
                    edited = last_text[:len(last_text) - half] + text[:half]
                    edited_print = fingerprint(edited)
                    out.append((before, len(last_text), hashlib.sha256(edited.encode()).hexdigest(),
                                last_print.tobytes().hex(), edited_print.tobytes().hex(),
                                likeness(last_print, edited_print), likeness(last_print, own)))
                last = None if tail else (i, text, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=arrow.field(k).type) for k, c in enumerate(zip(*out, strict=True))],
                    schema=arrow)

    kind = df.schema[id_col].dataType
    return in_order(df, id_col, text_col).mapInArrow(run, f"id long, {fields}").select(
        F.col("id").cast(kind).alias(id_col), *[f.split()[0] for f in fields.split(", ")])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
