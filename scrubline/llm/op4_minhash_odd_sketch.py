"""Near-duplicate classes: banded MinHash, odd sketches, exact verification.

1. Every text gets its shingle set's size and digest, ``HASHES`` MinHash values
   folded into ``BANDS`` band keys, and an odd sketch: each (position, value)
   flips one of 512 bits, so the XOR of two sketches holds the samples in which
   they differ, and its population count estimates a high similarity closely.
2. Rows of equal digest are one class; classes, not copies, go on.
3. In each bucket (classes with one band key) every member is a candidate with
   the bucket's least member.  Candidates pass by size and by sketch and are
   then verified on the full sets; verified links make components.
4. A bucket whose members now lie in one component is done.  In the others, all
   members of different components are compared by their sketches, in cells of
   bounded size; what passes is verified like before.
   So no bucket is capped and no link between different texts is lost but by the
   bands themselves: at a similarity of 0.75, 32 bands of 4 miss 5 pairs in a
   million, the sketch fewer.

Empty and null texts have no shingles and are linked with nothing.  Rows with
equal texts are one class and so linked, rows that repeat a doc_id come back as
often as they stand.  A null doc_id takes part; the component's id is its least
non-null doc_id (null if it has none).  Other columns are left out.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from .common import MinHasher, Shingler, map_groups, map_rows, table
from .graph import components

HASHES, BANDS = 128, 32
SKETCH_BITS = 512
SIMILARITY = (75, 100)
#: Sketches that estimate less than this are no candidates: 0.75 less six
#: standard deviations of 128 samples.
LEAST_ESTIMATE = 0.5
BLOCK = 256


def most_odd_bits(estimate: float, hashes: int = HASHES, bits: int = SKETCH_BITS) -> int:
    """The odd bits that two sketches of this similarity differ in."""
    differing = 2 * hashes * (1 - estimate)
    return int(bits / 2 * (1 - (1 - 2 / bits) ** differing)) + 1


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """``SKETCH_BITS`` parity bits, as 64-bit words."""
    x = minima + np.arange(1, len(minima) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    bit = np.bincount((x % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, dg (the text's digest), n, node (digest of the set; null without
    shingles), bands, sketch."""
    def make():
        shingles, minhash = Shingler(), MinHasher(HASHES)
        rows = HASHES // BANDS
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

        def sign(ids, texts, digests):
            sizes, nodes, bands, sketches = [], [], [], []
            for text in texts:
                s = shingles(text)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None), bands.append(None), sketches.append(None)
                    continue
                low = minhash(s)
                key = salt.copy()
                for k in range(rows):
                    key = (key ^ low[k::rows]) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(32)
                nodes.append(xxhash.xxh128_digest(s.tobytes()))
                bands.append(key.view(np.int64))
                sketches.append(odd_sketch(low))
            return ids, digests, sizes, nodes, bands, sketches
        return sign

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col, F.xxhash64(text_col)), make,
                    f"id {kind}, dg long, n long, node binary, bands array<long>, sketch array<long>")


def differing_bits(a: str, b: str) -> Column:
    return reduce(add, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
                        for k in range(SKETCH_BITS // 64)])


def sizes_allow(a: str, b: str) -> Column:
    """No pair whose sizes differ more can reach the similarity."""
    return F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]


class Cell:
    """The members of two parts of one bucket, and the pairs that must be verified."""

    def __init__(self, cell: dict, rows: list):
        band, part, self.node, root, n, sketch, bands = zip(*(r[:7] for r in rows), strict=True)
        self.whole = cell["i"] == cell["j"]
        part = np.array(part)
        self.left, self.right = (np.flatnonzero(part == cell[k]) for k in "ij")
        self.root = np.unique(np.array(root, object), return_inverse=True)[1]
        self.n = np.array(n)
        self.sketch = np.array(sketch, np.int64).view(np.uint64)
        self.earlier = np.array(bands, np.int64)[:, :band[0]]

    def pairs(self, most: int):
        """(member, the others it may be similar to, their odd bits)."""
        num, den = SIMILARITY
        if self.root.max(initial=0) == 0:
            return
        for x in self.left:
            y = self.right[self.right > x] if self.whole else self.right
            y = y[self.root[y] != self.root[x]]
            y = y[np.minimum(self.n[y], self.n[x]) * den >= np.maximum(self.n[y], self.n[x]) * num]
            if len(y):
                odd = np.bitwise_count(self.sketch[y] ^ self.sketch[x]).sum(axis=1)
                keep = (odd <= most) & ~(self.earlier[y] == self.earlier[x]).any(axis=1)
                if keep.any():
                    yield x, y[keep], odd[keep]


def in_open_buckets(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The members that must be compared, cell by cell, in the buckets that hold
    more than one component.

    A bucket is dealt into parts of about ``BLOCK`` members and a cell holds one
    pair of parts, so it never has more than two parts' members.  A pair that
    meets in several buckets is compared in the first of them alone.  Members
    without any candidate in their cell drop out here.
    """
    rooted = members.join(roots, "node", "left").select(
        "key", "band", "node", F.coalesce("root", "node").alias("root"))
    open_keys = rooted.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where(
        "lo <> hi").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    # written first, like every aggregate here that is joined on by its key: only
    # then is a hot key's side split
    rows = rooted.join(broadcast_if_small(stage(open_keys, "open")), "key").join(
        classes.select("node", "n", "sketch", "bands"), "node").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.struct("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).alias("cell"),
        "band", "part", "node", "root", "n", "sketch", "bands")
    most = most_odd_bits(LEAST_ESTIMATE)

    def make():
        def asked(key, rows):
            needed = {k for x, y, _ in Cell(key, rows).pairs(most) for k in (x, *y)}
            return [(key, *rows[k]) for k in sorted(needed)]
        return asked

    return map_groups(cells, "cell", make, f"{CELL}, {MEMBER}")


CELL = "cell struct<key:long,i:int,j:int>"
MEMBER = "band int, part int, node binary, root binary, n long, sketch array<long>, bands array<long>"


def verify_cells(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of each cell: as many as connect what its similar pairs
    connect.  Pairs never leave their cell; the likeliest are verified first and
    those already connected not at all."""
    num, den = SIMILARITY
    most = most_odd_bits(LEAST_ESTIMATE)

    def make():
        shingles = Shingler()

        def links(key, rows):
            cell = Cell(key, rows)
            texts = [r[-1] for r in rows]
            made: dict[int, np.ndarray] = {}  # eight bytes a shingle, of members that are verified

            def full_set(x):
                if x not in made:
                    made[x] = shingles(texts[x])
                return made[x]

            head = list(range(int(cell.root.max()) + 1))  # components that have met here

            def find(x):
                while head[x] != x:
                    head[x] = x = head[head[x]]
                return x

            pairs = [(o, x, y) for x, ys, odd in cell.pairs(most)
                     for y, o in zip(ys.tolist(), odd.tolist(), strict=True)]
            found = []
            for _, x, y in sorted(pairs):
                a, b = find(int(cell.root[x])), find(int(cell.root[y]))
                if a != b:
                    sx, sy = full_set(x), full_set(y)
                    both = len(np.intersect1d(sx, sy, assume_unique=True))
                    if den * both >= num * (len(sx) + len(sy) - both):
                        head[a] = b
                        found.append((cell.node[x], cell.node[y]))
            return found
        return links

    return map_groups(rows.join(texts, "node").select(
        "cell", "band", "part", "node", "root", "n", "sketch", "bands", "text"), "cell", make,
        "a binary, b binary")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""
    num, den = SIMILARITY

    def make():
        shingles = Shingler()
        last: list = [None, None]

        def similar(a, b, text_a, text_b):
            out_a, out_b = [], []
            for x, y, tx, ty in zip(a, b, text_a, text_b, strict=True):
                if last[0] != y:
                    last[:] = [y, shingles(ty)]
                sx, sy = shingles(tx), last[1]
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                if den * both >= num * (len(sx) + len(sy) - both):
                    out_a.append(x), out_b.append(y)
            return out_a, out_b
        return similar

    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return map_rows(full.select("a", "b", "text_a", "text_b"), make, "a binary, b binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    return classify(df, id_col, text_col).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, with all its columns, of each component, the one of the least
    id (null ids last) and then the least digest; documents without shingles all
    stay.  Of rows that repeat id and text one stays."""
    found = stage(classify(df, id_col, text_col).select("id", "dg", "root"), "classified")
    order = F.struct(F.col("id").isNull(), "id", "dg")
    least = found.where("root is not null").groupBy("root").agg(
        F.min(order).alias("least"), F.max(order).alias("most")).where("least <> most").select(
        "root", F.col("least.id").alias("near id"), F.col("least.dg").alias("near dg"))
    least = broadcast_if_small(stage(least, "kept"))
    gone = broadcast_if_small(stage(found.join(least, "root").where(
        ~(F.col("id").eqNullSafe(F.col("near id")) & (F.col("dg") == F.col("near dg")))).select(
        F.col("id").alias("near id"), F.col("dg").alias("near dg")).distinct(), "removed"))
    same = gone["near id"].eqNullSafe(df[id_col]) & (gone["near dg"] == F.xxhash64(df[text_col]))
    left = df.join(gone, same, "left_anti")
    repeated = found.groupBy("id", "dg").count().where("count > 1").join(
        gone, gone["near id"].eqNullSafe(F.col("id")) & (gone["near dg"] == F.col("dg")), "left_anti")
    return left if repeated.isEmpty() else left.dropDuplicates([id_col, text_col])


def classify(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, dg, n_shingles, component_id, root (the component's own name; null
    without shingles) and kept of every row."""
    signed = stage(signatures(df, id_col, text_col), "signatures")
    classes = stage(signed.where("node is not null").groupBy("node").agg(
        F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")), "classes")

    buckets = classes.select("node", F.posexplode_outer("bands").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where(
        F.col("first") != F.col("last")).select("key", "first")
    members = stage(buckets.join(broadcast_if_small(stage(shared, "shared")), "key"), "members")
    led = members.where(F.col("node") != F.col("first")).select(
        F.col("node").alias("a"), F.col("first").alias("b")).distinct()

    def side(name):
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"),
                              F.col("sketch").alias(f"s_{name}"))

    led = stage(led.join(side("a"), "a").join(side("b"), "b").where(
        sizes_allow("n_a", "n_b") & (differing_bits("s_a", "s_b") <= most_odd_bits(LEAST_ESTIMATE))
    ).select("a", "b"), "candidates")

    # one text for each class that is a candidate
    def texts_of(asked):
        asked = asked.distinct()
        # rows of one id with different texts both come; the digest tells them apart
        ids = classes.select("node", F.col("low").alias("id")).join(asked, "node")
        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        rows = rows.join(ids.withColumnRenamed("id", "_low"), F.col("id").eqNullSafe(F.col("_low")))
        return stage(own_text(rows.select("node", "text")), "texts")

    links = stage(verify(led, texts_of(led.select(F.explode(F.array("a", "b")).alias("node")))), "links")
    roots = stage(components(links), "roots")
    rest = stage(in_open_buckets(members, classes, roots), "candidates")
    if not rest.isEmpty():
        links = links.unionByName(stage(verify_cells(rest, texts_of(rest.select("node"))), "links"))
        roots = stage(components(links), "roots")

    rooted = classes.select("node", "low").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    lows = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    found = stage(rooted.join(broadcast_if_small(lows), "root").select("node", "component_id", "root"), "found")
    alone = signed.where("node is null").select(
        "id", "dg", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"),
        F.lit(None).cast("binary").alias("root"))
    linked = signed.where("node is not null").join(found, "node").select(
        "id", "dg", F.col("n").alias("n_shingles"), "component_id", "root")
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def own_text(rows: DataFrame) -> DataFrame:
    """The rows ``node, text`` whose text has the digest ``node``, once each."""
    def make():
        shingles = Shingler()

        def keep(nodes, texts):
            own = [(n, t) for n, t in zip(nodes, texts, strict=True)
                   if xxhash.xxh128_digest(shingles(t).tobytes()) == n]
            return [o[0] for o in own], [o[1] for o in own]
        return keep

    return map_rows(rows, make, "node binary, text string").dropDuplicates(["node"])


def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SETS = """
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1)"""
OP4_SQL = f"""
WITH RECURSIVE {_SETS},
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""
