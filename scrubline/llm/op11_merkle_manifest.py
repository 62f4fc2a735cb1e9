"""A Merkle manifest of a dataset, and proofs read from it by descent.

A row is a leaf, ``H`` of its fields with their lengths.  In each source the
leaves ascend by id; every ``ARITY`` consecutive nodes become their ``H``, until
one is left, the subroot; subroots, ordered by source, likewise give the root.

1. Leaves are numbered in their order by a range partitioning and per-partition
   offsets; no task sorts a whole source.  A node is named by the number of its
   first leaf, so that names stay unique from level to level.
2. Up: a task takes a run of ``ARITY ** LEVELS`` nodes of a source and stores the
   records of its subtree, digest to children.  Passes go on with the runs' tops:
   five levels a pass, so three passes for a source of a million rows.
3. Down: a request is a leaf with its number.  It enters at the root; at each
   record the next digit of its number (base ``ARITY``) picks a child, the others
   are collected, and the descent goes on in the child's record.  Requests of a
   run share what lies above it, so they descend to the run once.  The collected
   segments, turned round, are the proof from leaf to root.

A group holds at most 243 nodes, 364 records and one path, whatever a source
holds.  Every pass is written, so a lost executor costs one pass.

Null fields are ``-``; a null id comes first in its source, a null source before
all others.  Rows of equal id are ordered by leaf; fully equal rows are
interchangeable leaves with places of their own.  A row without an id is never
tampered with.  An empty table has no leaves and gives no rows; other columns
are left out.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Workspace, broadcast_if_small, stage
from .common import map_groups, table

ARITY = 3
LEVELS = 5
RUN = ARITY ** LEVELS
SIZE = 32  # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(children: list[bytes]) -> bytes:
    """``H`` of digests: they go in as hex text, one after the other."""
    return sha256(b"".join(children).hex().encode()).digest()


def _split(digests: bytes) -> list[bytes]:
    return [digests[k:k + SIZE] for k in range(0, len(digests), SIZE)]


def leaf_digest(fields: list[Column]) -> Column:
    """Binary ``H`` of a row's fields."""
    parts = []
    for c in fields:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
           source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id, source, leaf, tampered, line``: one row per row of ``docs``.

    ``tampered`` is the leaf without the text's line feeds where 2 divides the
    id's checksum, else null.
    """
    columns = [F.col(f"`{c}`") for c in fields]
    bare = [F.replace(F.col(f"`{c}`"), F.lit("\n"), F.lit("")) if c == text_col else F.col(f"`{c}`")
            for c in fields]
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf_digest(columns).alias("leaf"),
        F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, leaf_digest(bare)).alias("tampered"),
        F.monotonically_increasing_id().alias("line"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``place``, 0, 1, ... in the given order.

    Rows are range partitioned; a partition's offset is the rows before it, from
    one row per partition.
    """
    sorted_rows = stage(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
                        .withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    heads = sorted_rows.groupBy(part.alias("part")).agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n"))
    # one row per partition of the shuffle, so one task and a broadcast will do
    before = heads.select("part", "head", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (sorted_rows.withColumn("part", part).join(F.broadcast(before), "part")
            .withColumn("place", F.col("at") - F.col("head") + F.col("before")).drop("at", "head", "before", "part"))


def _run_of(level: int) -> Column:
    """The run of a node: the number of the first leaf below it."""
    wide = RUN ** (level + 1)
    return F.col("g") + F.floor((F.col("at") - F.col("g")) / F.lit(wide)).cast("bigint") * F.lit(wide) \
        if wide < 2**53 else F.col("g")


def climb(rows: list[tuple]) -> tuple[list[tuple[bytes, bytes]], bytes]:
    """Records ``(digest, children)`` of one run's subtree, and its top."""
    nodes, n = [d for _, d in rows], rows[0][0]
    records = []
    for _ in range(LEVELS):
        if n == 1:  # the source ends here, the subtree is the whole tree
            break
        parts = [nodes[k:k + ARITY] for k in range(0, len(nodes), ARITY)]
        nodes = [digest_of(p) for p in parts]
        records += [(d, b"".join(p)) for d, p in zip(nodes, parts, strict=True)]
        n = -(-n // ARITY)
    return records, nodes[0]


RECORDS = "run long, g long, n long, digest binary, children binary, top boolean"


def store(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The digest-to-children records of every tree, a table for each pass, and
    the nodes that entered each pass: ``at, g, n, digest``."""
    passes, entered = [], [nodes]
    while not entered[-1].where("n > 1").isEmpty():
        level = len(passes)

        def make():
            def up(run, rows):
                rows.sort()  # by place
                g, n = rows[0][1], rows[0][2]
                records, top = climb([(n, d) for _, _, _, d in rows])
                left = -(-n // RUN)
                seen = dict.fromkeys(records)  # equal subtrees have one record
                return [(run, g, left, d, c, False) for d, c in seen] + [(run, g, left, top, None, True)]
            return up

        grouped = entered[-1].where("n > 1").select(_run_of(level).alias("run"), "at", "g", "n", "digest")
        written = stage(map_groups(grouped, "run", make, RECORDS), "records")
        passes.append(written.where("not top"))
        entered.append(written.where("top").select(F.col("run").alias("at"), "g", "n", "digest"))
    return passes, entered


def subroots(entered: list[DataFrame]) -> DataFrame:
    """``g, subroot``: what is left of every tree."""
    out = entered[0].where("n = 1").select("g", "digest")
    for more in entered[1:]:
        out = out.unionByName(more.where("n = 1").select("g", "digest"))
    return out.withColumnRenamed("digest", "subroot")


def descend(records: dict[bytes, bytes], top: bytes, digits: list[int], leaf: bytes) -> list[bytes]:
    """Segments of the path from ``top``, turned round to run from the leaf up:
    the digit as one byte, then the children that were not picked."""
    path, at = [], top
    for digit in digits:
        children = _split(records[at])
        at = children.pop(digit)
        path.append(bytes([digit]) + b"".join(children))
    if at != leaf:
        raise ValueError("the manifest does not lead to this leaf")
    return path[::-1]


def digits_of(place: int, n: int) -> list[int]:
    """Digits of a place in a run below ``n`` nodes, the topmost first."""
    out = []
    while n > 1 and len(out) < LEVELS:
        out.append(place % ARITY)
        place, n = place // ARITY, -(-n // ARITY)
    return out[::-1]


def fold(digest: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its proof lead to."""
    for segment in path:
        siblings = _split(segment[1:])
        digest = digest_of(siblings[:segment[0]] + [digest] + siblings[segment[0]:])
    return digest


def proof_digest(path: list[bytes]) -> str:
    return sha256(b"".join(s[1:] for s in path).hex().encode()).hexdigest()


#: What meets in a run: its records, the path above it, the nodes asked for.
_UNION = ("run long, kind int, at long, g long, n long, digest binary, children binary, "
          "path array<binary>")


def _as_union(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
    given = {"kind": F.lit(kind), **columns}
    out = []
    for part in _UNION.split(", "):
        name, type_ = part.split(" ", 1)
        out.append(given.get(name, F.lit(None)).cast(type_).alias(name))
    return df.select(*out)


def _requests(rows: list) -> tuple:
    """The rows of one run, told apart: records, where the descent enters the
    run and what lies above it, and the nodes asked for."""
    records, entry, asked = {}, None, []
    for kind, *row in rows:
        if kind == 0:
            records[row[3]] = row[4]
        elif kind == 1:
            entry = row[3], row[5]
        else:
            asked.append(row)
    return records, entry, asked


def paths(passes: list[DataFrame], entered: list[DataFrame], above: DataFrame,
          last: DataFrame, make_last, schema: str) -> DataFrame:
    """Descend from ``above`` (``g, digest, path``: every tree's top and what lies
    over it) pass by pass.

    ``last`` are the requests of the lowest pass (kind 2 of the union), whose
    groups are handed to ``make_last``; requests of the passes above are the runs
    themselves.
    """
    start = above.select(F.col("g").alias("at"), "digest", "path")

    def enter(start: DataFrame) -> DataFrame:
        return _as_union(start, 1, run=F.col("at"), digest=F.col("digest"), path=F.col("path"))

    def known(records: DataFrame) -> DataFrame:
        return _as_union(records, 0, **{c: F.col(c) for c in ("run", "digest", "children")})

    for level in range(len(passes) - 1, 0, -1):
        asked = entered[level].where("n > 1")
        rows = known(passes[level]).unionByName(enter(start)).unionByName(_as_union(
            asked, 2, run=_run_of(level), **{c: F.col(c) for c in ("at", "g", "n", "digest")}))

        def make(width=RUN ** level):
            def down(run, rows):
                records, (top, above), asked = _requests(rows)
                if not asked:  # the top of a smaller tree, wanted further down
                    return [(run, top, above)]
                return [(at, d, descend(records, top, digits_of((at - run) // width, n), d) + above)
                        for at, _, n, d, *_ in asked]
            return down

        start = stage(map_groups(rows, "run", make, "at long, digest binary, path array<binary>"), "paths")
    lowest = enter(start).unionByName(last)
    if passes:
        lowest = lowest.unionByName(known(passes[0]))
    return map_groups(lowest, "run", make_last, schema)


def _plain_paths():
    def down(run, rows):
        records, (top, above), asked = _requests(rows)
        return [(at, descend(records, top, digits_of(at - run, n), d) + above) for at, _, n, d, *_ in asked]
    return down


def _proofs():
    """The answers of a run's requests: proof, and root by the leaf as it is now."""
    def down(run, rows):
        records, (top, above), asked = _requests(rows)
        roots: dict[bytes, bytes] = {}  # paths of a run end alike

        def folded(digest: bytes, path: list[bytes]) -> bytes:
            here = fold(digest, path[:len(path) - len(above)])
            if here not in roots:
                roots[here] = fold(here, above)
            return roots[here]

        out = []
        for at, _, n, digest, tampered, *_ in asked:
            path = descend(records, top, digits_of(at - run, n), digest) + above
            out.append((at, proof_digest(path), folded(tampered or digest, path)))
        return out
    return down


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
             source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    rows = stage(numbered(stage(leaves(docs, fields, id_col, source_col, text_col), "leaves"),
                          "source", "id", "leaf", "line").drop("line"), "leaves")
    sources = stage(rows.groupBy("source").agg(F.min("place").alias("g"), F.count(F.lit(1)).alias("n")), "sources")
    known = broadcast_if_small(sources.withColumnRenamed("source", "of"))
    placed = stage(rows.join(known, F.col("source").eqNullSafe(F.col("of")))
                   .select("id", "g", "n", F.col("place").alias("at"), "leaf", "tampered"), "leaves")
    passes, entered = store(placed.select("at", "g", "n", F.col("leaf").alias("digest")))

    ends = stage(subroots(entered), "subroots")
    total = F.lit(sources.count())
    top_nodes = stage(numbered(ends, "g").select(
        F.col("place").alias("at"), F.lit(0).cast("bigint").alias("g"), total.cast("bigint").alias("n"),
        F.col("subroot").alias("digest"), F.col("g").alias("tree")), "subroots")
    top_passes, top_entered = store(top_nodes.select("at", "g", "n", "digest"))
    root = subroots(top_entered).first()
    nothing = F.array().cast("array<binary>")
    single = subroots(top_entered).select("g", F.col("subroot").alias("digest"), nothing.alias("path"))
    asked = _as_union(top_nodes, 2, run=_run_of(0), **{c: F.col(c) for c in ("at", "g", "n", "digest")})
    over = paths(top_passes, top_entered, single, asked, _plain_paths, "at long, path array<binary>")
    over = stage(over.join(top_nodes.select("at", "tree", "digest"), "at")
                 .select(F.col("tree").alias("g"), "digest", "path"), "paths")

    wanted = _as_union(placed, 2, run=_run_of(0), at=F.col("at"), g=F.col("g"), n=F.col("n"),
                       digest=F.col("leaf"), children=F.col("tampered"))
    proofs = stage(paths(passes, entered, over, wanted, _proofs, "at long, proof string, folded binary"), "proofs")
    end = broadcast_if_small(ends)

    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    whole = F.lit(root["subroot"].hex() if root else None)
    return (placed.join(proofs, "at").join(end, "g").select(
        F.col("id").alias(id_col), text("leaf").alias("leaf"), text("subroot").alias("subroot"),
        whole.alias("root"), F.col("proof").alias("proof_sha256"), text("folded").alias("folded_root"),
        (text("folded") == whole).alias("verified")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark) as work:
        return work.result(manifest(table(spark, sf_dir, "documents")), "op11")


def _field(c: str) -> str:
    return f"coalesce(strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '-')"


_LEAF = " || ".join(_field(c) for c in FIELDS)
_BARE = " || ".join(_field("replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS)
#: One step of the checksum's register for each of a byte's bits.
_CRC = """list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id AS varchar), ''),
    lambda ch: [ascii(ch) + 0::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::bigint) ELSE a >> 1 END)"""
OP11_SQL = f"""
WITH RECURSIVE l AS MATERIALIZED (
    SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256({_LEAF})) - 1 AS place,
        count(*) OVER (PARTITION BY source) AS n, sha256({_LEAF}) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 1 THEN sha256({_BARE}) ELSE sha256({_LEAF}) END AS now
    FROM documents),
t AS (SELECT tree, 0 AS lev, place AS i, n, leaf AS d FROM l
    UNION ALL
    SELECT tree, lev + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1
    GROUP BY tree, lev, i // 3, n),
s AS (SELECT tree, max(lev) AS height, max(d) FILTER (WHERE n = 1) AS subroot FROM t GROUP BY tree),
u AS (SELECT 0 AS lev, tree AS i, (SELECT count(*) FROM s) AS n, subroot AS d FROM s
    UNION ALL
    SELECT lev + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1
    GROUP BY lev, i // 3, n),
q AS (SELECT lev, i, n, d FROM u WHERE n > 1),
f AS (SELECT tree, place, 0 AS lev, place AS i, n, 0 AS above, now AS d, '' AS proof FROM l
    UNION ALL
    SELECT tree, place, lev, i, n, above, d, proof FROM (
        SELECT f.tree, f.place, f.lev + 1 AS lev, f.i // 3 AS i, (f.n + 2) // 3 AS n, f.above,
            sha256(string_agg(CASE WHEN t.i = f.i THEN f.d ELSE t.d END, '' ORDER BY t.i)) AS d,
            f.proof || coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (WHERE t.i <> f.i), '') AS proof
        FROM f JOIN t ON t.tree = f.tree AND t.lev = f.lev AND t.i // 3 = f.i // 3
        WHERE f.above = 0 AND f.n > 1 GROUP BY f.tree, f.place, f.lev, f.i, f.n, f.above, f.proof
        UNION ALL
        SELECT tree, place, 0, tree, (SELECT count(*) FROM s), 1, d, proof FROM f WHERE above = 0 AND n = 1
        UNION ALL
        SELECT f.tree, f.place, f.lev + 1, f.i // 3, (f.n + 2) // 3, f.above,
            sha256(string_agg(CASE WHEN q.i = f.i THEN f.d ELSE q.d END, '' ORDER BY q.i)),
            f.proof || coalesce(string_agg(q.d, '' ORDER BY q.i) FILTER (WHERE q.i <> f.i), '')
        FROM f JOIN q ON q.lev = f.lev AND q.i // 3 = f.i // 3
        WHERE f.above = 1 AND f.n > 1 GROUP BY f.tree, f.place, f.lev, f.i, f.n, f.above, f.proof))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM f JOIN l USING (tree, place) JOIN s USING (tree) CROSS JOIN (SELECT d AS root FROM u WHERE n = 1) r
WHERE f.above = 1 AND f.n = 1
"""
