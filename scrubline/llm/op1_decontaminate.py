"""Benchmark decontamination by a broadcast hash set of n-grams.

Windows of ``WINDOW`` consecutive benchmark words (an item of fewer is one
window) are hashed into a table that is broadcast.  Every word position of every
document is hashed over each window length that occurs and looked up there; a
hit counts once the words themselves are equal.  All of it is DataFrame
expressions.  The table's size is counted first: beyond ``BLOCK_ROWS`` windows
or ``BLOCK_BYTES`` it is cut into blocks, each of which is broadcast and met
with all documents.

Documents without words, or without any hit, have zero counts.  Rows that repeat
a document come back as often as they stand.  Benchmark items with the same id
count once, those without an id too, which the digest leaves out; an item or
document whose text is null has no words.  Other columns are left out (``remove_contaminated`` keeps them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from .common import lower_ascii, table

WINDOW = 10
BLOCK_ROWS = 200_000
BLOCK_BYTES = 64 << 20
#: ASCII that no word holds.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _hashes(words: str, size: int) -> Column:
    """The hash of the ``size`` words from each position on."""
    return F.transform(words, lambda w, i: F.xxhash64(
        w, *[F.get(F.col(words), i + k) for k in range(1, size)]))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """``h``, ``len``, ``window`` (its words) and ``items`` of each distinct window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    windows = items.select("item", F.explode_outer(F.transform(
        F.sequence(F.lit(1), last + 1), lambda i: F.slice("words", i, size))).alias("window"))
    # in structs, as sets leave nulls out
    own = F.transform(F.collect_set(F.struct("item")), lambda s: s["item"])
    return windows.groupBy("window").agg(own.alias("items")).select(
        F.xxhash64(*[F.get("window", F.lit(k)) for k in range(size)]).alias("h"),
        F.size("window").alias("len"), "window", "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``id, dg, copies, n_words, spans, items`` of each distinct (id, text):
    spans are the hit windows as (first word, number of words)."""
    windows = benchmark_windows(benchmark, size)
    wide = F.sum(F.octet_length(F.array_join("window", " ")) + 16 * F.size("items") + 64)
    lengths = {r["len"]: (r["n"], r["b"]) for r in windows.groupBy("len").agg(
        F.count(F.lit(1)).alias("n"), wide.alias("b")).collect()}  # one row for each length
    rows, size_b = (sum(v[i] for v in lengths.values()) for i in (0, 1))
    blocks = max(1, -(-rows // BLOCK_ROWS), -(-size_b // BLOCK_BYTES))
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("dg"),
                        words_of(F.col(text_col)).alias("words"))
    # the first entry stands for the document itself, the rest for its positions;
    # the arrays are never empty, and "outer" keeps Catalyst from testing that in a
    # filter below, which would work the whole expression out once more
    hashed = words.select("id", "dg", "words", F.concat(
        F.array(F.lit(0).cast("long")), *[_hashes("words", n) for n in sorted(lengths)]).alias("hs"))
    places = hashed.select("id", "dg", "words", F.posexplode_outer("hs").alias("p", "h"))
    own = windows.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("h"), F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))

    def hits(block: int) -> DataFrame:
        part = windows.where(F.pmod("h", F.lit(blocks)) == block) if blocks > 1 else windows
        part = part.unionByName(own) if block == 0 else part
        n = F.size("words")
        at = F.when(F.col("p") > 0, F.pmod(F.col("p") - 1, F.greatest(n, F.lit(1))))
        real = (F.col("p") > 0) & (F.col("len") > 0) & (
            F.slice("words", F.coalesce(at, F.lit(0)) + 1, F.greatest("len", F.lit(1))) == F.col("window"))
        return places.join(F.broadcast(part), "h").where(
            ((F.col("p") == 0) & (F.col("len") == 0)) | real).select(
            "id", "dg", n.alias("n_words"), at.alias("at"), "len", "items")

    found = reduce(DataFrame.unionByName, [hits(b) for b in range(blocks)])
    return found.groupBy("id", "dg").agg(
        F.sum((F.col("len") == 0).cast("long")).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("len") > 0, F.struct("at", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: words, hit words, items hit and their digest."""
    start = F.struct(F.lit(0).alias("done"), F.lit(0).alias("hit"))

    def cover(state, span):
        end = span["at"] + span["len"]
        return F.struct(
            F.greatest(state["done"], end).alias("done"),
            (state["hit"] + F.greatest(F.lit(0), end - F.greatest(state["done"], span["at"]))).alias("hit"))

    hits = find_hits(docs, benchmark, size, id_col, text_col)
    return hits.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.aggregate(F.array_sort("spans"), start, cover, lambda s: s["hit"]).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window."""
    hit = find_hits(docs, benchmark, size, id_col, text_col).where(F.size("spans") > 0)
    bad = broadcast_if_small(stage(hit.select(
        F.col("id").alias("hit id"), F.col("dg").alias("hit dg")), "contaminated"))
    same = bad["hit id"].eqNullSafe(docs[id_col]) & (bad["hit dg"] == F.xxhash64(docs[text_col]))
    return docs.join(bad, same, "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = ("regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
OP1_SQL = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), sizes WHERE i + n - 1 <= len(w)),
hits AS (SELECT p.doc_id, p.i, p.n, w.item FROM places p JOIN wins w ON p.win = w.win AND p.n = w.n),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_items IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
