"""Repeated passages by prefix-partitioned suffix trees.

A passage repeats if ``WINDOW`` consecutive words of a document also start in a
document with a smaller id; every word under such a window is removed.

1. Suffixes are cut to ``WINDOW`` words, as deep as a node matters here.  They
   are kept where their prefix of ``PREFIX`` words has the least hash of the
   prefixes inside a window (an anchor).  Equal windows have the same anchor, so
   all windows of one anchor go along in one segment of text, about three words
   for each window instead of ``WINDOW``.
2. A counting pass over all documents gives the number of windows and the
   prefixes that alone would overfill a group.  Prefixes are dealt into groups of
   about ``GROUP_WINDOWS`` windows.  For an overfull prefix the length grows to all
   ``WINDOW`` words: each of its windows is a segment of its own.  Then equal
   windows of a batch are told apart before they travel: the least document's
   goes to the group, the others are known to repeat.
3. Each group builds its subtree in one task: its suffixes in sorted order and
   the length each shares with its neighbour, which is the tree's shape.  A run
   of neighbours that share ``WINDOW`` words hangs below one deep internal node;
   the least document of the node decides about all of its leaves.  Words are
   compared themselves, never hashes of them.
4. The marked windows return to their documents by a join on id and text digest.
   Marked windows that overlap or touch are one maximal repeat.

A group's text travels in blocks of compressed bytes, one for each batch of
documents and group.  Nothing is capped: groups get more as the corpus grows.

Null and empty texts and those of fewer than ``WINDOW`` words lose nothing.  A
null id counts as larger than every id; rows with one id never remove from each
other, so repeated rows stay alike.  Ids are whole numbers.  Other columns are
left as they are by ``remove_repeats`` and left out by the query.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace, stage
from .common import Bounded, map_groups, map_rows, table

WINDOW = 13
PREFIX = 3
SPAN = WINDOW - PREFIX + 1
GROUP_WINDOWS = 400_000
LAST = 2**63 - 1              # the place of a null id
_MASK = np.uint64(2**28 - 1)  # positions inside one chunk of text
_STEP, _MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(32)
_CHUNK = 8 << 20
_CODEC = "zstd"


def words_of(text: str | None) -> list[bytes]:
    """Words are cut at x20 and x09-x0D alone, as ``bytes.split`` does."""
    return text.encode().split() if text else []


def chunked(texts: list[str | None]):
    """``(first, texts)`` in pieces of about 8 MB, a longer text by itself."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > _CHUNK:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t or "")
    if texts:
        yield first, texts[first:]


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= span:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:len(x) - (span - reach)], x[span - reach:]) if reach < span else x


class Segments:
    """Cuts texts into segments, each the windows of one anchor in one text.

    Returns the words of all texts, and arrays: number of the text, first word
    in it, first word in all, number of words, 64-bit hash of the prefix.
    """

    def __init__(self):
        self.hashes = Bounded(xxhash.xxh64_intdigest)

    def __call__(self, texts: list[str | None]) -> tuple:
        words, sizes = [], []
        for t in texts:
            cut = words_of(t)
            words += cut
            sizes.append(len(cut))
        n = len(words)
        none = np.empty(0, np.int64)
        if n < WINDOW:
            return words, none, none, none, none, np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        prefix = h[:n - PREFIX + 1].copy()
        for k in range(1, PREFIX):
            prefix *= _STEP
            prefix += h[k:k + len(prefix)]
            prefix ^= prefix >> _SHIFT
        prefix *= _MIX
        prefix ^= prefix >> _SHIFT
        # the leftmost of equal prefixes, since the low bits hold the place
        least = _least((prefix & ~_MASK) | np.arange(len(prefix), dtype=np.uint64), SPAN)
        sizes = np.array(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        first = np.flatnonzero(text[:n - WINDOW + 1] == text[WINDOW - 1:])
        if not len(first):
            return words, none, none, none, none, np.empty(0, np.uint64)
        anchor = (least[first] & _MASK).astype(np.int64)
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        start = first[new]
        end = first[np.r_[new[1:], len(first)] - 1]
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        return (words, text[start], start - begins[text[start]], start,
                end - start + WINDOW, prefix[anchor[new]])


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``did, h, text``: the place of the id, the text's digest, the text."""
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("did"),
                       F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def count_prefixes(base: DataFrame, group: int) -> tuple[int, np.ndarray]:
    """Number of windows, and the prefixes of more segments than a group takes.

    A task keeps back prefixes it saw fewer than ``t`` times.  With ``p`` tasks
    and ``t = limit / 2p`` that hides less than half of ``limit``, so every
    prefix beyond the limit is among those with half of it in sight, and these
    are at most ``2 * segments / limit``, 100,000, whatever the corpus.
    """
    limit = max(8, group // 8)
    least = max(1, limit // (2 * max(1, base.rdd.getNumPartitions())))

    def run(batches):
        cut, windows, parts = Segments(), 0, []
        for batch in batches:
            for _, texts in chunked(batch.column(0).to_pylist()):
                _, _, _, _, sizes, key = cut(texts)
                windows += int((sizes - WINDOW + 1).sum())
                parts.append(key)
        keys, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.uint64), return_counts=True)
        often = n >= least
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[keys[often].view(np.int64), 0], pa.int64()),
             pa.array(np.r_[n[often], 0], pa.int64()),
             pa.array(np.r_[np.zeros(int(often.sum()), np.int64), windows], pa.int64())],
            names=["key", "n", "windows"])

    counted = stage(base.select("text").mapInArrow(run, "key long, n long, windows long"), "prefixes")
    total = counted.agg(F.sum("windows")).first()[0] or 0
    limit = max(limit, total // 50_000)
    heavy = (counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * 2 >= limit)
             .select("key").collect())
    return total, np.sort(np.array([r["key"] for r in heavy], np.int64).view(np.uint64))


def _is_in(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(keys), bool)
    return heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys


def _pack(did, h, text, at, size, key, body: bytes) -> bytes:
    """One block: documents, segments, and the segments' text."""
    docs, inner = np.unique(text, return_inverse=True)
    raw = b"".join([
        np.array([len(docs), len(text)], "<i8").tobytes(), did[docs].tobytes(), h[docs].tobytes(),
        inner.astype("<i4").tobytes(), at.astype("<i4").tobytes(), size.astype("<i4").tobytes(),
        key.astype("<u4").tobytes(), body])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(block: bytes) -> tuple:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec=_CODEC, asbytes=True)
    d, s = np.frombuffer(raw, "<i8", 2).tolist()
    place, out = 16, []
    for kind, n in (("<i8", d), ("<i8", d), ("<i4", s), ("<i4", s), ("<i4", s), ("<u4", s)):
        out.append(np.frombuffer(raw, kind, n, place))
        place += out[-1].nbytes
    return (*out, raw[place:].split(b"\n"))


def _lengthened(words: list[bytes], did: np.ndarray, text, at, start, size) -> tuple[list, list]:
    """The windows of overfull prefixes by all their words: those that go to a
    group, and ``(text, at)`` of those that a smaller document of the batch decides."""
    seen, least = [], {}
    for k in range(len(text)):
        for i in range(int(size[k]) - WINDOW + 1):
            window = b" ".join(words[start[k] + i:start[k] + i + WINDOW])
            seen.append((window, text[k], at[k] + i, start[k] + i))
            least[window] = min(least.get(window, LAST), did[text[k]])
    sent, sure = [], []
    for window, t, a, s in seen:
        if did[t] > least[window]:
            sure.append((t, a))
        else:
            sent.append((t, a, s, WINDOW, xxhash.xxh64_intdigest(window)))
    return sent, sure


def blocks(base: DataFrame, groups: int, heavy: np.ndarray) -> DataFrame:
    """``grp, block``: the segments of each batch, packed by group.

    A segment of no words is a window that is known to repeat; such go to any group.
    """
    shared = base.sparkSession.sparkContext.broadcast(heavy)  # bounded, see count_prefixes

    def make():
        cut, heavy = Segments(), shared.value

        def pack(dids, hs, texts):
            did, h = np.array(dids, "<i8"), np.array(hs, "<i8")
            found, packed = [], []
            for first, part in chunked(texts):
                words, text, at, start, size, key = cut(part)
                text = text + first
                if len(heavy):
                    over = _is_in(key, heavy)
                    sent, sure = _lengthened(words, did, *(x[over].tolist() for x in (text, at, start, size)))
                    if sure:
                        t, a = np.array(sure).T
                        none = np.zeros(len(sure), np.int64)
                        found.append(int(h[t[0]]) % groups)
                        packed.append(_pack(did, h, t, a, none, none, b""))
                    light = [x[~over] for x in (text, at, start, size, key)]
                    text, at, start, size, key = light
                    if sent:  # none if the piece has no overfull prefix
                        text, at, start, size, key = (
                            np.concatenate([x, np.array(c, x.dtype)])
                            for x, c in zip(light, zip(*sent, strict=True), strict=True))
                if not len(key):
                    continue
                group = ((key * _STEP) >> _SHIFT) % np.uint64(groups)
                order = np.argsort(group, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
                for of in np.split(order, edges[1:]):
                    of = np.sort(of)
                    body = b"\n".join([b" ".join(words[a:b]) for a, b in zip(
                        start[of].tolist(), (start[of] + size[of]).tolist(), strict=True)])
                    found.append(int(group[of[0]]))
                    packed.append(_pack(did, h, text[of], at[of], size[of], key[of], body))
            return found, packed
        return pack

    return map_rows(base, make, "grp int, block binary")


def repeated_leaves(suffixes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a leaf shares a node of full depth with a smaller document.

    ``suffixes`` holds one suffix a row, words as numbers.  Sorted suffixes and
    the words that neighbours share are the tree; a run in which neighbours share
    all words is what hangs below one deep node.
    """
    n, depth = suffixes.shape
    flat = np.ascontiguousarray(suffixes.astype(">i4")).view(f"S{4 * depth}").ravel()
    order = np.argsort(flat, kind="stable")
    equal = suffixes[order[1:]] == suffixes[order[:-1]]
    shared = np.where(equal.all(axis=1), depth, equal.argmin(axis=1))
    node = np.flatnonzero(np.r_[True, shared < depth])
    low = np.minimum.reduceat(doc[order], node)
    out = np.empty(n, bool)
    out[order] = doc[order] > np.repeat(low, np.diff(np.r_[node, n]))
    return out


def subtree(found: list[tuple]) -> list[tuple]:
    """``(did, h, starts)`` of the repeated windows of one group's blocks."""
    ids: dict[tuple, int] = {}
    columns, bodies = [[], [], [], []], []
    for did, h, inner, *rest, body in found:
        place = np.array([ids.setdefault(x, len(ids)) for x in zip(did.tolist(), h.tolist(), strict=True)])
        for column, x in zip(columns, (place[inner], *rest), strict=True):
            column.append(x)
        bodies += body if body != [b""] else [b""] * len(inner)
    doc, at, size, key = map(np.concatenate, columns)
    doc, at, size = doc.astype(np.int64), at.astype(np.int64), size.astype(np.int64)
    sure = size == 0
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    several = np.flatnonzero((n[inverse] > 1) & ~sure)  # a prefix of one suffix has no inner node
    # a row that stands twice in the corpus is one row here
    _, once = np.unique(np.stack([doc[several], at[several]]), axis=1, return_index=True)
    several = several[once]
    hits = [(doc[sure], at[sure])]
    if len(several) > 1:
        names: dict[bytes, int] = defaultdict(count().__next__)
        words = np.array([names[w] for k in several.tolist() for w in bodies[k].split(b" ")], np.int32)
        size, doc, at = size[several], doc[several], at[several]
        windows = size - WINDOW + 1
        begin = np.cumsum(size) - size
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = (np.repeat(begin, windows) + inside).astype(np.int32)
        suffixes = words[start[:, None] + np.arange(WINDOW, dtype=np.int32)]
        order = np.array([d for d, _ in ids], np.int64)
        doc, at = np.repeat(doc, windows), np.repeat(at, windows) + inside
        hit = repeated_leaves(suffixes, order[doc])
        hits.append((doc[hit], at[hit]))
    doc, at = (np.concatenate(x) for x in zip(*hits, strict=True))
    if not len(doc):
        return []
    sort = np.lexsort((at, doc))
    doc, at = doc[sort], at[sort]
    edges = np.flatnonzero(np.r_[True, np.diff(doc) != 0])
    pairs = list(ids)
    return [(*pairs[doc[a]], at[a:b].astype("<i4").tobytes())
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)], strict=True)]


def from_groups(packed: DataFrame) -> DataFrame:
    """``did, h, starts`` of every group's repeated windows."""
    return map_groups(packed, "grp", lambda: lambda _, rows: subtree([_unpack(b) for (b,) in rows]),
                      "did long, h long, starts binary")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     group: int = GROUP_WINDOWS) -> DataFrame:
    """``did, h, starts`` (binary parts of 32-bit word numbers), one row for each
    id and text that has repeated windows."""
    base = _base(docs, id_col, text_col)
    total, heavy = count_prefixes(base, group)
    found = from_groups(blocks(base, max(1, -(-total // group)), heavy))
    return stage(found.groupBy("did", "h").agg(F.collect_list("starts").alias("starts")), "repeats")


def covered(n: int, starts: list[bytes] | None) -> np.ndarray:
    """Which of ``n`` words lie under one of the windows."""
    edge = np.zeros(n + 1, np.int32)
    if starts:
        at = np.unique(np.frombuffer(b"".join(starts), "<i4"))
        edge[at] += 1
        edge[at + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def _with_repeats(docs: DataFrame, id_col: str, text_col: str, group: int) -> DataFrame:
    """The documents beside the starts of their repeated windows."""
    found = repeated_windows(docs, id_col, text_col, group)
    keyed = docs.withColumns({
        "op13 did": F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)), "op13 h": F.xxhash64(text_col)})
    there = found.select(F.col("did").alias("op13 did"), F.col("h").alias("op13 h"),
                         F.col("starts").alias("op13 starts"))
    return keyed.join(there, ["op13 did", "op13 h"], "left").drop("op13 did", "op13 h")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   group: int = GROUP_WINDOWS) -> DataFrame:
    """The documents without their repeated words; a text that loses words has
    the rest joined by one space, every other cell stays as it is."""
    joined = _with_repeats(docs, id_col, text_col, group)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            starts = batch.column(batch.schema.get_field_index("op13 starts")).to_pylist()
            for k, at in enumerate(starts):
                if at:
                    words = words_of(texts[k])
                    gone = covered(len(words), at)
                    texts[k] = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode()
            place = batch.schema.get_field_index(text_col)
            kept = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield kept.drop_columns(["op13 starts"])

    return joined.mapInArrow(run, docs.schema)


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 group: int = GROUP_WINDOWS) -> DataFrame:
    """id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``spans``
    array<struct<start, end>> (words, end exclusive) of every row's maximal repeats."""
    joined = _with_repeats(docs.select(id_col, text_col), id_col, text_col, group)
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(ids, texts, starts):
        n, gone, kept, spans = [], [], [], []
        for text, at in zip(texts, starts, strict=True):
            words = words_of(text)
            n.append(len(words))
            if not at:
                gone.append(0)
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                spans.append([])
                continue
            out = covered(len(words), at)
            edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
            gone.append(int(out.sum()))
            kept.append(hashlib.sha256(b" ".join(
                [w for w, g in zip(words, out.tolist(), strict=True) if not g])).hexdigest())
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
        return ids, n, gone, kept, spans

    return map_rows(joined.select(id_col, text_col, "op13 starts"), lambda: measure,
                    f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, "
                    "spans array<struct<start:int,end:int>>")


def op13_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark) as work:
        return work.result(repeat_spans(table(spark, sf_dir, "documents")).drop("spans"), "op13")


OP13_SQL = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
cut AS (SELECT r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                      lambda x: x <> '') AS ws FROM d),
words AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM cut),
grams AS (SELECT r, doc_id, p, w,
    string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g,
    count(*) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS n FROM words),
least AS (SELECT g, min(doc_id) AS low FROM grams WHERE n = {WINDOW} GROUP BY g),
marked AS (SELECT grams.r, p, w, coalesce(n = {WINDOW} AND low < doc_id, false) AS hit
           FROM grams LEFT JOIN least USING (g)),
gone AS (SELECT r, p, w, max(hit) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)
         AS gone FROM marked)
SELECT doc_id, count(p) AS n_words, count(p) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) GROUP BY r, doc_id
"""
