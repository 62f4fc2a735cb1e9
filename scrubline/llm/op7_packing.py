"""Hierarchical packing of documents into windows of several lengths.

Each task packs the documents of its partition as they stream by; nothing is
shuffled and at most ``BUFFER`` document tails wait at once.

* A document's full windows of 2048 tokens stand alone.  Its tail goes to the
  shortest tier (2048, 1024, 512, 256) that holds it.
* Each tier is packed, longest tier first: the longest tail opens a window,
  whose gap is filled by the best fitting tails of the shorter tiers; what no
  tail fits is filled by cutting one.
* What is left at the end of a partition is cut into windows of powers of two,
  so no window is padded.
* Windows of one tier form step groups of ``STEP_TOKENS`` tokens each, whatever
  the tier; only the last group of a tier and task may hold less.

Token ids are those of the tokenizer file with the vocabulary ``ranks`` names,
then the end id.  No token of this vocabulary spans a space after another
character and one before another; texts are cut there, and the ids of short
words kept in a bounded cache.

Null counts as an empty text (one piece: the end id).  Repeated rows are packed
as often as they stand; other columns are left out.  Sequence ids hold the
partition in their upper bits and are the same when a task runs again.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from struct import pack as _pack_ids

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from .common import Bounded, table

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 8 * 2048
BUFFER = 4096
END_ID = 1
_SIGNS = ".,;:!?$%&#*()[]{}"
END_OF_TEXT = {"<|endoftext|>": 50256}


class Encoder:
    """Packs the ids of a text as little-endian unsigned 32-bit integers."""

    _runs = re.compile(r" \s|\s ")

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int]):
        import tiktoken

        self.coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks,
                                        special_tokens=special)
        self.special = list(special)
        self.words = Bounded(lambda word: self.chunk(" ", word))  # after a space
        self.bare = Bounded(lambda word: self.chunk("", word))

    def chunk(self, space: str, word: str) -> bytes:
        """The ids of what stands between spaces.  Letters followed by signs, and
        what a single line break parts, are tokens of their own anyway: their
        halves are more often known."""
        if word.isalpha():  # one piece of the pattern
            ids = self.coding._encode_single_piece((space + word).encode())
            return _pack_ids(f"<{len(ids)}I", *ids)
        head, line, tail = word.partition("\n")
        if line:
            if head and tail and not head[-1].isspace() and not tail[0].isspace():
                return (self.words if space else self.bare)[head] + self.bare["\n"] + self.bare[tail]
        else:
            core = word.rstrip(_SIGNS)
            if core != word and core.isalpha():
                return (self.words if space else self.bare)[core] + self.bare[word[len(core):]]
        return self.whole(space + word)

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.coding.encode(text, allowed_special="all")
        else:
            ids = self.coding.encode_ordinary(text)
        return _pack_ids(f"<{len(ids)}I", *ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._runs.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(
            map(self.words.__getitem__, rest))


class Packer:
    """Cuts documents into pieces and hands out full windows of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers = tiers
        self.step_tokens = step_tokens
        self.waiting: dict[int, deque] = defaultdict(deque)  # tails by length
        self.lengths: list[int] = []  # of them, sorted
        self.count = 0
        self.sequences = self.steps = 0
        self.open_steps: dict[int, list[int]] = {}

    def _put(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        if not self.waiting[size]:
            insort(self.lengths, size)
        self.waiting[size].append(piece)
        self.count += 1

    def _take(self, size: int) -> tuple:
        piece = self.waiting[size].popleft()
        if not self.waiting[size]:
            del self.waiting[size]
            self.lengths.remove(size)
        self.count -= 1
        return piece

    def _close(self, tier: int, pieces: list[tuple]) -> Iterator[tuple]:
        """The rows of one window."""
        step = self.open_steps.get(tier)
        if step is None or step[1] + tier > max(self.step_tokens, tier):
            step = self.open_steps[tier] = [self.steps, 0]
            self.steps += 1
        step[1] += tier
        at = 0
        for doc_id, start, ids, total in pieces:
            size = len(ids) // 4
            yield (doc_id, start, size, zlib.crc32(ids), total, self.sequences, at, tier, step[0])
            at += size
        self.sequences += 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, wide = len(ids) // 4, self.tiers[0]
        full = total - total % wide
        for start in range(0, full, wide):
            yield from self._close(wide, [(doc_id, start, ids[4 * start:4 * (start + wide)], total)])
        if full < total:
            self._put((doc_id, full, ids[4 * full:], total))

    def _fill(self, pieces: list[tuple], gap: int) -> int:
        """Fill a gap from the tails that wait; what could not be filled."""
        while gap and self.lengths:
            k = bisect_right(self.lengths, gap)
            if k:
                size = self.lengths[k - 1]
                pieces.append(self._take(size))
                gap -= size
                continue
            # all are longer: cut one of the shortest tier that has any
            tier = next(t for t in reversed(self.tiers) if self.lengths[0] <= t)
            size = self.lengths[bisect_right(self.lengths, tier) - 1]
            doc_id, start, ids, total = self._take(size)
            pieces.append((doc_id, start, ids[:4 * gap], total))
            self._put((doc_id, start + gap, ids[4 * gap:], total))
            gap = 0
        return gap

    def pack(self, keep: int = 0) -> Iterator[tuple]:
        """Windows of every tier, until at most ``keep`` tails wait."""
        for i, tier in enumerate(self.tiers):
            shorter = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
            # a share of each tier stays, so that later gaps find tails of all sizes
            low = bisect_right(self.lengths, shorter)
            here = sum(len(self.waiting[s]) for s in self.lengths[low:bisect_right(self.lengths, tier)])
            stay = keep * here // max(1, self.count)
            while here > stay:
                k = bisect_right(self.lengths, tier)
                if not k or self.lengths[k - 1] <= shorter:
                    break
                pieces = [self._take(self.lengths[k - 1])]
                here -= 1
                gap = self._fill(pieces, tier - len(pieces[0][2]) // 4)
                if gap:  # nothing waits any more
                    yield from self._tail(pieces)
                    return
                yield from self._close(tier, pieces)
                if not shorter:
                    here = self.count

    def _tail(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The last tokens, in windows of powers of two."""
        left = sum(len(p[2]) // 4 for p in pieces)
        rest = deque(pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, gap = [], size
            while gap:
                doc_id, start, ids, total = rest.popleft()
                part = min(gap, len(ids) // 4)
                window.append((doc_id, start, ids[:4 * part], total))
                if part < len(ids) // 4:
                    rest.appendleft((doc_id, start + part, ids[4 * part:], total))
                gap -= part
            yield from self._close(size, window)
            left -= size


def pack_documents(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", special: dict[str, int] | None = None,
                   end_id: int = END_ID, tiers: tuple[int, ...] = TIERS,
                   step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: its document, start, length, CRC-32 of its ids,
    the document's tokens, sequence, offset there, tier and step group."""
    import base64

    special = END_OF_TEXT if special is None else special
    with open(tokenizer, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    context = df.sparkSession.sparkContext
    shared = context.broadcast(ranks)  # the vocabulary: fixed size
    kind = df.schema[id_col].dataType.simpleString()
    fields = T.StructType.fromDDL(
        f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, tier int, step_group long")
    arrow = to_arrow_schema(fields)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = Encoder(shared.value, pattern, special)
        packer = Packer(tiers, step_tokens)
        base = TaskContext.get().partitionId() << 33

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            columns[5] = [base + s for s in columns[5]]
            columns[8] = [base + s for s in columns[8]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=arrow.field(i).type) for i, c in enumerate(columns)], schema=arrow)

        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += packer.add(doc_id, encode(text) + end)
                if packer.count >= BUFFER:
                    rows += packer.pack(keep=BUFFER // 2)
            if rows:
                yield batch_of(rows)
        rows = list(packer.pack())
        if rows:
            yield batch_of(rows)

    return df.select(id_col, text_col).mapInArrow(run, fields)


def op7_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
