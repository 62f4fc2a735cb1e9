"""Token counts by byte-pair merging, without making token ids.

A text starts as a linked list of characters.  A heap holds the adjacent pairs
whose concatenation is a piece; the pair of lowest rank (of equal ranks the
leftmost) is popped and merged until none is left.  The count is the initial
symbols minus the merges, plus what byte fallback adds: a character that is no
piece counts as its UTF-8 bytes.

No piece holds a space mark after another character, so no merge crosses from
a character into the space mark that follows it.  A text is therefore merged
chunk by chunk (a run of spaces and the run of other characters after it), and
counts of short chunks are kept in a bounded cache.

Null and empty texts have no tokens.  Repeated rows come back as often as they
stand; other columns are left out.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, map_rows, table

LIMIT = 4096
SPACE = "▁"


def read_pieces(model_file: str) -> dict[str, int]:
    """Rank of every mergeable piece of a sentencepiece model: low is early."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = (model.is_control, model.is_unknown, model.is_byte)
    return {model.id_to_piece(i): round(-model.get_score(i))
            for i in range(model.get_piece_size()) if not any(f(i) for f in special)}


class PairMerger:
    """Counts the symbols that are left when no adjacent pair merges any more."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        for piece in ranks:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece crosses a word's start; chunks can't be merged alone")
        self.counts = Bounded(self.count_chunk)

    def count_chunk(self, chunk: str) -> int:
        ranks = self.ranks
        size = len(chunk)
        if size == 1:
            return 1 if chunk in ranks else len(chunk.encode())
        symbols: list[str | None] = list(chunk)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            pair = chunk[i:i + 2]
            if pair in ranks:
                heap.append((ranks[pair], i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left] if symbols[left] is not None else size
            if right == size or symbols[left] + symbols[right] != pair:
                continue  # one of the two has merged with another since
            merges += 1
            symbols[left], symbols[right] = pair, None
            follower = after[left] = after[right]
            if follower < size:
                before[follower] = left
                joined = pair + symbols[follower]
                if joined in ranks:
                    heapq.heappush(heap, (ranks[joined], left, joined))
            leader = before[left]
            if leader >= 0:
                joined = symbols[leader] + pair
                if joined in ranks:
                    heapq.heappush(heap, (ranks[joined], leader, joined))
        extra = sum(len(c.encode()) - 1 for c in symbols
                    if c is not None and len(c) == 1 and c not in ranks)
        return size - merges + extra

    _chunk = re.compile(f"{SPACE}*[^{SPACE}]*")

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        text = (SPACE + text).replace(" ", SPACE)
        return sum(map(self.counts.__getitem__, filter(None, self._chunk.findall(text))))


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row."""
    ranks = read_pieces(model_file)

    def make():
        merger = PairMerger(ranks)

        def count(ids, texts, sizes):
            return ids, sizes, [merger(t) for t in texts]
        return count

    kind = df.schema[id_col].dataType.simpleString()
    sized = df.select(F.col(id_col), F.col(text_col),
                      F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    return (map_rows(sized, make, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("piece_bpe_32k.model"))
