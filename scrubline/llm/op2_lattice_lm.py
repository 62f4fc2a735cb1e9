"""Language-model scores by a subword lattice.

The vocabulary is that of an existing tokenizer.  A token's probability is the
sum over all its segmentations into pieces of the product of the pieces'
probabilities, worked out by a forward recursion in log space.  A text's is the
marginal over its own, unknown shares of tokens, which vary around the lattice's
(a Dirichlet distribution of weight ``CONCENTRATION``), since a text repeats its
words: of n tokens, the k-th repeat of one of lattice probability q has the
factor (CONCENTRATION * q + k) / (CONCENTRATION + tokens before).  The order of
tokens does not matter; one end follows, independent of them.  Pieces start with weights from the
vocabulary's own scores (ranks r weigh 1 / (r + 10)) and are fitted by ``ROUNDS``
of expectation and maximisation over the whole table of distinct training
tokens; every single byte is a piece, so any text has a positive probability.

A training token is one more arc of its own lattice, from its first byte to its
last: it weighs its count less a discount, over all training tokens.  What the
discounts set free is the share of the pieces, which are fitted to these
discounts, so that they describe rare and new tokens.  The discounts for counts
of 1, 2 and more follow from the numbers of tokens of count 1 to 4.

Token counts are pre-aggregated in each task, summed by shuffle and written to
the shared folder.  For the texts, tokens whose count falls in the topmost
classes (at most ``COMMON`` tokens, a fixed bound) are looked up in a broadcast
table; all others meet the token table by a shuffled join.

Null counts as an empty text (the end alone).  Repeated rows come back as often
as they stand; a row whose id is null is held out; other columns are left out.
Without training rows every count is zero.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import table, tokens_of

ALPHA = 0.1
ROUNDS = 2
SMOOTHING = 0.01
#: How closely a text's token shares follow the corpus, in tokens.
CONCENTRATION = 2_000.0
COMMON = 250_000
FLUSH = 150_000
START = b" "  # stands for the mark that begins a word; no token holds a space
LN10 = math.log(10)


def read_pieces(model_file: str) -> list[tuple[bytes, float]]:
    """Spelling and first weight of every piece that lower-cased tokens can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    weights: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        spelled = piece.replace("▁", " ").encode()
        if spelled == spelled.lower() and b" " not in spelled[1:]:
            weights[spelled] = 1 / (min(-model.get_score(i), 1e5) + 10)
    least = min(weights.values(), default=1.0)
    for byte in range(256):
        weights.setdefault(bytes([byte]), least)
    total = sum(weights.values())
    return [(p, w / total) for p, w in sorted(weights.items())]


class Lattice:
    """All segmentations of tokens into pieces, for many tokens at once."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        children: list[dict[int, int]] = [{}, {}]  # 0: dead, 1: the root
        piece_at = [-1, -1]
        for k, piece in enumerate(pieces):
            node = 1
            for byte in piece:
                follower = children[node].get(byte)
                if follower is None:
                    follower = children[node][byte] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = follower
            piece_at[node] = k
        self.moves = np.zeros((len(children), 256), np.int32)
        for node, below in enumerate(children):
            for byte, follower in below.items():
                self.moves[node, byte] = follower
        self.piece_at = np.array(piece_at, np.int32)
        self.logs = logs
        self.longest = max(map(len, pieces))

    def _arcs(self, text: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, tokens, pieces) of the pieces that begin at byte ``i``."""
        state = np.ones(text.shape[1], np.int32)
        for end in range(i + 1, min(i + self.longest, len(text)) + 1):
            state = self.moves[state, text[end - 1]]
            piece = self.piece_at[state]
            found = np.flatnonzero(piece >= 0)
            if len(found):
                yield end, found, piece[found]
            elif not state.any():
                return

    def forward(self, text: np.ndarray) -> np.ndarray:
        alpha = np.full((len(text) + 1, text.shape[1]), -np.inf)
        alpha[0] = 0
        for i in range(len(text)):
            for end, at, piece in self._arcs(text, i):
                alpha[end, at] = np.logaddexp(alpha[end, at], alpha[i, at] + self.logs[piece])
        return alpha

    def expected(self, text: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the tokens, each so many times."""
        alpha = self.forward(text)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0
        counts = np.zeros(len(self.logs))
        for i in range(len(text) - 1, -1, -1):
            for end, at, piece in self._arcs(text, i):
                onward = self.logs[piece] + beta[end, at]
                beta[i, at] = np.logaddexp(beta[i, at], onward)
                share = np.exp(alpha[i, at] + onward - alpha[-1, at]) * weight[at]
                counts += np.bincount(piece, share, len(counts))
        return counts


def by_length(words: list[bytes], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and letters (bytes x words) of the words of each length."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        size = int(sizes[group[0]]) + 1
        for lo in range(0, len(group), max(1, most // size)):
            part = group[lo:lo + max(1, most // size)]
            flat = b"".join(START + words[k] for k in part)
            yield part, np.frombuffer(flat, np.uint8).reshape(len(part), size).T


def word_batches(batches, rows: int = 40_000):
    """The batches of a table of tokens, as columns of about ``rows`` rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``word, c``: every token of the rows ``text, train`` and its training count."""
    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            texts, train = (c.to_pylist() for c in batch.columns)
            for text, own in zip(texts, train, strict=True):
                words = tokens_of(text)
                if own:
                    counts.update(words)
                else:
                    for word in words:
                        if word not in counts:
                            counts[word] = 0
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What counts of 0, 1, 2 and more give to the pieces, by the numbers of
    tokens of count 1 to 4; within a tenth and nine tenths of 1, 2 and 3."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [k - (k + 1) * y * after / at if at else k / 2
             for k, (at, after) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return np.array([0.0, *(min(max(d, 0.1 * k), 0.9 * k) for k, d in enumerate(found, 1))])


def with_whole(pieces: np.ndarray, c: np.ndarray, discounts: np.ndarray, n: int, share: float) -> np.ndarray:
    """Adds the arc over the whole token to the pieces' log probabilities."""
    if not n:
        return pieces
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log((c - discounts[np.minimum(c, 3)]) / n), pieces + math.log(share))


def repeats(at: np.ndarray, logs: np.ndarray, mass: np.ndarray) -> float:
    """Sum over the tokens ``at`` of a text of log10(mass + earlier occurrences)."""
    if not len(at):
        return 0.0
    at = np.sort(at)
    place = np.arange(len(at))
    first = np.concatenate(([True], at[1:] != at[:-1]))
    earlier = place - np.maximum.accumulate(np.where(first, place, 0))
    again = ~first
    return float(logs[at[first]].sum() + np.log10(mass[at[again]] + earlier[again]).sum())


def fit_pieces(words: DataFrame, ends: float, model_file: str, discounts: np.ndarray,
               rounds: int = ROUNDS) -> tuple:
    """Pieces, their log probabilities, and the end's, from the training tokens,
    each of which weighs its discount (``ends`` is that of the end)."""
    spelled = read_pieces(model_file)
    pieces = [p for p, _ in spelled]
    logs = np.log([w for _, w in spelled])
    context = words.sparkSession.sparkContext
    total = 0.0
    for _ in range(rounds):
        shared = context.broadcast((pieces, logs))  # the vocabulary: fixed size

        def run(batches):
            lattice = None
            counts = None
            for part in word_batches(batches):
                lattice = lattice or Lattice(*shared.value)
                weight = discounts[np.minimum(part["c"].to_numpy(), 3)]
                counts = np.zeros(len(lattice.logs)) if counts is None else counts
                tokens = part["word"].to_pylist()
                for at, text in by_length(tokens):
                    counts += lattice.expected(text, weight[at])
            if counts is not None:
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["piece", "n"])

        found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy(
            "piece").agg(F.sum("n").alias("n")).collect()  # one row for each piece
        counts = np.full(len(pieces), SMOOTHING)
        for row in found:
            counts[row["piece"]] += row["n"]
        total = counts.sum()
        logs = np.log(counts / (total + ends + SMOOTHING))
    end = math.log((ends + SMOOTHING) / (total + ends + SMOOTHING))
    return pieces, logs, end


def lattice_scores(docs: DataFrame, model_file: str, train_col: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score of every row;
    ``train_col`` says which rows are learnt from."""
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(train_col).alias("train"))
    counted = stage(count_tokens(rows.select("text", "train")), "tokens")
    ends = rows.where("train").count()
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                       F.count(F.when(F.col("c") > 0, 1)).alias("v"),
                       *(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    below = n + ALPHA * (v + 1)
    discounts = discounts_of(*(sums[f"n{k}"] for k in range(1, 5)))
    end_discount = float(discounts[min(ends, 3)])
    freed = end_discount + float(discounts[1:] @ [sums["n1"], sums["n2"], sums["v"] - sums["n1"] - sums["n2"]])
    share = freed / n if n else 1.0
    pieces, logs, end_log = fit_pieces(counted, end_discount, model_file, discounts)
    end_log = float(with_whole(np.array([end_log]), np.array([ends]), discounts, n, share)[0])
    lattice_data = context.broadcast((pieces, logs))

    def score_words(batches):
        lattice = None
        for part in word_batches(batches):
            lattice = lattice or Lattice(*lattice_data.value)
            out = np.zeros(len(part))
            for at, text in by_length(part["word"].to_pylist()):
                out[at] = lattice.forward(text)[-1]
            out = with_whole(out, part["c"].to_numpy(), discounts, n, share)
            yield from part.append_column("lp", pa.array(out / LN10)).to_batches()

    words = stage(counted.mapInArrow(score_words, "word binary, c long, lp double"), "tokens")

    # classes of counts: an eighth of an octave each, so a few hundred rows at most
    octave = F.floor(F.log2(F.greatest("c", F.lit(1))) * 8).cast("int")
    sizes = words.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("o")).collect()
    held, least = 0, None
    for row in sizes:
        held += row["n"]
        if held > COMMON:
            break
        least = row["o"]
    common = words.where(octave >= least) if least is not None else words.limit(0)
    top = common.toArrow()  # at most COMMON rows
    shared = context.broadcast((top["word"].to_pylist(), top["c"].to_numpy(), top["lp"].to_numpy()))
    end_base = math.log10(((ends if ends else 0) + ALPHA) / below)
    end_known, end_score = int(ends > 0), end_log / LN10
    onward = math.log1p(-math.exp(end_log)) / LN10  # a token and no end
    weight = CONCENTRATION
    # log10(weight * q) is a token's log10 probability less this
    lift = math.log10(weight) - onward

    def base_of(c):
        return np.log10((c + ALPHA) / below)

    def score_texts(batches):
        names, c, lp = shared.value
        place = dict(zip(names, range(len(names)), strict=True))
        base, known = base_of(c), c > 0
        logs = lp + lift
        mass = 10 ** logs
        for batch in batches:
            ids, digests, spelled, times, tokens, knowns, bases, scores = ([] for _ in range(8))

            def row(i, d, word, t, n_tokens=0, n_known=0, b=0.0, s=0.0):
                ids.append(i), digests.append(d), spelled.append(word), times.append(t)
                tokens.append(n_tokens), knowns.append(n_known), bases.append(b), scores.append(s)

            for k, (i, text) in enumerate(zip(*(x.to_pylist() for x in batch.columns), strict=True)):
                own = tokens_of(text)
                digest = xxhash.xxh64_intdigest(text or "") - (1 << 63)
                at = [place.get(w, -1) for w in own]
                where = np.array(at, np.int64)
                where = where[where >= 0]
                # the head of a text: its spelling is no token, so it meets none
                row(i, digest, b" %d %d" % (k, digest), 0, len(own) + 1,
                    int(known[where].sum()) + end_known, float(base[where].sum()) + end_base,
                    repeats(where, logs, mass) + len(own) * onward + end_score
                    - (math.lgamma(weight + len(own)) - math.lgamma(weight)) / LN10)
                if len(where) < len(own):
                    for word, t in Counter([w for w, p in zip(own, at, strict=True) if p < 0]).items():
                        row(i, digest, word, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(digests, pa.int64()), pa.array(spelled, pa.binary()),
                 pa.array(times, pa.int32()), pa.array(tokens, pa.int64()), pa.array(knowns, pa.int64()),
                 pa.array(bases), pa.array(scores)],
                ["id", "dg", "word", "t", "n_tokens", "n_known", "base", "score"])

    spark_kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(spark_kind)
    parts = rows.select("id", "text").mapInArrow(
        score_texts, f"id {spark_kind.simpleString()}, dg long, word binary, t int, n_tokens long, "
        "n_known long, base double, score double")
    met = parts.join(words, "word", "left")
    head = F.col("t") == 0
    base = F.log10((F.col("c") + ALPHA) / F.lit(below))
    first = F.col("lp") + lift
    again = F.aggregate(F.sequence(F.lit(1), F.col("t") - 1), F.lit(0.0),
                        lambda out, k: out + F.log10(F.pow(F.lit(10.0), first) + k))
    score = F.when(F.col("t") == 1, first).otherwise(first + again)
    total = met.groupBy("id", "dg").agg(
        F.sum(head.cast("long")).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(head, F.col("n_known")).otherwise(F.col("t") * (F.col("c") > 0).cast("long"))).alias("n_known"),
        F.sum(F.when(head, F.col("base")).otherwise(F.col("t") * base)).alias("base"),
        F.sum(F.when(head, F.col("score")).otherwise(score)).alias("score"))
    per = lambda name: (F.col(name) / F.col("copies"))
    return total.select(
        F.col("id").alias(id_col), per("n_tokens").cast("long").alias("n_tokens"),
        per("n_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        per("base").alias("base_score"), per("score").alias("score"),
        F.explode_outer(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(10)) == 0


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").withColumn("train", ~held_out("doc_id"))
    scored = lattice_scores(docs, public_tokenizers.path("piece_bpe_32k.model"), "train")
    return scored.withColumn("held_out", held_out("doc_id"))
