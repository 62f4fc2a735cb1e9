"""Toxicity by a linear-chain conditional random field over tokens.

Training uses a bounded sample: the ``SAMPLE`` toxic and ``SAMPLE`` clean
labelled rows of lowest hash whose crc32(doc_id) mod 3 is not 1, repeats of a
text left out.  Tokens of toxic documents are labelled by the words and word
starts that toxic documents hold far more often than clean ones; the chain (two
states, weights of word, word starts and word end, transitions) is fitted to
these labelled tokens by gradient ascent on the exact likelihood.

Every whole text is then tagged: forward-backward over all its tokens gives each
token's marginal probability, and the document's score is a logistic function,
fitted on the sample, of the marginals' sum and maximum.  Spans are the
offending tokens' code point offsets.  Labels, lang, source and id are no inputs
of a score.

Null and empty texts get the score of a text without offending tokens.  Without
labelled rows of both kinds nothing can be learnt: the score is the share of
toxic rows, 0 without any.  Repeated rows come back as often as they stand; of
repeated labels the highest counts; other columns are left out.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, map_rows, table, tokens_of

SAMPLE = 2_000
BUCKETS = 1 << 18
THRESHOLD = 0.7
LEAST_ODDS, LEAST_DOCS = 3.0, 5
WINDOW = 64
PASSES, RATE = 12, 0.5
CELLS = 1 << 20
_PUNCTUATION = string.punctuation.encode()
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[int]:
    """Hashed features of a token: the word, its starts and its end."""
    core = word.strip(_PUNCTUATION) or word
    named = [b"w" + core, b"4" + core[:4], b"5" + core[:5], b"6" + core[:6], b"e" + core[-3:]]
    return [zlib.crc32(x) % BUCKETS for x in named]


def held_out(id_col: str):
    """The remainder that keeps a row's label out of training."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(3)) == 1


@dataclass
class Model:
    """Weights of the chain and of the document score."""

    weights: np.ndarray  # of the offending state, by feature
    transitions: np.ndarray  # 2 x 2 probabilities-like factors
    document: tuple[float, float, float] | None
    rate: float  # share of toxic rows in training

    def emissions(self) -> Bounded:
        """The offending state's weight of each word."""
        weights = self.weights.tolist()
        return Bounded(lambda w: max(-30.0, min(30.0, sum([weights[f] for f in features(w)]))))

    def scores(self, total: np.ndarray, top: np.ndarray) -> np.ndarray:
        if self.document is None:
            return np.full(len(total), self.rate)
        a, b, c = self.document
        return 1 / (1 + np.exp(-(a + b * np.log(total + 1e-3) + c * top)))


def chain(odds: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward-backward on columns of emission odds (time x texts, longest text
    first); the offending state's marginals."""
    steps, width = odds.shape
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    (t00, t01), (t10, t11) = trans
    forward = np.empty_like(odds)
    forward[0] = odds[0] * t01 / t00
    for t in range(1, steps):
        k = active[t]
        o = forward[t - 1, :k]
        forward[t, :k] = odds[t, :k] * (t01 + t11 * o) / (t00 + t10 * o)
    back = np.ones(width)  # message to the offending state over that to the other
    out = np.zeros_like(odds)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        if t + 1 < steps:
            j = active[t + 1]
            o = odds[t + 1, :j] * back[:j]
            back[:j] = (t10 + t11 * o) / (t00 + t01 * o)
        x = forward[t, :k] * back[:k]
        out[t, :k] = x / (1 + x)
    return out


def overlap(trans: np.ndarray) -> int:
    """How far from a token the rest of its text can change its marginal by 1e-9
    at most: each step contracts any difference by Birkhoff's coefficient."""
    (t00, t01), (t10, t11) = trans
    spread = np.sqrt(t01 * t10 / (t00 * t11))
    factor = abs(1 - spread) / (1 + spread)
    return int(np.ceil(np.log(1e-9) / np.log(max(factor, 1e-3))))


def marginals(emissions: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """The marginals of each text.  Long texts go in windows that overlap by
    :func:`overlap`, and windows of similar length are worked out together."""
    near = overlap(trans)
    wide = max(512, 4 * near)
    parts = [(i, lo, max(0, lo - near), min(len(e), lo + wide + near))
             for i, e in enumerate(emissions) for lo in range(0, len(e), wide)]
    parts.sort(key=lambda p: p[2] - p[3])
    out = [np.empty(len(e)) for e in emissions]
    at = 0
    while at < len(parts):
        steps = parts[at][3] - parts[at][2]
        group = parts[at:at + max(1, CELLS // steps)]
        lengths = np.array([end - start for _, _, start, end in group])
        odds = np.ones((steps, len(group)))
        for column, (i, _, start, end) in enumerate(group):
            odds[:end - start, column] = emissions[i][start:end]
        np.exp(odds, out=odds)
        found = chain(odds, lengths, trans)
        for column, (i, lo, start, end) in enumerate(group):
            hi = min(lo + wide, len(emissions[i]))
            out[i][lo:hi] = found[lo - start:hi - start, column]
        at += len(group)
    return out


def label_tokens(texts: list[list[bytes]], toxic: list[bool]) -> list[np.ndarray]:
    """1 for the tokens of toxic texts that toxic texts hold far more often."""
    seen = {True: Counter(), False: Counter()}
    of = Bounded(lambda w: features(w)[:4])
    for words, bad in zip(texts, toxic, strict=True):
        seen[bad].update({f for w in set(words) for f in of[w]})
    n = {k: sum(t is k for t in toxic) for k in (True, False)}

    def odds(f, bad):
        return np.log((seen[bad][f] + 0.5) / (n[bad] - seen[bad][f] + 0.5))

    marked = {f for f, k in seen[True].items()
              if k >= LEAST_DOCS and odds(f, True) - odds(f, False) >= LEAST_ODDS}
    return [np.array([bad and any(f in marked for f in of[w]) for w in words], np.int8)
            for words, bad in zip(texts, toxic, strict=True)]


def fit_chain(texts: list[list[bytes]], tags: list[np.ndarray], seed: int = 1) -> tuple:
    """Weights and transitions by gradient ascent over windows of tokens."""
    of = Bounded(lambda w: np.array(features(w)))
    windows = [(words[i:i + WINDOW], y[i:i + WINDOW])
               for words, y in zip(texts, tags, strict=True) for i in range(0, len(words), WINDOW)]
    weights = np.zeros(BUCKETS)
    weights_seen = np.full(BUCKETS, 1e-2)
    share = np.clip(np.mean([y.mean() for _, y in windows]), 1e-4, 0.5)
    # transitions as counted in the labelled tokens
    counts = np.full((2, 2), 1.0)
    for _, y in windows:
        np.add.at(counts, (y[:-1], y[1:]), 1)
    trans = counts / counts.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    marked = [k for k, (_, y) in enumerate(windows) if y.any()]
    plain = [k for k, (_, y) in enumerate(windows) if not y.any()]
    few = min(len(plain), 3 * len(marked) + 100)
    bias = np.log(share / (1 - share)) - np.log(trans[0, 1] / trans[0, 0])
    for _ in range(PASSES):
        # all windows with offending tokens, a fresh draw of the others
        chosen = marked + [plain[k] for k in rng.permutation(len(plain))[:few]]
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), 512):
            batch = sorted((windows[k] for k in chosen[lo:lo + 512]), key=lambda x: -len(x[0]))
            ids = [np.array([of[w] for w in words]) for words, _ in batch]
            got = marginals([np.clip(weights[i].sum(axis=1) + bias, -30, 30) for i in ids], trans)
            every = np.concatenate(ids)
            error = np.concatenate([y - p for (_, y), p in zip(batch, got, strict=True)])
            slope = np.bincount(every.ravel(), np.repeat(error, every.shape[1]), BUCKETS)
            slope -= 1e-3 * weights
            weights_seen += slope ** 2
            weights += RATE * slope / np.sqrt(weights_seen)
    return weights, trans, bias


def fit_documents(total: np.ndarray, top: np.ndarray, toxic: np.ndarray, rate: float) -> tuple:
    """A logistic function of the marginals' sum and maximum, weighted to ``rate``."""
    x = np.column_stack([np.ones(len(total)), np.log(total + 1e-3), top])
    weight = np.where(toxic, rate / toxic.mean(), (1 - rate) / (1 - toxic.mean()))
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (weight * (toxic - p)) - 1e-2 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta += np.linalg.solve(curve, slope)
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``2 * sample`` labelled rows, never of the held-out third."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(id_col).agg(
        (F.max(label_col) == 1).alias("bad")).select(F.col(id_col).alias("_id"), "bad")
    counts = {r["bad"]: r["n"] for r in known.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = counts.get(True, 0) / max(1, sum(counts.values()))
    parts = [known.where(F.col("bad") == bad).orderBy(F.xxhash64("_id"), "_id").limit(sample)
             for bad in (True, False)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * sample ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        chosen, "_id").groupBy("_text").agg(  # equal texts are one row, the same one on every run
            F.max("bad").alias("bad"), F.min(F.xxhash64("_id")).alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["_text"] or ""))
    toxic = np.array([r["bad"] for r in rows], bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Model(np.zeros(1), np.ones((2, 2)), None, rate)
    texts = [tokens_of(r["_text"]) for r in rows]
    tags = label_tokens(texts, toxic.tolist())
    filled = [k for k, words in enumerate(texts) if words]
    weights, trans, bias = fit_chain([texts[k] for k in filled], [tags[k] for k in filled])
    # every token has one word feature, so the bias can go to the transitions
    trans = trans * np.array([1.0, np.exp(bias)])
    model = Model(weights, trans, None, rate)
    total, top = summed([tokens_of(r["_text"]) for r in rows], model)[:2]
    model.document = fit_documents(total, top, toxic, rate)
    return model


def summed(texts: list[list[bytes]], model: Model, emission=None) -> tuple:
    emission = emission or model.emissions()
    got = marginals([np.fromiter(map(emission.__getitem__, words), float, len(words))
                     for words in texts], model.transitions)
    return (np.array([p.sum() for p in got]), np.array([p.max() if len(p) else 0.0 for p in got]), got)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """id, score, predicted and ``spans`` array<struct<start, end, p>> of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # 2 MB, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        model = Model(**shared.value)
        emission = model.emissions()

        def tag(ids, texts):
            if model.document is None:
                return ids, [model.rate] * len(ids), [int(model.rate >= threshold)] * len(ids), [[]] * len(ids)
            total, top, got = summed([tokens_of(t) for t in texts], model, emission)
            scores = model.scores(total, top)
            spans = []
            for text, p in zip(texts, got, strict=True):
                hit = set(np.flatnonzero(p > 0.5).tolist())
                spans.append([{"start": m.start(), "end": m.end(), "p": float(p[k])}
                              for k, m in enumerate(_TOKEN.finditer(text)) if k in hit] if hit else [])
            return ids, scores, (scores >= threshold).astype(np.int32), spans
        return tag

    return map_rows(docs.select(id_col, text_col), make,
                    f"`{id_col}` {kind}, score double, predicted int, "
                    "spans array<struct<start:int,end:int,p:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(
        vars(train(docs, labels, id_col, text_col)))

    def run(batches):
        import pyarrow as pa

        model = Model(**shared.value)
        emission = model.emissions()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            if model.document is None:
                scores = np.full(len(texts), model.rate)
            else:
                scores = model.scores(*summed([tokens_of(t) for t in texts], model, emission)[:2])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
