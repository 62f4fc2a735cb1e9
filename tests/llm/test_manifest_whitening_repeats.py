"""Merkle manifest, whitening and repeated passages against brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import op11_merkle_manifest as op11
from scrubline.llm import op12_whitening as op12
from scrubline.llm import op13_suffix_trees as op13
from scrubline.llm.common import table
from scrubline.session import shared_folder

SF = "/root/testdata/sf0.001"
DOCS = ("doc_id long, source string, lang string, n_chars long, text string, did long, h long, "
        "leaf string, at long, g long, id string, vec int, x int, starts string")
EXTRA = (5, 6, "l", 7, 8, "x", 9, 10, "s")


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Leaf by leaf, with the whole tree in memory."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h(*[field(v) for v in (r[0], r[1], r[2], r[3], text)])

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([h(*below[k:k + 3]) for k in range(0, len(below), 3)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 3 * 3:i // 3 * 3 + 3]
            out.append((i % 3, [d for k, d in enumerate(run) if k != i % 3]))
            i //= 3
        return out

    if not rows:
        return []
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for s in sources:
        members[s] = sorted((r for r in rows if r[1] == s),
                            key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = up([leaf(r, r[4]) for r in members[s]])
    top = up([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for place, s in enumerate(sources):
        for i, r in enumerate(members[s]):
            proof = siblings(trees[s], i) + siblings(top, place)
            now = r[4]
            if now is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = now.replace("\n", "")
            d = leaf(r, now)
            for k, others in proof:
                d = h(*others[:k], d, *others[k:])
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], root,
                        h(*[x for _, o in proof for x in o]), d, d == root))
    return out


def full(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_manifest(spark, n):
    rows = [(k * 7 % 1009, None if k % 50 == 1 else f"s{k % 4 * (k % 3)}", "en", k, f"text\n{k}\n") for k in range(n)]
    if n == 5:  # null id and text, repeated rows, an id with two texts, long text, odd letters
        rows += [(None, "s0", None, None, None), (7, "s0", "en", 3, "abc"), (7, "s0", "en", 3, "abc"),
                 (7, "s0", "en", 3, "abd\n"), (12, "é", "fr", 1, "😀\n" * 40_000), (13, "z", "", 0, ""),
                 (-4, "é", "fr", 1, "x\ny"), (None, None, None, None, "q\n")]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)
    got = op11.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert full(got) == sorted(brute_manifest(rows), key=repr)


def test_manifest_refuses_a_wrong_leaf():
    records, top = op11.climb([(4, bytes([k]) * 32) for k in range(4)])
    path = op11.descend(dict(records), top, op11.digits_of(2, 4), bytes([2]) * 32)
    assert op11.fold(bytes([2]) * 32, path) == top
    with pytest.raises(ValueError):
        op11.descend(dict(records), top, op11.digits_of(2, 4), bytes([3]) * 32)


def test_queries_leave_only_their_result(spark):
    folder = shared_folder(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    op11.op11_merkle_manifest(spark, SF).count()
    op12.op12_whitening(spark, SF).count()
    op13.op13_suffix_trees(spark, SF).count()
    new = {f.split("-")[0] for f in set(os.listdir(folder)) - before}
    assert new <= {"op11", "op13"}


@pytest.mark.parametrize("name", ["op11", "op13"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    query, sql = {"op11": (op11.op11_merkle_manifest, op11.OP11_SQL),
                  "op13": (op13.op13_suffix_trees, op13.OP13_SQL)}[name]
    got = query(spark, SF)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert full(got) == sorted(map(tuple, want), key=repr)


def test_rank_one_updates():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 40):
        values, vectors, want = np.zeros(size), np.eye(size), np.zeros((size, size))
        for k in range(3 * size):
            x = rng.normal(size=size) * 10.0 ** rng.integers(-3, 4, size)
            if k % 4 == 0:
                x = np.eye(size)[k % size] * 3
            if k % 5 == 0:
                x[:] = 2.0
            weight = float(rng.uniform(0.1, 2))
            values, vectors = op12.rank_one(values, vectors, weight, x)
            want += weight * np.outer(x, x)
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12)
        assert np.allclose(vectors * values @ vectors.T, want, atol=1e-11 * np.abs(want).max())
        assert (np.diff(values) >= 0).all()


def brute_whitening(x):
    n, s = len(x), x.sum(axis=0)
    away = (n * x - s) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(8, int((values > 1e-12 * values.sum()).sum()))
    return away @ vectors[:, :m] / np.sqrt(values[:m]), values[:m] / values.sum(), \
        [sum(int(v) ** 2 for v in row) for row in n * x - s]


def against_brute(got, x, ids):
    whitened, explained, deviation = brute_whitening(x)
    m = whitened.shape[1]
    rows = got.collect()
    assert len(rows) == len(x) * m
    found = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(m):
        mine = np.array([found[i, c + 1]["whitened"] for i in ids])
        assert np.allclose(mine * np.sign(mine @ whitened[:, c]), whitened[:, c], atol=1e-8)
        for i, d in zip(ids, deviation, strict=True):
            r = found[i, c + 1]
            assert r["deviation"] == d and r["n"] == len(x)
            assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening(spark):
    df = table(spark, SF, "embeddings")
    rows = df.collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], float)).astype(np.int64) + 100_000
    ids = [r["vec_id"] for r in rows]
    for parts in (1, 23):
        against_brute(op12.whiten(df.repartition(parts)), x, ids)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, x array<int>, vec int, n int, component string"
    rng = np.random.default_rng(5)
    good = [(k, rng.normal(size=3).tolist(), [1], 2, 3, "c") for k in range(40)]
    good += [(100 + k, [1.0, 2.0, 3.0], None, None, None, None) for k in range(60)]  # one common vector
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 2.0]),
           (204, [float("inf"), 1.0, 2.0]), (205, [1.0, 2.0]), (None, None)]
    df = spark.createDataFrame(good + [(*b, None, None, None, None) for b in bad], schema)
    x = np.floor(1024 * np.array([g[1] for g in good], np.float32).astype(float)).astype(np.int64) + 100_000
    against_brute(op12.whiten(df.repartition(5)), x, [g[0] for g in good])
    same = df.where("vec_id >= 100 and vec_id < 200")
    for none in (df.limit(0), same, same.limit(1), df.where("vec_id > 199")):
        empty = op12.whiten(none)
        assert empty.count() == 0
        assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_large_numbers():
    x = np.array([[2**40, 5], [3, -7], [2**40 + 1, 2**33]], np.int64)
    n, sums = 2**22, [int(v) * 2**20 for v in x.sum(axis=0)]
    away = op12.centred(x, n, sums)
    want = [[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x]
    assert away.tolist() == want
    assert op12.square_sums(away) == [v if v < 2**63 else None for v in (sum(a * a for a in row) for row in want)]
    small = np.array([[2**46, -2**45 - 3], [-5, 2**24 - 1]], np.int64)
    assert op12.square_sums(small)[1] == 25 + (2**24 - 1) ** 2
    assert op12.square_sums(small)[0] is None


def brute_repeats(rows):
    least: dict[tuple, float] = {}
    cut = [(float("inf") if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in cut:
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, w), r in zip(cut, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def odd_texts():
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "A", "a", "\x00x", "😀"]
    passage = " ".join(rng.choice(words, 60))
    short = " ".join(rng.choice(words, 13))
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words, int(rng.integers(0, 60))))
        if k % 2:
            text += ["\n", "\t", "  ", " \x0b"][k % 4] + passage[rng.integers(0, 60):]
        if k % 7 == 0:
            text = short + " " + text + "\r\n" + short
        rows.append((int(rng.integers(0, 40)), text))
    rows += [(None, passage), (None, passage + " tail"), (3, None), (4, ""), (5, "  \n"), (6, "a " * 13), (7, "a " * 500),
             (-1, "a " * 12), (9, passage.upper()), (9, passage), (9, passage), (50, " ".join(f"v{k % 4999}" for k in range(30_000)))]
    return rows


@pytest.mark.parametrize("group", [16, 300, 200_000])
def test_repeats(spark, group):
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows],
                               "doc_id long, text string, did string, h string, starts string, at string")
    got = op13.repeat_spans(df.repartition(5), group=group)
    assert full(got.drop("spans")) == brute_repeats(rows)
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_repeats_removed_from_texts(spark):
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, did string")
    kept = op13.remove_repeats(df)
    assert kept.schema == df.schema
    got = [(r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(r[0], r[3]) for r in brute_repeats(rows)], key=repr)
    assert op13.repeat_spans(df.limit(0)).count() == 0


def test_hot_prefixes_are_split(spark):
    """A prefix in every document outgrows a group and is taken by whole windows."""
    rows = [(k, f"u{k} one two three four five six seven eight nine ten eleven twelve thirteen v{k % 3}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total, heavy = op13.count_prefixes(op13._base(df, "doc_id", "text"), 64)
    assert total == 600 and len(heavy)
    assert full(op13.repeat_spans(df, group=64).drop("spans")) == brute_repeats(rows)


def test_hot_prefixes_of_some_batches_only(spark):
    """Batches without an overfull prefix, beside some that have one."""
    hot = [(k, f"u{k} one two three four five six seven eight nine ten eleven twelve thirteen v{k % 3}") for k in range(200)]
    cold = [(1000 + k, " ".join(f"c{k % 2}x{i}" for i in range(40))) for k in range(6)]
    df = spark.createDataFrame(hot + cold, "doc_id long, text string").repartitionByRange(2, F.col("doc_id") >= 1000)
    assert len(op13.count_prefixes(op13._base(df, "doc_id", "text"), 64)[1])
    assert full(op13.repeat_spans(df, group=64).drop("spans")) == brute_repeats(hot + cold)
