"""Whitening, importance resampling and SimHash against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from evidentia.llm import resampling, simhash, whitening

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                     T.StructField("component", T.StringType()), T.StructField("n", T.StringType())])


def vectors(spark, rows):
    """Rows (id, vector) with columns whose names the operator uses."""
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], VECS)


# --- whitening ------------------------------------------------------------------------

@pytest.mark.parametrize("values", [
    np.r_[10, 9.99999999, 9.9999, np.full(21, 5.0), np.full(40, 1.0)], np.full(16, 2.0), np.zeros(4), np.exp(-np.arange(90.0)),
    np.r_[np.full(30, 3.0) + 1e-9 * np.arange(30), np.full(30, 1.0) + 1e-5 * np.arange(30)], np.r_[1e30, 1e30, 1.0]])
def test_eigenvectors_of_clustered_spectra(values):
    rng = np.random.default_rng(3)
    d = len(values)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * size
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14
    assert np.abs(a @ x - x * found).max() <= 1e-13 * size


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7).flatmap(lambda d: st.lists(st.lists(st.sampled_from([0.0, 0.5, 1.0, -2.0]), min_size=d, max_size=d),
                                                    min_size=d, max_size=d)))
def test_eigenvectors_of_small_matrices(rows):
    a = np.array(rows) + np.array(rows).T
    found, x = whitening.eigen(a)
    assert np.allclose(found, np.linalg.eigvalsh(a)[::-1], atol=1e-12)
    assert np.allclose((x * found) @ x.T, a, atol=1e-12) and np.allclose(x.T @ x, np.eye(len(a)), atol=1e-13)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-1 << 63, (1 << 63) - 1) | st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=5),
       st.lists(st.integers(-1 << 63, (1 << 63) - 1), min_size=3, max_size=3))
def test_packing_and_limbs_are_exact(rows, middle):
    x = np.array(rows, np.int64)
    assert (whitening.unpacked(whitening.packed(x), 3) == x).all()
    parts = whitening.limbs(x, np.array(middle, np.int64))
    whole = sum(np.vectorize(int, otypes=[object])(p) << (whitening.LIMB * k) for k, p in enumerate(parts))
    assert (whole == x.astype(object) - np.array(middle, object)).all()


def test_whitening_against_numpy_and_exact_integers(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 6)) * [9, 5, 3, 2, 1, 1] + 100
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[3].tolist())] * 40
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [1.0, 2.0]),
           (None, base[0].tolist())]
    got = whitening.whiten(vectors(spark, rows + odd)).toPandas()
    assert len(got) == 4 * (len(rows) + 1) and got["vec_id"].isna().sum() == 4
    x = np.floor(256 * base).astype(np.int64)
    n, sums = len(x), x.sum(axis=0)
    values, vecs = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vecs = values[::-1], vecs[:, ::-1]
    want = (x - sums / n) @ vecs / np.sqrt(values)
    for k in range(4):
        part = got[(got["component"] == k + 1) & got["vec_id"].between(0, 59) & (got["vec_id"] != 7)].sort_values("vec_id")
        mine = part["whitened"].to_numpy()
        theirs = np.delete(want[:, k], 7)
        assert np.allclose(mine * np.sign(mine[0] * theirs[0]), theirs, atol=1e-10)
        assert np.allclose(part["explained"], values[k] / values.sum())
    assert (got["n"] == n).all() and (got["identity_error"] < 1e-12).all()
    deviation = dict(zip(got["vec_id"], got["deviation"]))
    assert all(deviation[i] == int(((n * x[i] - sums) ** 2).sum()) for i in range(60) if i != 7)
    again = whitening.whiten(vectors(spark, rows + odd).repartition(5)).toPandas()
    key = ["vec_id", "component", "whitened"]
    assert np.allclose(got.sort_values(key)["whitened"], again.sort_values(key)["whitened"], rtol=0, atol=1e-13)


def test_whitening_of_very_large_entries_is_exact(spark):
    base = [[3e15, 1.0, -2e14], [-1e15, 5.0, 7e14], [2e15, -9.0, 1e13], [0.0, 0.25, 1e300]]
    found = whitening.fit(vectors(spark, list(enumerate(base))))
    x = [[min(max(math.floor(256 * c), -1 << 63), (1 << 63) - 1) if abs(c) < 1e290 else (1 << 63) - 1 for c in v] for v in base]
    assert found.sums == tuple(map(sum, zip(*x)))
    got = whitening.whiten(vectors(spark, list(enumerate(base)))).toPandas()
    assert got["deviation"].isna().all() and (got["identity_error"] < 1e-9).all()
    assert found.deviation(np.array(x, np.int64)).type == pa.int64()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whiten(vectors(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 0


# --- importance resampling ----------------------------------------------------------------

WORDS = ["Alpha", "beta", "Über", "x1", "你好", "gamma", "delta_e", "b", " z"]
TEXTS = [None, "", " \n-- ", "one", "A_B c\tD", "ÉTÉ été x", " ".join(WORDS * 3), "; ".join(WORDS[::-1] * 4), "a " * 5_000]


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB1 _\téÉ你\x7f\x85-\n"), max_size=30))
def test_features_are_all_runs_of_one_to_three_words(text):
    n, found = resampling.features(text)
    want_n, want = plain_features(text)
    assert n == want_n and sorted(found.tolist()) == sorted(want)


def test_features_of_a_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "_HELD", 7)
    n, found = resampling.features(TEXTS[6])
    assert n == plain_features(TEXTS[6])[0] and sorted(found.tolist()) == sorted(plain_features(TEXTS[6])[1])


def plain_resampling(docs, target, percent=5):
    feats = [plain_features(t) for _, t in docs]
    s, t = Counter(b for _, f in feats for b in f), Counter(b for x in target for b in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, _), (n, f) in zip(docs, feats):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_against_brute_force(spark, make_docs):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(WORDS[(i + k * i) % 9] for k in range(15 + i % 40))) for i in range(300)]
    docs += [(250, docs[200][1])] * 3 + [(None, TEXTS[6])]
    target = ["beta Alpha x1", None, "gamma gamma gamma b"]
    bench = make_docs(list(enumerate(target)))
    got = resampling.resample(make_docs(docs, extra=True).repartition(7), bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(docs, target)
    kept = resampling.draw(make_docs(docs, extra=True), bench, percent=30)
    whole = plain_resampling(docs, target, 30)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in whole if r[4]), key=str)
    assert kept.columns == make_docs([], extra=True).columns


def test_resampling_of_empty_tables(spark, make_docs):
    assert resampling.resample(make_docs([]), make_docs([])).count() == 0
    got = resampling.resample(make_docs([(1, "a"), (2, None)]), make_docs([])).collect()
    assert sorted(map(tuple, got)) == plain_resampling([(1, "a"), (2, None)], [])


# --- SimHash --------------------------------------------------------------------------------

def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "É", "c d", "\x85", "e"]), max_size=9), st.sampled_from([" ", "\n\t", "\x0b"]))
def test_fingerprint(words, gap):
    text = gap + gap.join(words)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "_HELD", 4)
    assert simhash.fingerprint(TEXTS[6]) == plain_fingerprint(TEXTS[6])
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def near_codes(rng, groups, members):
    """Groups of codes a few bits from a middle, among others."""
    out = rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)
    for _ in range(groups):
        middle = rng.integers(0, 1 << 63)
        flips = (1 << rng.integers(0, 63, (members, 4)).astype(object))
        out = np.concatenate([out, np.array([int(middle) ^ int(np.bitwise_xor.reduce(f[:rng.integers(0, 5)], initial=0)) for f in flips],
                                            np.uint64)])
    return np.unique(np.concatenate([out, np.arange(300, dtype=np.uint64)]))


def plain_components(codes):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(codes)):
        for j in np.nonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= 2)[0].tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_index_walk_finds_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "_WALK", 500)
    codes = near_codes(np.random.default_rng(1), 8, 40)
    sorted_codes = codes[np.argsort(simhash.gray_ranks(codes))]
    walked = simhash.Index(sorted_codes, np.full(len(codes), simhash.ALL)).walk(codes)
    got = {(int(codes[q]), int(sorted_codes[x])) for qs, leaves in walked for q, x in zip(qs, leaves)}
    want = {(int(a), int(b)) for a in codes for b in codes[np.bitwise_count(codes ^ a) <= 2]}
    assert got == want


def test_gray_neighbours_differ_in_one_bit(spark):
    codes = np.array([i ^ (i >> 1) for i in range(64)], np.uint64)
    assert simhash.gray_ranks(codes).tolist() == list(range(64))
    high = np.array([1 << 63, (1 << 63) | (1 << 62), 5, 0], np.uint64)
    df = spark.createDataFrame([(int(v),) for v in high.view(np.int64)], "fp long")
    got = [r[0] for r in df.select(simhash.gray_rank(df["fp"])).collect()]
    assert np.argsort(got).tolist() == np.argsort(simhash.gray_ranks(high)).tolist()


@pytest.mark.parametrize("block", [4, 50, 1_024])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    codes = near_codes(np.random.default_rng(block), 6, 60)
    df = spark.createDataFrame([(int(v),) for v in codes.view(np.int64)], "fp long")
    links = [(int(a), int(b)) for a, b in simhash.links(df).collect()]
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in links)
    root = list(range(len(codes)))
    simhash.forest(np.array([place[a] for a, _ in links]), np.array([place[b] for _, b in links]), root)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    assert [find(i) for i in range(len(codes))] == plain_components(codes)


def test_simhash_rows_and_components(spark, make_docs):
    long = " ".join(f"w{i % 977}" for i in range(4_000))
    docs = [(5, None), (3, ""), (9, " \t"), (4, "one two"), (2, "ONE\ntwo"), (11, long), (10, long + " tail"), (None, long), (10, long),
            (None, None), (20, "a b c d e f g h"), (1, "zz")]
    got = simhash.near_duplicates(make_docs(docs, extra=True).repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    codes = np.unique(np.array([plain_fingerprint(t) for _, t in docs], np.uint64))
    comp = dict(zip(codes.tolist(), plain_components(codes)))
    least: dict[int, int] = {}
    for i, t in docs:
        if i is not None:
            c = comp[plain_fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    want = [(i, format(plain_fingerprint(t), "016x"), least[comp[plain_fingerprint(t)]]) for i, t in docs]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(make_docs([])).count() == 0
