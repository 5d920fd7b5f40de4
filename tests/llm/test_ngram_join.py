"""The parity-sketch join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import ngram_join as J
from evidentia.llm.common import marks


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(docs):
    """doc index -> smallest id reachable over links of similarity >= 0.75."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [min((docs[j][0] for j in range(len(docs)) if find(j) == find(i)), key=lambda x: (x is None, x or 0))
            for i in range(len(docs))]


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(1, 3)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 6, 8, 30, 90, 300]))]
            if rng.random() < 0.3:
                words += common
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, short, tile", [(1, 64, 2_048), (2, 4, 3), (3, 2, 2)])
def test_components_equal_all_pairs(make_docs, monkeypatch, seed, short, tile):
    """Also with lists of few members taken for long, and cut into small tiles."""
    for name, value in (("SHORT", short), ("TILE", tile), ("DIRECT", 16 if short > 4 else 0), ("DENSE", 8 if short > 4 else 1), ("PIVOTS", 8 if short > 4 else 2)):
        monkeypatch.setattr(J, name, value)
    docs = corpus(seed)
    got = {r.doc_id: r for r in J.near_duplicates(make_docs(docs)).collect()}
    want = brute(docs)
    assert len(set(want)) < len(docs)
    for (i, text), c in zip(docs, want):
        assert (got[i].n_shingles, got[i].component_id) == (len(shingles(text)), c)


def test_near_copies_of_several_texts_in_one_list(make_docs, monkeypatch):
    """Chains of copies of copies, more kinds than pivots, among texts with one passage."""
    monkeypatch.setattr(J, "SHORT", 8)
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "DIRECT", 1)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for kind in range(5):
        words = common + [f"k{kind}x{i}" for i in range(40)]
        for _ in range(30):
            docs.append((len(docs), " ".join(words)))
            words = list(words)
            words[rng.randrange(60, 100)] = f"e{len(docs)}"
    rng.shuffle(docs)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(make_docs(docs)).collect()}
    assert [got[i] for i, _ in docs] == brute(docs)


def test_similar_sets_always_share_a_kept_block():
    rng = np.random.default_rng(5)
    starts = J.band_starts(5000)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        kept = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.1])]
        other = np.unique(np.concatenate((kept, rng.integers(0, 1 << 62, int(rng.integers(0, max(n // 10, 1) + 1))).astype(np.uint64))))
        if not J.similar(base, other):
            continue
        hot = np.sort(rng.choice(base, min(len(base), 20), replace=False))
        heat = rng.integers(1, 50, len(hot))
        a, b = (J.block_keys(s, hot, heat, starts) for s in (base, other))
        assert len(np.intersect1d(a, b)), (len(base), len(other))
        words = J.folded([J.sketch(base, starts), J.sketch(other, starts)])
        far = int(np.bitwise_count(words[0] ^ words[1]).sum())
        assert far <= len(np.setxor1d(base, other)) <= J._differ(len(base), len(other))


def test_edges(make_docs):
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "É two"), (7, "é two"),
            (8, long), (9, long + " y"), (9, long), (None, "one two"), (10, "one two three four five"),
            (None, "nothing like it")]
    got = J.near_duplicates(make_docs(docs, extra=True))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert sorted(map(tuple, rows), key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 29_996, 8), (9, 29_997, 8),
         (9, 29_996, 8), (None, 1, 4), (10, 1, 10), (None, 1, None)], key=str)
    kept = J.keep_one(make_docs(docs, extra=True))
    assert kept.columns == make_docs(docs, extra=True).columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "10", "2", "3", "4", "6", "7", "8", "None"]
    assert J.near_duplicates(make_docs([])).count() == 0


def test_united_lists_hold_all_pairs():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 1 << 40, 300))
    lists = [np.sort(rng.choice(group, rng.integers(2, 300), replace=False)) for _ in range(60)] + [np.array([5, 7]), np.array([5, 9])]
    least = [int(x[np.argmin(J.mix(x.view(np.uint64)))]) for x in lists]
    rows = sorted(zip(least, lists), key=lambda r: r[0])
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([x.tobytes() for _, x in part])], names=["least", "handles"])
               for part in (rows[:20], rows[20:21], rows[21:])]
    got = [np.frombuffer(x, np.int64) for b in J._united(iter(batches)) for x in b.column("handles").to_pylist()]
    assert len(got) < len(lists) and all((np.diff(g) > 0).all() for g in got)
    assert all(any(np.isin(x, g).all() for g in got) for x in lists)


def test_keep_one_of_repeated_rows(make_docs):
    rows = [(1, None, "a"), (1, None, "a"), (1, "", "a"), (1, " ", "b"), (None, "", "a"), (None, "", "a"),
            (5, "one two three", "a"), (5, "one two three", "b"), (5, "one two three", "b"), (9, "one two three", "a"), (None, "one two three", "a")]
    kept = [J.keep_one(make_docs(rows, extra=True).repartition(k)).collect() for k in (1, 5)]
    assert sorted(kept[0], key=str) == sorted(kept[1], key=str)
    assert len([r for r in kept[0] if not (r.text or "").strip()]) == 6
    assert [r.doc_id for r in kept[0] if (r.text or "").strip()] == [5]


def test_marks_tell_nulls_from_values(spark):
    df = spark.createDataFrame([("a", None, "t", [1]), (None, "a", "t", [1]), (None, None, "t", [1]), ("a", None, "t", None), ("a", None, "t", [1])],
                               "id string, host string, text string, more array<int>")
    for whole, n in ((False, 3), (True, 4)):
        got = [tuple(r) for r in df.select(*marks(df, ["id", "host", "text"], whole)).collect()]
        assert len(set(got)) == n and got[0] == got[4]
        assert len({a for a, _ in got}) == 3


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, J.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
