"""The FM-index search against a plain scan."""

import hashlib
import random

import numpy as np

from evidentia.llm import decontam as D


def brute(text, items):
    words = D.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        own = D.words_of(item)
        size = min(len(own), D.WINDOW)
        for k in range(len(own) - size + 1 if own else 0):
            for p in range(len(words) - size + 1):
                if words[p:p + size] == own[k:k + size]:
                    hit.update(range(p, p + size))
                    names.add("null" if name is None else str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_suffix_array_and_ranks():
    rng = random.Random(3)
    for _ in range(60):
        text = np.array([0] + [rng.randrange(4) for _ in range(rng.randrange(1, 80))] + [0])
        zeros = np.cumsum(text == 0)
        key = [[(0, zeros[j]) if text[j] == 0 else (1, text[j]) for j in range(i, len(text))] for i in range(len(text))]
        key = [k[:next(n for n, x in enumerate(k) if x[0] == 0) + 1] for k in key]
        assert D.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: key[i])
        w = D.WaveletMatrix(text, 3)
        at = np.arange(len(text))
        c, r = w.access_rank(at)
        assert c.tolist() == text.tolist() and r.tolist() == [int((text[:i] == text[i]).sum()) for i in at]


def test_equals_a_plain_scan(spark, make_docs, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(20)]
    items += [(20, None), (21, "--"), (None, "lonely item text"), (3, items[3][1])]
    docs = []
    for i in range(60):
        text = some(rng.randrange(60))
        if rng.random() < 0.6:
            part = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(text) + 1)
            text[at:at] = part[:rng.choice([5, 10, 30])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper()))
    docs += [(60, None), (61, ""), (62, "A Lonely, ITEM text!"), (5, docs[5][1]), (63, "Éw0 w1")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS spans")
    for block, shard in ((D.BLOCK_WORDS, D.SHARD_WORDS), (40, 30)):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        monkeypatch.setattr(D, "SHARD_WORDS", shard)
        got = D.contaminated(make_docs(docs, extra=True), bench)
        assert sorted(map(tuple, got.collect())) == sorted((i, *brute(t, items)) for i, t in docs)
    assert D.contaminated(make_docs([]), bench).count() == 0
    assert not D.contaminated(make_docs(docs), bench.limit(0)).filter("contaminated").count()


def test_cut_removes_the_spans_only(spark, make_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = [(1, "Über, ALPHA beta -- gamma! rest"), (2, "alpha gamma beta"), (3, "alpha beta gamma"), (4, None)]
    out = {r.doc_id: r for r in D.decontaminate(make_docs(docs, extra=True), bench).collect()}
    assert {i: r.text for i, r in out.items()} == {1: "Über, ! rest", 2: "alpha gamma beta", 4: None}
    assert out[1].n_chars == len(out[1].text) and out[1].spans == "x"
    assert D.decontaminate(make_docs(docs), bench).schema == make_docs(docs).schema
