"""Registered queries against their SQL, and the pipeline stage by stage."""

import hashlib
import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402
from evidentia.llm import line_quality, secret_scan  # noqa: E402
from evidentia.llm.common import ASCII_LOWER  # noqa: E402
from evidentia.llm.queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402
from test_brute_force import plain_entropy_spans, plain_quality  # noqa: E402
from test_ngram_join import brute as all_pairs  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = LLM_QUERIES[name](spark, SF)
    res = con.execute(LLM_ORACLES[name])
    cols = [d[0] for d in res.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]
    assert sorted(df.columns) == sorted(cols)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


def plain_hits(text, items):
    """Words of the text, and which of them lie in a window of an item."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = set()
    for t in items:
        w = find(t)
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    words = find(text)
    hit = {i + k for n in {len(x) for x in windows} for i in range(len(words) - n + 1) if tuple(words[i:i + n]) in windows for k in range(n)}
    return words, [w for i, w in enumerate(words) if i not in hit]


def test_pipeline_stages(spark):
    """Each stage against plain code on what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        out = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r.asDict() for r in out.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert out.schema == docs.schema
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        texts = {i: r.get("text") for i, r in after.items()}
        if k == 0:
            judged = plain_quality([(i, r["text"], r["source"]) for i, r in before.items()], line_quality.MAX_DOCS, line_quality.MAX_SHARE)
            assert texts == {w[0]: w[4] for w in judged if w[3]} and len(texts) < len(before)
        elif k == 1:
            rows = [(i, r["text"]) for i, r in before.items()]
            comps = dict(zip((i for i, _ in rows), all_pairs(rows)))
            assert set(after) == set(comps.values()) and all(after[i] == before[i] for i in after)
        elif k == 2:
            cleaned = {i: plain_hits(r["text"], bench) for i, r in before.items()}
            assert set(after) == {i for i, (words, left) in cleaned.items() if left or not words}
            assert any(words != left for words, left in cleaned.values())
            for i, text in texts.items():
                words, left = cleaned[i]
                assert plain_hits(text, [])[0] == left and (words != left or text == before[i]["text"])
        elif k == 3:
            for i, r in before.items():
                base = secret_scan.base_spans(r["text"])
                assert texts[i] == secret_scan.redact(r["text"], base + plain_entropy_spans(r["text"], base))
        else:
            assert set(after) == set(before) and all(r["taken"] <= 3 * r["size"] for r in after.values())
        seen.append(name)
        docs = out
    assert len(seen) == 5
    last = corpus_pipeline.run(spark, SF)
    key = lambda rows: hashlib.sha256(repr(sorted(map(tuple, rows))).encode()).hexdigest()
    assert key(last.collect()) == key(docs.collect())


def test_pipeline_on_empty_and_odd_tables(spark, make_docs):
    for rows in ([], [(None, None), (1, ""), (2, "a b c"), (2, "a b c")]):
        docs = make_docs(rows, extra=True)
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert mixed.count() == docs.count() and all(r.taken == 0 or r.size > 0 for r in mixed.collect())
