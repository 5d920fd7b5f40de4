"""Model hooks with deterministic stub models: prompts -> responses ->
extraction, logits -> ACU, pairs -> scores."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidentia.functions import logits as L
from evidentia.operators import claims as C
from evidentia.operators import hooks as H
from evidentia.operators import prompts as P
from evidentia.plans.extraction import extract_answers
from evidentia.sources import surrogate as S

SF = "/root/testdata/sf0.001"

# the stub models live in this test module, which Python workers cannot import
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _stub_generate():
    calls = {"n": 0}

    def generate(batch):
        calls["n"] += 1
        assert len(batch) <= 4
        return [f"Bullets: -- point {len(p) % 7} -- other Verdict: true Confidence score: {len(p) % 90}"
                for p in batch]
    return generate


def _stub_logits():
    return lambda batch: [{"true": float(len(p) % 5), "false": 1.0, "maybe": 0.5} for p in batch]


def _stub_scorer():
    return lambda cands, refs: [(0.5, 0.25, 1 / 3) for _ in cands]


def test_generation_path_keeps_keys(spark):
    cl = C.group_claims(S.evidence(spark, SF), keep_null_verdict=False, max_per_stance=2)
    prompts = P.build_prompts(cl, "bullet_first", 2, 0).select(
        "claim_id", F.col("basic_prompt").alias("prompt_text"))
    out = H.complete(prompts, _stub_generate)
    parsed = extract_answers(out)
    rows = parsed.select("claim_id", "prompt_text", "verdict", "confidence", "bullets").collect()
    assert len(rows) == prompts.count() > 0
    for r in rows:
        assert r["verdict"] == "true"
        assert r["confidence"] == len(r["prompt_text"]) % 90
        assert list(r["bullets"]) == [f"point {len(r['prompt_text']) % 7}", "other"]


def test_logit_hook_feeds_acu(spark):
    df = spark.createDataFrame([("a", "2support", "x" * 3), ("b", "2refute", "x" * 4)],
                               "claim_id string, mode string, prompt_text string")
    out = H.first_token_logits(df, _stub_logits)
    p = L.softmax(F.col("logits"))
    got = {r["claim_id"]: r for r in out.select("claim_id", L.argmax_token(F.col("logits")).alias("a"),
                                                p.alias("p")).collect()}
    assert got["a"]["a"] == "true" and got["b"]["a"] == "true"
    assert abs(sum(got["a"]["p"].values()) - 1.0) < 1e-12


def test_pair_scorer_hook(spark):
    df = spark.createDataFrame([("k1", "a b", "b c"), ("k2", "x", "y")],
                               "pair string, candidate string, reference string")
    rows = H.score_pairs(df, _stub_scorer).orderBy("pair").collect()
    assert [(r["precision"], r["recall"]) for r in rows] == [(0.5, 0.25), (0.5, 0.25)]


def test_completions_come_back_without_the_prompts(spark):
    """the texts pass as Arrow columns, and only the kept columns come back."""
    df = spark.createDataFrame([(1, "a", "xy"), (2, None, None), (3, "b", "")], "n int, k string, prompt_text string")
    out = H.complete(df, lambda: lambda batch: [None if t == "xy" else f"<{t}>" for t in batch], batch_size=2, keep=["k", "n"])
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["k", "n", "response"]
    assert {tuple(r) for r in out.collect()} == {("a", 1, None), (None, 2, "<>"), ("b", 3, "<>")}
    whole = H.complete(df, lambda: lambda batch: [t.upper() for t in batch])
    assert whole.columns == [*df.columns, "response"] and whole.filter("n = 1").first().response == "XY"
