"""Rules of the operators on small inputs: gaps, duplicates, one-sided pairs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidentia.operators import claims as C
from evidentia.operators import enrich as EN
from evidentia.operators import pairs as PR
from evidentia.operators import prompts as P

EVIDENCE = "claim_id string, claim string, factcheck_verdict string, evidence string, evidence_stance string, row_ord int, relevant boolean"


def evidence(spark, texts, stance="supports"):
    return spark.createDataFrame([("c-1", "claim", "True", t, stance, i, True) for i, t in enumerate(texts)], EVIDENCE)


@pytest.mark.parametrize("wide", [False, True])
def test_gaps_are_no_evidence(spark, wide):
    ev = evidence(spark, [None, "", "good", "better"])
    grouped = C.group_claims(ev)
    assert grouped.first()["supports"] == [None, "", "good", "better"]  # the export keeps them
    claims = C.from_wide(C.to_wide(grouped, 4, 0)) if wide else C.group_claims(ev, max_per_stance=2)
    for k, want in ((1, ["good"]), (2, ["good", "better"])):
        assert C.select_evidence(claims, k, 0).first()["selected_evidence"] == want
        assert C.select_evidence(grouped, k, 0).first()["selected_evidence"] == want
    assert C.select_evidence(claims, 2, 0, inverse=True).first()["selected_evidence"] == ["better", "good"]
    assert C.select_evidence(claims, 3, 0).count() == 0
    assert C.group_claims(evidence(spark, [None, ""]), max_per_stance=2).count() == 0


def test_lexical_scores_are_row_local(spark):
    rows = [("k", "a a b", "b c"), ("k", "a", "a"), ("k", "x", "y"), ("k", "..", "a"), ("k", "..", "--"),
            ("k", "word " * 5000, "word " * 4000 + "other")]
    pairs = spark.createDataFrame(rows, "key string, candidate string, reference string")
    scores = PR.lexical_scores(pairs, ["key"])
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r)[1:] for r in scores.collect()]
    assert got == [(0.3333, 0.5, 0.4), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (None, 0.0, None), (1.0, 0.9998, 0.9999)]


def test_lexical_scores_equal_counting(spark):
    """Also with more unmatched tokens than are looked up one by one."""
    import random
    rng = random.Random(3)
    rows = []
    for i in range(60):
        size = rng.choice([1, 5, 30, 200])
        rows.append((i, *(" ".join(f"t{rng.randrange(size * 2)}" for _ in range(rng.randrange(1, size + 1))) for _ in "ab")))
    got = {r.key: (r.precision, r.recall) for r in PR.lexical_scores(
        spark.createDataFrame(rows, "key int, candidate string, reference string"), ["key"]).collect()}
    for i, a, b in rows:
        a, b = a.split(), b.split()
        want = (sum(t in set(b) for t in a) / len(a), sum(t in set(a) for t in b) / len(b))
        assert [round(x, 4) for x in want] == list(got[i])


def test_evidence_scores_stand_on_the_row(spark):
    rows = [("k", ["a b", "c"], ["a x", "c c"]), ("k", [], ["a", "b"]), ("k", ["a"], ["a"]), ("k", None, None), ("k", ["--"], ["a", " "])]
    df = spark.createDataFrame(rows, "key string, bullets array<string>, ev array<string>")
    scores = PR.evidence_scores(df, ["key"], "ev")
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in scores.collect()] == [(0.4, 0.5), (None, None), (1.0, None), (None, None), (None, None)]


def test_scores_map_takes_duplicates(spark):
    s = spark.createDataFrame([("a", "claim", 0.9, 1), ("a", "claim", 0.2, 2), ("a", "evidence_1", None, 1), ("b", "other", 0.5, 1)],
                              "id string, target string, f1 double, row_ord int")
    assert {r.id: r.scores for r in PR.scores_map(s, ["id"], order="row_ord").collect()} == {
        "a": {"claim": 0.2, "evidence_1": None}, "b": {}}
    assert PR.scores_map(s, ["id"]).filter("id = 'a'").first().scores["claim"] == 0.9


def test_greedy_match_keeps_one_sided_pairs(spark):
    vec = spark.createDataFrame([(0, 0, 1, [1.0, 0.0]), (0, 1, 2, [1.0, 0.0]), (1, 0, 3, [1.0, 0.0])],
                                "pair_id long, side int, tok_id long, vec array<double>")
    assert sorted(map(tuple, PR.greedy_match(vec).collect())) == [(0, 1.0, 1.0, 1.0), (1, None, None, None)]


def test_merge_duplicates_and_must_match(spark):
    left = spark.createDataFrame([("a",), ("b",)], "id string")
    right = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("a", 2, 0.2)], "id string, row_ord int, score double")
    assert sorted(map(tuple, EN.left_merge(left, right, ["id"], order="row_ord").collect())) == [("a", 0.3), ("b", None)]
    with pytest.raises(PySparkException, match="row without a partner.*b"):
        EN.left_merge(left, right, ["id"], order="row_ord", require_all=True).collect()
    assert EN.left_merge(left.filter("id = 'a'"), right, ["id"], order="row_ord", require_all=True).count() == 1


def test_coverage_of_repeated_and_missing_keys(spark):
    left = spark.createDataFrame([(f"c{i}",) for i in (1, 1, 2, 3, 4, 5, 6, 7)], "claim_id string")
    right = spark.createDataFrame([("c1",), ("c9",), ("c9",)], "claim_id string")
    assert tuple(EN.coverage(left, right, ["claim_id"]).first()) == (7, 2, 1, 6, "c2,c3,c4,c5,c6")


def test_unknown_model_has_no_template(spark):
    df = spark.createDataFrame([("llama", "p"), ("gpt", "p")], "model string, p string")
    assert "p" in df.filter("model = 'llama'").select(P.chat_wrap(F.col("model"), F.col("p"))).first()[0]
    with pytest.raises(PySparkException, match="no chat template for model gpt"):
        df.select(P.chat_wrap(F.col("model"), F.col("p"))).collect()
    assert "<<SYS>>" in P.CHAT_TEMPLATES["mistral"] and "{system}" not in "".join(P.JUDGE_TEMPLATES.values())


@pytest.mark.parametrize("style,needed", [
    ("bullet_first", ["whole number from 1", "100", "know yourself", "do not mention"]),
    ("verdict_first", ["whole number from 1", "100", "know yourself", "do not mention"]),
    ("verdict_conf", ["whole number from 1", "100"]), ("verdict_only", ["true, false or maybe"])])
def test_instructions_hold_the_rules_of_the_parsers(style, needed):
    for prompt in P.PROMPT_TYPES:
        assert all(x in P.instruction_text(style, prompt) for x in needed)
