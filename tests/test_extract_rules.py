"""Rule fixtures for the extraction rules (cases from FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import extract as X

# text, strict verdict, loose verdict, strict confidence
VERDICT_CASES = [
    ("Verdict: [true] Confidence score: [85]", "true", "true", 85),
    ("maybe Confidence score: 80", "maybe", "maybe", 80),
    ("Verdict: unknown", "maybe", "maybe", None),
    ("not true, false", None, "true", None),
    ("Verdict: false Confidence score: 150", "false", "false", None),
    ("(false) 70", "false", "false", 70),
    ("true - 1000", "true", "true", 100),
    ("Verdict: [true/false/maybe]", "true", "true", None),
    ("[maybe]\nsecond 9", "maybe", "maybe", None),
    ("", None, None, None),
]

BULLET_CASES = [
    ("Bullets: -- a b -- c d Internal knowledge: false", ["a b", "c d"]),
    ("Bullets: 1. a 2) b", ["a", "b"]),
    ("Verdict: true", []),
    ("Bullets: -- in 2016. -- x", ["in", "x"]),
    ("Bullets: -- well-known fact", ["well-known fact"]),
    ('Here is the analysis:\n-- [p] \n-- [q]\nVerdict: true', ["p", "q"]),
    ('See 2 "first point" and 3 "second"', ["first point", "second"]),
    ("-- a\u0001b -- c\u0001", ["a\u0001b", "c\u0001"]),
    (None, []),
]

KNOWLEDGE_CASES = [
    ("Internal knowledge: yes", "true"),
    ("internally knowledge = [no]", "false"),
    ("I used no internal knowledge.", "false"),
    ("The text does not indicate any internal facts", "false"),
    ("bullets here internally: true", "true"),
    ("internally: true and more", None),
    ("nothing", None),
]

JUDGE_CASES = [
    ("Criterion 1: --1--\nCriterion 2: --0--\nCriterion 3: --3--\nCriterion 4: -1\n"
     "Number of relevant bullets: --4--", (1, 0, 3, 1, 4)),
    ("Criterion 1: --1--", (1, None, None, None, None)),
    ("criterion 1: --1--", (None, None, None, None, None)),
]


def _one(spark, rows, schema, exprs):
    return spark.createDataFrame(rows, schema).select(*exprs).collect()


@pytest.mark.parametrize("text,strict,loose,conf", VERDICT_CASES)
def test_verdict_and_confidence(spark, text, strict, loose, conf):
    r = _one(spark, [(text,)], "t string",
             [X.verdict_strict("t").alias("s"), X.verdict_loose("t").alias("l"),
              X.confidence_strict("t").alias("c")])[0]
    assert (r["s"], r["l"], r["c"]) == (strict, loose, conf)


def test_loose_confidence_takes_first_number(spark):
    # the bracket defeats the loose first rule, the first-line rule still finds 50
    r = _one(spark, [("12 and 34",), ("Confidence score: [50]",)], "t string",
             [X.confidence_loose("t").alias("c"), X.confidence_strict("t").alias("s")])
    assert [(x["c"], x["s"]) for x in r] == [(12, 34), (50, 50)]


@pytest.mark.parametrize("text,expected", BULLET_CASES)
def test_bullets(spark, text, expected):
    r = _one(spark, [(text,)], "t string", [X.bullets("t").alias("b")])[0]
    assert list(r["b"]) == expected


@pytest.mark.parametrize("text,expected", KNOWLEDGE_CASES)
def test_internal_knowledge(spark, text, expected):
    r = _one(spark, [(text,)], "t string", [X.internal_knowledge("t").alias("k")])[0]
    assert r["k"] == expected


@pytest.mark.parametrize("text,expected", JUDGE_CASES)
def test_judge_fields(spark, text, expected):
    r = _one(spark, [(text,)], "t string", [X.judge_scores("t").alias("s")])[0]["s"]
    assert tuple(r) == expected


def test_judge_empty_text_is_null(spark):
    r = _one(spark, [("",)], "t string", [X.judge_scores("t").alias("s")])[0]
    assert r["s"] is None


def test_tagged_sections(spark):
    p = "<Claim>: c\n\n<Evidence 1>: first\n\n<Evidence 2>: second\n\n<Instruction>: go"
    e1, e2 = X.evidence_pair(F.col("t"))
    r = _one(spark, [(p,), ("<Claim>: only",)], "t string", [e1.alias("a"), e2.alias("b")])
    assert (r[0]["a"], r[0]["b"]) == ("first", "second")
    assert (r[1]["a"], r[1]["b"]) == (None, None)


def test_first_token(spark):
    r = _one(spark, [("  true because",), ("   ",)], "t string", [X.first_token("t").alias("f")])
    assert [x["f"] for x in r] == ["true", "<EMPTY>"]


def plain_fk(text):
    """Word by word, from the definition."""
    import re
    words = text.split()
    if not words:
        return None
    total = 0
    for w in words:
        w = re.sub("[^a-z]", "", w.lower())
        groups = len(re.findall("[aeiouy]+", w))
        total += max(groups - (1 if w.endswith("e") and groups > 1 else 0), 1) if w else 0
    sentences = max(len(re.findall("[.!?]+", text)), 1)
    return 0.39 * len(words) / sentences + 11.8 * total / len(words) - 15.59


def test_readability_of_words_and_of_a_million_letters(spark):
    import time

    from evidentia.functions import text as TX
    texts = ["the apple tree. be eye bee! queue ease rhythm", "ee e ae ie bre breeze x-ray tie-e", "Made, the 12 (a) ...", "one " * 50,
             "aebe bebeb ebebe yyy ye bye beye", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.round(TX.fk_grade(F.col("t")), 6)).collect()]
    assert got == [None if plain_fk(t) is None else round(plain_fk(t), 6) for t in texts]
    long = spark.createDataFrame([("ab" * 500_000 + "e",), ("b" * 1_000_000 + "e",), ("e" * 1_000_000,), ("be" * 500_000,)], "t string")
    t0 = time.perf_counter()
    assert all(r[0] is not None for r in long.select(TX.fk_grade(F.col("t"))).collect())
    assert time.perf_counter() - t0 < 20


def test_each_rule_stands_once_in_its_column(spark):
    """A rule named twice is run twice on every answer."""
    df = spark.createDataFrame([("x",)], "response string")
    for col, n in ((X.verdict_strict("response"), 2), (X.confidence_strict("response"), 3),
                   (X.internal_knowledge("response"), 2), (X.bullet_block("response"), 1)):
        plan = df.select(col.alias("x"))._jdf.queryExecution().optimizedPlan().expressions().toString()
        assert plan.split(" AS ")[0].count("regexp_extract") == n, plan


def test_strict_rules_at_the_edges_of_python_white_space(spark):
    """First lines, ends and items are found without stripping the whole text first."""
    rows = [("\x1c\n [true 7\n8", "true", 7, []), ("　(maybe)\r5 6 1234", "maybe", 6, []),
            ("\n(\nfalse", None, None, []), ("x 3 4\n5", None, 4, []), ("true 101", "true", None, []),
            ("false ٣ 12", "false", None, []), ("- [ ] ] - [\x1f] -- [a\t] 2 \"[]\" 3 \" \"", None, 3,
                                                    ["", "a\t] 2 \"[]\" 3 \" \"", ""]),
            ("confıdence ſcore: 9 İnternal", None, 9, []), ("Bu: - a İnternal - b", None, None, ["a"])]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, response string")
    got = df.select("i", X.verdict_strict("response"), X.confidence_strict("response"), X.bullets("response")).orderBy("i").collect()
    assert [tuple(g)[1:] for g in got] == [r[1:] for r in rows]


def test_internal_knowledge_at_the_very_end(spark):
    rows = [("internally: true\x1f \n", "true"), ("internally: false .", None), ("a\nInternal knowledge: [YES]", "true"),
            ("no internal knowledge; internally: true", "false"), (None, None), ("", None)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, response string")
    got = df.select("i", X.internal_knowledge("response").alias("k")).orderBy("i").collect()
    assert [g["k"] for g in got] == [r[1] for r in rows]


def test_observed_counts_carry_no_prompt(spark, monkeypatch):
    """F16: below the counts no column is pruned."""
    from evidentia.plans import registry as R
    seen = []
    monkeypatch.setattr(R.OB, "stage_observed", lambda df, *a: (seen.append(df.columns), (None, {"n": 1}))[1])
    R.QUERIES["extraction_quality_observed"](spark, "/root/testdata/sf0.001")
    assert "prompt_text" not in seen[0] and "response" not in seen[0]


def test_missing_numbers_reach_try_cast_as_null(spark):
    """try_cast throws and catches an error for every '' that it is given."""
    texts = [("Criterion 1: n/a Criterion 1: --2-- Criterion 2: --99999999999--",), (None,), ("criterion 1: 3",), ("Criterion 1: -",)]
    df = spark.createDataFrame(texts, "t string")
    fields = df.select(X.judge_field("t", "Criterion 1:").alias("a"), X.judge_field("t", "Criterion 2:").alias("b"))
    assert [tuple(g) for g in fields.collect()] == [(2, None), (None, None), (None, None), (None, None)]
    for x in (fields, df.select(X.confidence_strict("t").alias("c"))):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "try_cast" in plan
        assert "try_cast(regexp_extract(" not in plan and "regexp_extract(lower" not in plan and ", regexp_extract(t" not in plan, plan
