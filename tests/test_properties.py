"""Property tests: logit maths, readability, round trips, self agreement."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import logits as L
from evidentia.functions.text import fk_grade, syllables

logit = st.floats(min_value=-20, max_value=20, allow_nan=False)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(logit, logit, logit, logit, logit, logit), min_size=1, max_size=20))
def test_softmax_delta_acu_ranges(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    m1 = F.create_map(F.lit("true"), F.col("a"), F.lit("false"), F.col("b"), F.lit("maybe"), F.col("c"))
    m2 = F.create_map(F.lit("true"), F.col("d"), F.lit("false"), F.col("e"), F.lit("maybe"), F.col("f"))
    p1, p2 = L.softmax(m1), L.softmax(m2)
    dp = L.delta_p(p1, p2)
    out = df.select(F.aggregate(F.map_values(p1), F.lit(0.0), lambda a, v: a + v).alias("s"),
                    F.array_min(F.map_values(dp)).alias("lo"), F.array_max(F.map_values(dp)).alias("hi"),
                    L.acu(dp, F.lit("2support")).alias("acu"), L.acu(dp, F.lit("mix")).alias("none"))
    for r in out.collect():
        assert abs(r["s"] - 1.0) < 1e-9
        assert -1 - 1e-9 <= r["lo"] <= r["hi"] <= 1 + 1e-9
        assert -1 - 1e-9 <= r["acu"] <= 1 + 1e-9
        assert r["none"] is None


def test_argmax_ties_prefer_order(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 2.0, 2.0)], "a double, b double, c double")
    m = F.create_map(F.lit("true"), F.col("a"), F.lit("false"), F.col("b"), F.lit("maybe"), F.col("c"))
    assert [r[0] for r in df.select(L.argmax_token(m)).collect()] == ["true", "false"]


def test_syllables_and_grade(spark):
    df = spark.createDataFrame([("make",), ("banana",), ("rhythm",), ("123",)], "w string")
    assert [r[0] for r in df.select(syllables(F.col("w"))).collect()] == [1, 3, 1, 0]
    g = spark.createDataFrame([("The cat sat.",), ("",)], "t string").select(fk_grade(F.col("t"))).collect()
    expected = 0.39 * 3 + 11.8 * 1 - 15.59
    assert abs(g[0][0] - expected) < 1e-9 and g[1][0] is None


def test_wide_round_trip(spark):
    from evidentia.operators import claims as C
    from evidentia.sources import surrogate as S
    cl = C.group_claims(S.evidence(spark, "/root/testdata/sf0.001"))
    n_s, n_r = C.max_list_width(cl)
    back = C.from_wide(C.to_wide(cl, n_s, n_r))
    key = ["claim_id", "claim", "factcheck_verdict"]
    a = cl.select(*key, "supports", "refutes")
    assert a.exceptAll(back.select(*key, "supports", "refutes")).count() == 0
    assert back.count() == a.count()


def test_reverse_twice_is_identity(spark):
    from evidentia.operators import claims as C
    from evidentia.sources import surrogate as S
    cl = C.group_claims(S.evidence(spark, "/root/testdata/sf0.001"))
    a = C.select_evidence(cl, 1, 1).select("claim_id", "selected_evidence")
    b = C.select_evidence(cl, 1, 1, inverse=True).select(
        "claim_id", F.reverse("selected_evidence").alias("selected_evidence"))
    assert a.exceptAll(b).count() == 0


def test_match_rate_with_itself_is_100(spark):
    from evidentia.plans import extraction as XP
    from evidentia.plans import stats as ST
    from evidentia.sources import surrogate as S
    p = XP.extract_answers(S.answers(spark, "/root/testdata/sf0.001"))
    rates = [r["match_pct"] for r in ST.match_rate(p, p).collect()]
    assert rates and all(x == 100.0 for x in rates)


def test_shares_sum_to_100(spark):
    from evidentia.plans import extraction as XP
    from evidentia.plans import stats as ST
    from evidentia.sources import surrogate as S
    p = XP.extract_answers(S.answers(spark, "/root/testdata/sf0.001"))
    for r in ST.label_share(p, "verdict", ["true", "false", "maybe"]).collect():
        total = r["pct_true"] + r["pct_false"] + r["pct_maybe"] + r["pct_missing"]
        assert abs(total - 100.0) < 1e-4
