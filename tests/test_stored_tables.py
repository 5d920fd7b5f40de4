"""Bucketed merges, versions, positions, counts in the writing pass, soft scores."""

import math
import random
import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from evidentia.functions import extract as X
from evidentia.operators import align as AL
from evidentia.operators import claims as C
from evidentia.operators import enrich as EN
from evidentia.operators import numbering as NB
from evidentia.operators import observed as OB
from evidentia.operators import pairs as PR
from evidentia.operators import soft as SO
from evidentia.operators import wide as WD
from evidentia.plans import ingest as IN
from evidentia.sources import io as IO
from evidentia.sources import stored as SD
from evidentia.sources.versions import VersionedTable


@pytest.fixture
def settings(spark):
    """Set Spark settings for one test."""
    old = {}

    def set_(key, value):
        old.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)
    yield set_
    for key, value in old.items():
        spark.conf.set(key, value)


# --- stored tables -----------------------------------------------------------------------

def test_stored_merges_shuffle_nothing(spark, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings("spark.sql.adaptive.enabled", "false")
    left = spark.range(300).selectExpr("concat('m', id % 3) AS model", "id AS claim")
    right = spark.range(600).selectExpr("concat('m', id % 3) AS model", "id % 300 AS claim", "id AS row_ord", "id * 2 AS score")
    keys = ["model", "claim"]
    a, b = (SD.stored(spark, SD.store(df, keys, "t", buckets=4)) for df in (left, right))
    for merged in (EN.left_merge(a, b, keys, order="row_ord", require_all=True), EN.left_merge(a, b.drop("row_ord"), keys)):
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    got = {(r.model, r.claim): r.score for r in EN.left_merge(a, b, keys, order="row_ord", require_all=True).collect()}
    assert got == {(f"m{i % 3}", i): 2 * (i + 300) for i in range(300)}


def test_must_match_fails_the_job_that_reads(spark):
    left = spark.createDataFrame([("a",), ("b",)], "id string")
    right = spark.createDataFrame([("a", 1.0)], "id string, score double")
    merged = EN.left_merge(left, right, ["id"], require_all=True)
    for part in (merged, merged.select("score"), merged.select("id")):
        with pytest.raises(Exception, match="row without a partner.*b"):
            part.collect()
    assert EN.left_merge(left.filter("id = 'a'"), right, ["id"], require_all=True).collect() == [("a", 1.0)]
    assert EN.left_merge(left.limit(0), right.limit(0), ["id"], require_all=True).count() == 0


# --- wide export -------------------------------------------------------------------------

def test_a_claim_with_5000_pieces_of_evidence(spark, tmp_path):
    long = [("a-1", "A\tclaim", "True", True, "supports", f'piece {i} "quoted"\nline' if i % 7 else f"piece {i}", i) for i in range(5_000)]
    rows = long + [("b-2", "B", None, True, "refutes", "only", 0), ("b-2", "B", None, True, "refutes", None, 1),
                   ("b-2", "B", None, True, "refutes", "third", 2), ("c-3", "C", "False", False, "supports", "x", 0), (None, "D", "True", True, "supports", "x", 0)]
    ev = spark.createDataFrame(rows, "claim_id string, claim string, factcheck_verdict string, relevant boolean, evidence_stance string, "
                               "evidence string, row_ord int").repartition(5)
    cut = WD.slices(ev)
    assert cut.agg(F.max(F.size("texts"))).first()[0] == WD.WIDTH and cut.count() == 20 + 1
    assert dict(map(tuple, WD.widths(cut).collect())) == {"supports": 5_000, "refutes": 3}
    WD.write_wide(cut, str(tmp_path / "wide"))
    back = {(r.claim_id, r.factcheck_verdict, r.stance, r.place): r.evidence for r in WD.read_wide(spark, str(tmp_path / "wide")).collect()}
    want = {("a-1", "True", "supports", i + 1): r[5] for i, r in enumerate(long)}
    assert back == {**want, ("b-2", None, "refutes", 1): "only", ("b-2", None, "refutes", 3): "third"}


def test_first_n_of_each_group(spark):
    rows = [(f"g{i % 3}" if i % 3 else None, f"c{i % 40:02d}", i) for i in range(200)] + [("few", "c", 1)]
    df = spark.createDataFrame(rows, "g string, c string, i int").repartition(6)
    got = sorted(map(tuple, C.first_n(df, 7, ["g"], ["c", "i"]).collect()), key=str)
    want = []
    for g in (None, "g1", "g2", "few"):
        want += sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])[:7]
    assert got == sorted(want, key=str) and C.first_n(df, None, ["g"], ["c"]) is df
    assert C.first_n(df, 0, ["g"], ["c", "i"]).count() == 0 and C.first_n(df.limit(0), 5, ["g"], ["c", "i"]).count() == 0
    assert sorted(r.i for r in C.first_n(df, 3, [], ["i", "c"]).collect()) == [0, 1, 1]


# --- versions ------------------------------------------------------------------------------

def test_versions_replace_their_own_input(spark, monkeypatch):
    t = VersionedTable(spark, IO.scratch_path(spark, "versions"))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.write(spark.range(5).withColumn("p", F.col("id") % 2), "raw", ["p"])
    assert t.enrich("double", lambda x: x.withColumn("two", F.col("id") * 2)).agg(F.sum("two")).first()[0] == 20
    runs = []
    step = lambda x: runs.append(1) or x.withColumn("three", F.col("two") + F.col("id"))

    # a job that is lost between its files and its marker leaves the table as it was
    whole = VersionedTable._commit
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.enrich("three", step)
    monkeypatch.setattr(VersionedTable, "_commit", whole)
    again = VersionedTable(spark, t.path)
    assert again.stages() == ["raw", "double"] and "three" not in again.read().columns

    # or within its marker
    t._fs.create(t._at("00000003.whole"), False).close()
    assert again.stages() == ["raw", "double"]
    assert sorted(r.three for r in again.enrich("three", step).collect()) == [0, 3, 6, 9, 12]
    again.enrich("three", step)
    assert len(runs) == 2 and again.stages() == ["raw", "double", "three"]
    assert again.read("raw").columns == ["id", "p"]

    # of two jobs that write one version the second fails
    with pytest.raises(Exception, match="already exists|AlreadyExists"):
        again._commit(4, "other", "x")
    assert again.vacuum() == 3 and again.read().count() == 5 and again.vacuum() == 0
    with pytest.raises(ValueError):
        t.write(spark.range(1), "no good")


# --- row numbers and positions -----------------------------------------------------------------

def test_numbered_is_dense_in_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = NB.numbered(df, [F.desc("k"), F.asc("v")]).collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.row_no)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.row_no for r in got) == list(range(700)) and NB.numbered(df.limit(0), [F.asc("k")]).count() == 0
    plan = NB.numbered(df, [F.asc("k")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_positions_in_files_that_many_tasks_read(spark, tmp_path, settings):
    lines = {}
    for group in "xy":
        (tmp_path / f"g={group}").mkdir()
        for k in range(3):
            lines[group, k] = [f"{group}{k} line {i} " + "z" * (i % 50) for i in range(400 + 100 * k)]
            (tmp_path / f"g={group}" / f"part-{k}.txt").write_text("\n".join(lines[group, k]))
    settings("spark.sql.files.maxPartitionBytes", "3000")
    settings("spark.sql.files.openCostInBytes", "1")
    df = NB.file_positions(spark.read.text(str(tmp_path)), ["g"])
    assert df.rdd.getNumPartitions() > 20
    got = {(r.g, r.pos): r.value for r in df.collect()}
    for group in "xy":
        want = [v for k in range(3) for v in lines[group, k]]
        assert [got[group, i] for i in range(len(want))] == want
    assert len(got) == 2 * sum(400 + 100 * k for k in range(3))


def test_lists_of_unequal_length_are_left_out(spark):
    a = spark.createDataFrame([("x", 0, "p"), ("x", 1, "q"), ("y", 0, "r"), ("z", 0, "s")], "g string, pos long, v string")
    b = spark.createDataFrame([("x", 1, "Q"), ("x", 0, "P"), ("y", 0, "R"), ("y", 1, "S")], "g string, pos long, v string")
    assert sorted((r.g, r.pos, r.a.v, r.b.v) for r in AL.aligned(a, b, ["g"]).collect()) == [("x", 0, "p", "P"), ("x", 1, "q", "Q")]
    assert sorted(map(tuple, AL.unequal(a, b, ["g"]).collect())) == [("y", 1, 2), ("z", 1, 0)]


# --- counts in the pass that writes ---------------------------------------------------------------

def test_observed_counts_are_of_all_rows_that_passed(spark):
    out, counts = OB.stage_observed(spark.range(10), {"n": F.count(F.lit(1)), "odd": F.count_if(F.col("id") % 2 == 1)}, "observed",
                                    lambda x: x.filter("id < 3"))
    assert counts == {"n": 10, "odd": 5} and out.count() == 3
    kept, funnel = OB.prepared_evidence(spark.createDataFrame(
        [("a-1", True, "supports"), ("a-1", True, "refutes"), ("borderlines-2", True, "supports"), ("b-3", None, "supports"), ("c-4", True, None)],
        "claim_id string, relevant boolean, evidence_stance string"))
    assert funnel == {"raw_rows": 5, "relevant_rows": 4, "relevant_not_borderline_rows": 3, "kept_stance_rows": 2, "kept_claims": 1}
    assert kept.count() == 2


# --- evidence sections --------------------------------------------------------------------------------

def test_sections_of_one_to_forty(spark):
    rows = [(n, "<Claim>: c\n" + "".join(f"<Evidence {i + 1}>: text {i}\nmore <Evidence> <b>\n\n" for i in range(n)) + "<Instruction>:\nDo <Evidence 99>")
            for n in (0, 1, 2, 9, 10, 11, 40)] + [(100, None), (101, "<Evidence 1>: a <Evidence 3>:\n\n<Evidence 2>: b")]
    df = spark.createDataFrame(rows, "n int, p string")
    got = {r.n: None if r.s is None else [tuple(x) for x in r.s] for r in df.select("n", X.evidence_sections("p").alias("s")).collect()}
    for n, _ in rows[:-2]:
        assert got[n] == [(i + 1, f"text {i}\nmore <Evidence> <b>") for i in range(n)]
    assert got[100] is None and got[101] == [(1, "a"), (3, ""), (2, "b")]
    pairs = PR.section_pairs(df, ["n"], F.when(F.col("n") != 1, F.lit("bullets")).otherwise(" "), F.col("p"))
    assert Counter(r.n for r in pairs.collect()) == {2: 2, 9: 9, 10: 10, 11: 11, 40: 40, 101: 2}
    assert {r.target for r in pairs.filter("n = 101").collect()} == {"evidence_1", "evidence_2"}


# --- soft scores -------------------------------------------------------------------------------------------

def plain_tokens(text):
    return [t for t in re.split(r"[^\w]+", text.lower()) if t]


def plain_signatures(texts):
    sums: dict[str, list[int]] = {}
    for t in map(plain_tokens, texts):
        for i, tok in enumerate(t):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if j != i:
                    h = int(md5(t[j].encode()).hexdigest()[:12], 16)
                    s = sums.setdefault(tok, [0] * 48)
                    for k in range(48):
                        s[k] += 1 if h >> k & 1 else -1
    return {t: sum(1 << k for k in range(48) if s[k] > 0) for t, s in sums.items()}


def plain_soft(a, b, sig):
    def like(x, y):
        if x == y:
            return 1.0
        return max(0.0, 1 - 2 * bin(sig[x] ^ sig[y]).count("1") / 48) if x in sig and y in sig else 0.0
    a, b = plain_tokens(a), plain_tokens(b)
    if not a or not b:
        return (None, None, None)
    p = sum(max(like(x, y) for y in b) for x in a) / len(a)
    r = sum(max(like(x, y) for y in a) for x in b) / len(b)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_soft_scores_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(60)] + ["Éa b éa", "x"]
    sig = plain_signatures(texts[:50] + ["Éa b éa"])
    corpus = spark.createDataFrame([(t,) for t in texts[:50] + ["Éa b éa", None]], "text string")
    learned = SO.token_signatures(corpus)
    assert {r.tok: r.sig for r in learned.collect()} == sig
    pairs = [(i, rng.choice(texts), rng.choice(texts) + rng.choice(["", " new word"])) for i in range(120)] + [(500, texts[0], texts[1])] * 2
    df = spark.createDataFrame(pairs, "key int, candidate string, reference string")
    got = SO.soft_scores(df, learned, ["key"]).collect()
    assert len(got) == len(pairs)
    rows = {r.key: r for r in got}
    for i, a, b in pairs:
        for mine, want in zip(tuple(rows[i])[1:], plain_soft(a, b, sig)):
            assert (mine is None) == (want is None) and (want is None or math.isclose(mine, want, abs_tol=6e-5))


def test_random_baseline(spark):
    rows = [(i, f"a{i} same", f"b{i} same") for i in range(50)]
    df = spark.createDataFrame(rows, "key int, candidate string, reference string")
    shifted = SO.shifted_pairs(df, ["key"]).collect()
    own = {c: r for _, c, r in rows}
    assert sorted(r.candidate for r in shifted) == sorted(own) and sorted(r.reference for r in shifted) == sorted(own.values())
    assert all(own[r.candidate] != r.reference for r in shifted)
    assert {tuple(r) for r in shifted} == {tuple(r) for r in SO.shifted_pairs(df.repartition(5), ["key"]).collect()}
    none = spark.createDataFrame([], "tok string, sig long")
    got = SO.rescaled(df, none, ["key"]).collect()
    assert {(r.f1, r.baseline, r.f1_rescaled) for r in got} == {(0.5, 0.5, 0.0)}
    assert SO.rescaled(df.limit(0), none, ["key"]).count() == 0
    one = SO.rescaled(df.limit(1), none, ["key"]).first()
    assert one.baseline == one.f1


def test_judge_nested_by_one_exchange(spark, settings):
    settings("spark.sql.adaptive.enabled", "false")
    rows = [("m", "mix", f"c{i}", p, e, f"{i}{p}{e}") for i in range(20) for p in ("basic", "claim") for e in ("x", "y")]
    judge = spark.createDataFrame(rows, "generator_model string, mode string, claim_id string, prompt string, evaluator string, eval_text string")
    nested = IN.nested_judge(judge)
    assert nested._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(tuple(r) for r in IN.explode_judge(nested).collect()) == sorted(rows)


def test_run_files_are_compressed_and_claims_dealt(spark, tmp_path, monkeypatch):
    """positional_match: the claims go to the ranges, not the 36 answers of each, and the
    files, compressed, hold the answers of a model and mode in order."""
    from evidentia.plans import registry as R
    from evidentia.sources import surrogate as S
    k = F.col("id")
    spark.range(300).select(
        k.alias("o_orderkey"), (k % 50).alias("o_custkey"), F.lit("2024-01-01").cast("date").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1500).select(
        (k % 300).alias("l_orderkey"), F.floor(k / 300).alias("l_linenumber"), k.alias("l_partkey"), (k % 9).alias("l_suppkey"),
        F.lit(20.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.lit("2024-01-01").cast("date").alias("l_shipdate"),
        F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
        F.when(k % 2 == 0, "N").otherwise("R").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    path = str(tmp_path / "run")
    monkeypatch.setattr(R.IO, "scratch_path", lambda spark, name: path)
    rows = R._run_files(spark, str(tmp_path), 0).collect()
    files = [f.name for f in (tmp_path / "run").rglob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    want = {}
    for r in sorted(S.answers(spark, str(tmp_path)).collect(), key=lambda r: (r.claim_id, r.prompt_no)):
        want.setdefault((r.model, r.mode), []).append((r.prompt, r.response or None))
    got = {}
    for r in sorted(rows, key=lambda r: r.pos):
        got.setdefault((r.model, r.mode), []).append((r.prompt, r.response or None))
        assert r.pos == len(got[r.model, r.mode]) - 1
    assert got == want and len(rows) == 4_050
    plan = S.answers(spark, str(tmp_path), by_claim=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("name", ["merge_judge", "merge_judge_evaluators", "merge_inverse", "inverse_stats", "merge_scores",
                                  "merge_scores_last", "pair_scores_map", "stored_merge_inverse", "stored_merge_judge_evaluators"])
def test_merges_shuffle_claims_not_answers(spark, settings, name):
    """Claims are dealt once, and their answers are grouped and merged where they are."""
    from evidentia.plans import registry as R
    settings("spark.sql.adaptive.enabled", "false")
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = R.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or name == "pair_scores_map"
    assert "hashpartitioning(model" not in plan and "hashpartitioning(generator_model" not in plan, plan
    assert not name.startswith("stored") or "Exchange" not in plan


def test_tables_stored_by_a_part_of_their_keys(spark, settings):
    from evidentia.sources import stored as SD
    settings("spark.sql.requireAllClusterKeysForCoPartition", "false")
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("a", 1)], "c string, k int")
    right = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), (None, 1, 30), ("a", 1, 11)], "c string, k int, v int")
    l, r = (SD.stored(spark, SD.store(x, ["c", "k"], n, 5, by=["c"])) for x, n in ((left, "l"), (right, "r")))
    got = EN.left_merge(l, r, ["c", "k"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["c", "k"], "left").collect()))


def test_soft_scores_move_signatures_and_no_tokens(spark):
    """the sides of a pair carry signatures, tokens only where they have none; those
    are like themselves only. Equal texts are taken apart once and count as often as they come."""
    texts = ["a b c", "b c d", "c z z", "z y", "q"]
    corpus = ["a b c"] * 3 + ["b c d"]
    learned = SO.token_signatures(spark.createDataFrame([(t,) for t in corpus], "text string").repartition(3))
    sig = plain_signatures(corpus)
    assert {r.tok: r.sig for r in learned.collect()} == sig
    side = {r.text: r for r in SO.text_tokens(spark.createDataFrame([(t,) for t in texts * 2], "text string"), learned).collect()}
    assert sorted(side) == sorted(texts) and side["c z z"].n == 3
    assert list(side["c z z"].sigs) == [sig["c"]] and list(side["c z z"].ns) == [1] and [tuple(x) for x in side["c z z"].rare] == [("z", 2)]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts + ["", None] for b in texts + [""])]
    got = {r.key: tuple(r)[1:] for r in SO.soft_scores(spark.createDataFrame(pairs, "key int, candidate string, reference string"), learned, ["key"]).collect()}
    for i, a, b in pairs:
        want = plain_soft(a or "", b, sig)
        assert all((m is None) == (w is None) and (w is None or math.isclose(m, w, abs_tol=6e-5)) for m, w in zip(got[i], want)), (a, b)


def test_numbered_writes_what_is_kept(spark):
    df = spark.range(40).select((F.col("id") * 7 % 40).alias("k"), F.col("id").alias("v"))
    got = NB.numbered(df, [F.asc("k")], keep=["v"])
    assert got.columns == ["v", "row_no"]
    assert all(r.v * 7 % 40 == r.row_no for r in got.collect())
