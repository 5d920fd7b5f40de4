"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables through the surrogate views, so its work
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import claim_stats as CS
from evidentia.session import materialize
from evidentia.sources import surrogate as S

Query = Callable[[SparkSession, str], DataFrame]


def q_category_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CS.category_by_verdict(CS.first_verdict_from_evidence(S.evidence(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "category_by_verdict": q_category_by_verdict,
}


# --- extraction (X1-X7) -----------------------------------------------------
from evidentia.functions import extract as X  # noqa: E402
from evidentia.plans import extraction as XP  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

_K = ["model", "mode", "claim_id", "prompt"]


def _answers(spark, sf_dir, run=0, dealt=False):
    return S.answers(spark, sf_dir, run, dealt=dealt)


def _rowwise(col_fn, name):
    def q(spark, sf_dir):
        a = _answers(spark, sf_dir)
        return a.select(*_K, col_fn(F.col("response")).alias(name))
    return q


def q_bullets(spark, sf_dir):
    a = _answers(spark, sf_dir).select(*_K, X.bullets("response").alias("b"))
    return a.select(*_K, F.size("b").cast("bigint").alias("n_bullets"),
                    F.array_join("b", " | ").alias("bullets_text"))


def q_extraction_quality(spark, sf_dir):
    return XP.extraction_quality(XP.extract_answers(_answers(spark, sf_dir), "strict"))


QUERIES.update({
    "verdict_strict": _rowwise(X.verdict_strict, "verdict"),
    "verdict_loose": _rowwise(X.verdict_loose, "verdict"),
    "confidence_strict": _rowwise(X.confidence_strict, "confidence"),
    "confidence_loose": _rowwise(X.confidence_loose, "confidence"),
    "internal_knowledge": _rowwise(X.internal_knowledge, "internal_knowledge"),
    "bullets": q_bullets,
    "extraction_quality": q_extraction_quality,
})


# --- statistics over parsed answers (E3-E14, E22, J4, J5) ---------------------
from evidentia.plans import stats as ST  # noqa: E402

MODES = S.MODES


def _parsed(spark, sf_dir, run=0, dealt=False):
    return XP.extract_answers(_answers(spark, sf_dir, run, dealt), "strict")


QUERIES.update({
    "verdict_counts": lambda spark, d: ST.verdict_counts(_parsed(spark, d)),
    "verdict_pct_table": lambda spark, d: ST.verdict_pct_table(_parsed(spark, d), MODES),
    "verdict_share_missing": lambda spark, d: ST.label_share(_parsed(spark, d), "verdict",
                                                             ["true", "false", "maybe"]),
    "internal_share": lambda spark, d: ST.label_share(_parsed(spark, d), "internal_knowledge",
                                                      ["true", "false"]),
    "confidence_stats": lambda spark, d: ST.mean_sd(_parsed(spark, d), F.col("confidence")),
    "bullet_count_stats": lambda spark, d: ST.mean_sd(ST.bullet_item_stats(_parsed(spark, d)),
                                                      F.col("bullet_count")),
    "bullet_length_stats": lambda spark, d: ST.mean_sd(ST.bullet_item_stats(_parsed(spark, d)),
                                                       F.col("avg_bullet_length")),
    "fk_stats": lambda spark, d: ST.mean_sd(ST.fk_item_stats(_parsed(spark, d)), F.col("fk_grade")),
    "match_rate": lambda spark, d: ST.match_rate(_parsed(spark, d, 0), _parsed(spark, d, 1)),
    "subset_semi": lambda spark, d: ST.subset_semi(_answers(spark, d)).select(*_K),
    "sample_sizes": lambda spark, d: ST.sample_sizes(_parsed(spark, d)),
})


# --- claims, prompts (G1-G8, E2, E5, P-1..P-8, X11) -------------------------------
from evidentia.operators import claims as C  # noqa: E402
from evidentia.operators import prompts as P  # noqa: E402


def _claims(spark, d):
    return C.group_claims(S.evidence(spark, d))


def _claims_text(df):
    return df.select("claim_id", "claim", "factcheck_verdict",
                     F.size("supports").cast("bigint").alias("n_supports"),
                     F.size("refutes").cast("bigint").alias("n_refutes"),
                     F.array_join("supports", "|").alias("supports_text"),
                     F.array_join("refutes", "|").alias("refutes_text"))


def q_claims_roundtrip(spark, d):
    """G4 + G5 + G6: wide export and back. The width is the one driver scalar."""
    # read twice (width, then data): materialise the grouped claims once
    cl = materialize(_claims(spark, d))
    n_s, n_r = C.max_list_width(cl)
    return _claims_text(C.from_wide(C.to_wide(cl, n_s, n_r)))


def q_category_by_mode_total(spark, d):
    universe = CS.category_by_verdict(CS.first_verdict_from_evidence(S.evidence(spark, d)))
    items = _answers(spark, d).filter((F.col("model") == "llama") & (F.col("prompt") == "basic"))
    return CS.category_by_mode_total(items, universe, ["2support", "2refute", "mix"])


def _selected(claims):
    sel = C.select_evidence(claims, 1, 1, inverse=True)
    return sel.select("claim_id", F.array_join("selected_evidence", "|").alias("selected_text"))


def q_prompt_inputs_gaps(spark, d):
    """F9 on evidence with null and empty texts: the first valid ones count."""
    return _selected(C.group_claims(S.evidence_gaps(spark, d), keep_null_verdict=False, max_per_stance=1))


def q_prompt_inputs_gaps_wide(spark, d):
    """The same through the wide export, which holds the null and empty cells."""
    cl = materialize(C.group_claims(S.evidence_gaps(spark, d), keep_null_verdict=False))
    return _selected(C.from_wide(C.to_wide(cl, *C.max_list_width(cl))))


def q_prompt_inputs(spark, d):
    cl = C.group_claims(S.evidence(spark, d), keep_null_verdict=False, max_per_stance=1)
    sel = C.select_evidence(cl, 1, 1, inverse=True)
    return sel.select("claim_id", F.array_join("selected_evidence", "|").alias("selected_text"))


def _prompt_query(style):
    """Every mode the evidence allows, in file order and reversed."""
    def q(spark, d):
        cl = C.verdict_split(C.group_claims(S.evidence(spark, d), keep_null_verdict=False, max_per_stance=2))
        out = None
        for mode in S.MODES:
            for inverse in (False, True):
                part = P.build_prompts(cl, style, *S.MODE_EVIDENCE[mode], inverse=inverse).select(
                    F.lit(mode).alias("mode"), F.lit(inverse).alias("inverse"), "*")
                out = part if out is None else out.unionByName(part)
        return out
    return q


def q_eval_prompts(spark, d):
    return _parsed(spark, d).select("model", "mode", "claim_id", "prompt",
                                    P.judge_prompt(F.col("claim"), F.col("bullets")).alias("eval_prompt"))


def q_chat_wrapped(spark, d):
    a = _answers(spark, d)
    return a.select("model", "mode", "claim_id", "prompt",
                    P.chat_wrap(F.col("model"), F.col("prompt_text")).alias("chat_prompt"))


def q_judge_chat_wrapped(spark, d):
    """P-8 for the judge: each evaluator's template, without a system text."""
    e = q_eval_prompts(spark, d).select("*", F.explode(F.array(*[F.lit(m) for m in S.MODELS])).alias("evaluator"))
    return e.select("model", "mode", "claim_id", "prompt", "evaluator",
                    P.chat_wrap(F.col("evaluator"), F.col("eval_prompt"), P.JUDGE_TEMPLATES).alias("chat_prompt"))


def q_tagged_evidence(spark, d):
    a = _answers(spark, d).filter(F.col("prompt") == "basic")
    e1, e2 = X.evidence_pair(F.col("prompt_text"))
    return a.select("model", "mode", "claim_id", e1.alias("evidence_1"), e2.alias("evidence_2"))


QUERIES.update({
    "claims_grouped": lambda spark, d: _claims_text(_claims(spark, d)),
    "claims_first_row": lambda spark, d: _claims_text(C.group_claims_first_row(S.evidence(spark, d))),
    "claims_wide": q_claims_roundtrip,
    "evidence_funnel": lambda spark, d: C.funnel(S.evidence(spark, d)),
    "category_by_mode_total": q_category_by_mode_total,
    "prompt_inputs": q_prompt_inputs,
    "prompt_inputs_gaps": q_prompt_inputs_gaps,
    "prompt_inputs_gaps_wide": q_prompt_inputs_gaps_wide,
    **{f"prompt_{s}": _prompt_query(s) for s in P.STYLES},
    "eval_prompts": q_eval_prompts,
    "chat_wrapped": q_chat_wrapped,
    "judge_chat_wrapped": q_judge_chat_wrapped,
    "tagged_evidence": q_tagged_evidence,
})


# --- logits: softmax, delta-P, ACU, histogram, box, first-token audit ---------
from evidentia.functions import logits as LG  # noqa: E402
from evidentia.plans import logit_stats as LS  # noqa: E402


def _probs(spark, d):
    return LS.probabilities(S.logit_items(spark, d))


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_first_token_audit(spark, d):
    """Each answer row carries the logits of its own prompt, so the audit
    is one pass over the answers (no join back to the items)."""
    a = _answers(spark, d)
    x = a.select("model", "mode", "prompt", LG.argmax_token(S.answer_logits()).alias("predicted"),
                 X.first_token(F.col("response")).alias("actual"))
    agree = F.lower("actual") == F.col("predicted")
    return x.groupBy("model", "mode", "prompt").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(agree).alias("n_agree"),
        F.round(100.0 * F.avg(agree.cast("double")), 6).alias("agree_pct"))


_TOK_COLS = ["p_claim", "p_basic", "p_internal", "delta_p_basic", "delta_p_internal"]

QUERIES.update({
    "softmax_delta": lambda spark, d: _r6(LS.long_tokens(_probs(spark, d)), _TOK_COLS),
    "delta_long": lambda spark, d: _r6(LS.delta_long(LS.long_tokens(_probs(spark, d))), ["delta_p"]),
    "acu": lambda spark, d: _r6(LS.acu_items(_probs(spark, d)), ["acu_basic", "acu_internal"]),
    "acu_summary": lambda spark, d: LS.acu_summary(LS.acu_items(_probs(spark, d))),
    "acu_combined": lambda spark, d: LS.acu_combined(LS.acu_items(_probs(spark, d))),
    "delta_hist": lambda spark, d: LS.histogram(LS.delta_long(LS.long_tokens(_probs(spark, d))),
                                                "delta_p", ["model", "mode", "delta_type"], ["token"]),
    "delta_box": lambda spark, d: LS.boxplot(LS.delta_long(LS.long_tokens(_probs(spark, d))),
                                             "delta_p", ["mode", "token", "model_evidence"]),
    "first_token_audit": q_first_token_audit,
})


# --- judge and enrichment (X9, X10, E16, F11, J3, J8, E6) -----------------------
from evidentia.operators import enrich as EN  # noqa: E402
from evidentia.plans import judge as JG  # noqa: E402


def _judged(spark, d):
    return JG.parse_judge(S.judge(spark, d))


def q_merge_judge(spark, d):
    items = _parsed(spark, d, dealt=True).select(*_K)
    return EN.left_merge(items, JG.per_answer(JG.parse_judge(S.judge(spark, d, gaps=True, dealt=True))), _K)


def q_merge_judge_evaluators(spark, d):
    """J3 in full: each answer with the scores of every evaluator, no average."""
    keys = [*_K, "evaluator"]
    items = _parsed(spark, d, dealt=True).select(*_K, F.explode(F.array(*[F.lit(m) for m in S.MODELS])).alias("evaluator"))
    scores = JG.parse_judge(S.judge(spark, d, gaps=True, dealt=True)).withColumnRenamed("generator_model", "model")
    return EN.left_merge(items, scores, keys)


def q_join_coverage(spark, d):
    return EN.coverage(_answers(spark, d), S.judge(spark, d, gaps=True).withColumnRenamed("generator_model", "model"),
                       ["model", "mode", "claim_id"])


def q_unmatched_ids(spark, d):
    return EN.unmatched(_answers(spark, d),
                        S.judge(spark, d, gaps=True).withColumnRenamed("generator_model", "model"),
                        ["model", "mode", "claim_id"])


QUERIES.update({
    "judge_scores": _judged,
    "judge_stats": lambda spark, d: JG.judge_stats(_judged(spark, d)),
    "merge_judge": q_merge_judge,
    "merge_judge_evaluators": q_merge_judge_evaluators,
    "join_coverage": q_join_coverage,
    "unmatched_ids": q_unmatched_ids,
})


# --- pairs: inputs, lexical greedy match, maps, merges, diffs, inverse runs, M12 ----
from evidentia.operators import pairs as PR  # noqa: E402


def _pairs(spark, d, run=0, dealt=False):
    return PR.pair_inputs(_parsed(spark, d, run, dealt), evidence_col="selected_evidence")


def _scores(spark, d, dealt=False):
    return PR.lexical_scores(_pairs(spark, d, dealt=dealt))


def _score_cols(spark, d):
    m = PR.scores_map(_scores(spark, d, dealt=True), _K)
    return m.select(*_K, F.size("scores").cast("bigint").alias("n_targets"),
                    *[F.element_at("scores", F.lit(t)).alias(f"lexical_{t}")
                      for t in ("evidence_1", "evidence_2", "claim")])


def q_merge_scores(spark, d):
    items = _parsed(spark, d, dealt=True).select(*_K)
    return EN.left_merge(items, _score_cols(spark, d).drop("n_targets"), _K)


def q_bert_diff(spark, d):
    s = PR.evidence_scores(_parsed(spark, d), ST.GROUP, "selected_evidence")
    diff = F.when(F.col("prompt") == "claim", F.lit(0.0)).otherwise(F.abs(F.col("evidence_1") - F.col("evidence_2")))
    return ST.mean_sd(s, diff)


def _parsed_inverse(spark, d):
    """The answers to the prompts with reversed evidence."""
    return XP.extract_answers(S.answers(spark, d, inverse=True, dealt=True), "strict")


def _inverse_pairs(spark, d):
    """Bullets of the normal run against those of the reversed run."""
    a = _parsed(spark, d, 0, dealt=True).select(*_K, F.col("bullets").alias("ba"))
    b = _parsed_inverse(spark, d).select(*_K, F.col("bullets").alias("bb"))
    # the pair is built inside a generator and only its output is filtered, so
    # the blank test is not pushed below the join into the bullet extraction
    pair = F.struct(F.lit("inverse").alias("target"), X_join(F.col("ba")).alias("candidate"),
                    X_join(F.col("bb")).alias("reference"))
    keep = F.filter(F.array(pair), lambda s: (s["candidate"] != "") & (s["reference"] != ""))
    return a.join(b, _K).select(*_K, F.inline_outer(keep)).filter(F.col("target").isNotNull())


def q_inverse_stats(spark, d):
    return ST.mean_sd(PR.lexical_scores(_inverse_pairs(spark, d)), F.col("f1"))


def q_merge_inverse(spark, d):
    """The F1 of the reversed run for every answer; missing ones stay NULL."""
    items = _parsed(spark, d, dealt=True).select(*_K)
    scores = PR.lexical_scores(_inverse_pairs(spark, d)).select(*_K, F.col("f1").alias("inverse_f1"))
    return EN.left_merge(items, scores, _K)


def q_merge_scores_last(spark, d):
    """A score table with repeated keys; of each target the last duplicate (by
    file order) wins. An earlier run stored the precision, a later one the F1."""
    s = _scores(spark, d, dealt=True)
    again = s.select(*_K, "target", F.inline(F.array(
        F.struct(F.lit(0).alias("row_ord"), F.col("precision").alias("score")),
        F.struct(F.lit(1).alias("row_ord"), F.col("f1").alias("score")))))
    last = EN.dedupe_last(again, [*_K, "target"], "row_ord")
    wide = last.groupBy(*_K).agg(*[F.max(F.when(F.col("target") == t, F.col("score"))).alias(f"last_{t}") for t in PR.TARGETS])
    return EN.left_merge(_answers(spark, d, dealt=True).select(*_K), wide, _K)


def q_key_equality_gaps(spark, d):
    """J6 where the second run lost claims: the groups that differ say so."""
    b = _answers(spark, d, 1).filter((F.col("model") != "qwen") | (F.col("claim_key") % 17 != 0))
    return EN.key_equality(_answers(spark, d, 0), b, ["model", "mode"])


def X_join(c):
    from evidentia.functions.text import join_bullets
    return join_bullets(c)


QUERIES.update({
    "pair_inputs": _pairs,
    "pair_scores": _scores,
    "pair_scores_map": _score_cols,
    "merge_scores": q_merge_scores,
    "bert_diff": q_bert_diff,
    "inverse_stats": q_inverse_stats,
    "merge_inverse": q_merge_inverse,
    "merge_scores_last": q_merge_scores_last,
    "key_equality_gaps": q_key_equality_gaps,
    "key_equality": lambda spark, d: EN.key_equality(_answers(spark, d, 0), _answers(spark, d, 1),
                                                     ["model", "mode"]),
    "greedy_match": lambda spark, d: PR.greedy_match(S.token_vectors(spark, d)),
})


# --- sources and sinks: written and read back (S1-S8) -------------------------------
from pyspark.sql import types as T  # noqa: E402

from evidentia.sources import io as IO  # noqa: E402


def q_claims_split_tsv(spark, d):
    """G1 -> wide (G4, G5) -> TSV split by verdict (S5, S6) -> read back with an
    explicit schema (S1) -> compact lists (G6)."""
    cl = materialize(C.verdict_split(_claims(spark, d)))
    n_s, n_r = C.max_list_width(cl)
    path = IO.scratch_path(spark, "claims-split")
    IO.write_split_by_verdict(C.to_wide(cl, n_s, n_r), path)
    schema = T.StructType(
        [T.StructField("claim_id", T.StringType()), T.StructField("claim", T.StringType())]
        + [T.StructField(f"support_evidence_{i + 1}", T.StringType()) for i in range(n_s)]
        + [T.StructField(f"refute_evidence_{i + 1}", T.StringType()) for i in range(n_r)]
        + [T.StructField("factcheck_verdict", T.StringType())])
    back = IO.read_tsv(spark, path, schema).drop("row_ord")
    return _claims_text(C.from_wide(back))


_GRID_SCHEMA = T.StructType([
    T.StructField("claim_id", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("verdict", T.StringType()), T.StructField("confidence", T.IntegerType()),
    T.StructField("bullets", T.ArrayType(T.StringType())),
    T.StructField("model", T.StringType()), T.StructField("mode", T.StringType())])


def q_answers_json_grid(spark, d):
    """Parsed answers -> JSON stage partitioned by model and mode (S8) -> the
    model x mode grid, one model never run (S3) -> missing paths skipped (S4)
    -> one JSON read of the rest (S2)."""
    parsed = _parsed(spark, d).select("model", "mode", "claim_id", "prompt", "verdict",
                                      "confidence", "bullets")
    path = IO.scratch_path(spark, "answers-json")
    parsed.write.mode("errorifexists").partitionBy("model", "mode").option("compression", "gzip").json(path)
    grid = IO.file_grid(path + "/", S.MODELS + ["gemma"], S.MODES, pattern="model={model}/mode={mode}")
    back = spark.read.schema(_GRID_SCHEMA).option("basePath", path).json(IO.existing(spark, grid))
    return back.select("model", "mode", "claim_id", "prompt", "verdict", "confidence",
                       F.array_join("bullets", " | ").alias("bullets_text"))


QUERIES.update({
    "claims_split_tsv": q_claims_split_tsv,
    "answers_json_grid": q_answers_json_grid,
})


# --- ingest of result files, nested scores, further statistics, given texts, hooks ----
from evidentia.functions import text as TX  # noqa: E402
from evidentia.operators import hooks as HK  # noqa: E402
from evidentia.plans import ingest as IN  # noqa: E402

ITEMS_PER_FILE = 2000


def _items(spark, d, groups=0):
    a = S.answers(spark, d, groups=groups).withColumn("logits", S.answer_logits())
    return IN.answers_to_items(a, "group_no" if groups else None)


def _responses_ingest(wrapped):
    """T-3 result files written, read back (S2, list or wrapped root) and unpivoted."""
    def q(spark, d):
        # counted by their keys alone: a checkpoint would hold all prompts uncompressed
        files = max(1, _items(spark, d).count() // ITEMS_PER_FILE)
        path = IO.scratch_path(spark, "result-files")
        # the claims are dealt to the files, not the long items that each becomes
        IN.write_item_files(_items(spark, d, files), path, files, wrapped, "group_no")
        back = IN.items_to_answers(IO.read_results_json(spark, path, IN.ITEM_SCHEMA, wrapped))
        logit = [F.element_at("logits", F.lit(t)).alias(f"logit_{t}") for t in ("true", "false", "maybe")]
        return back.select(*_K, "factcheck_verdict", "prompt_text", "response", *logit)
    return q


def q_tagged_evidence_fallback(spark, d):
    """X11 with F14: every third item has no basic prompt and uses the internal one."""
    items = _items(spark, d).withColumn("prompt_basic", F.when(F.expr(S.claim_key()) % 3 != 0, F.col("prompt_basic")))
    e1, e2 = X.evidence_pair(IN.evidence_prompt(F.col("prompt_basic"), F.col("prompt_internal")))
    return items.select("model", "mode", "claim_id", e1.alias("evidence_1"), e2.alias("evidence_2"))


def q_loose_quality(spark, d):
    """X8 + E7: the verdict + confidence job over every answer."""
    p = XP.extract_answers(_answers(spark, d), "loose")
    return p.groupBy("model", "mode", "prompt").agg(
        F.count(F.lit(1)).alias("n_answers"), F.count_if(F.col("verdict").isNull()).alias("missing_verdict"),
        F.count_if(F.col("confidence").isNull()).alias("missing_confidence"))


def q_bullet_string_stats(spark, d):
    """G20 in E11 / E12: bullets stored as one string with '--' before each."""
    stored = _parsed(spark, d).select(*_K, F.concat(F.lit("-- "), F.array_join("bullets", " -- ")).alias("b"))
    items = ST.bullet_item_stats(stored.withColumn("bullets", TX.split_bullet_string(F.col("b"))))
    return items.groupBy(*ST.GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("bullet_count"), 6).alias("mean_count"),
        F.round(F.avg("avg_bullet_length"), 6).alias("mean_length"))


def q_acu_hist(spark, d):
    """E20 for the ACU values."""
    a = LS.acu_items(_probs(spark, d)).unpivot(["model", "mode", "claim_id"], ["acu_basic", "acu_internal"], "acu_type", "acu")
    return LS.histogram(a.filter(F.col("acu").isNotNull()).withColumn("acu", F.round("acu", 12)), "acu", ["model", "acu_type"], ["mode"])


def q_category_by_mode_verdict(spark, d):
    """E2 per fact-check verdict, every mode and model."""
    items = _answers(spark, d).filter(F.col("prompt") == "basic")
    g = items.groupBy("model", C.category("claim_id").alias("category"), "factcheck_verdict").agg(
        *[F.count_if(F.col("mode") == m).alias(f"cnt_{m}") for m in S.MODES], F.count(F.lit(1)).alias("total_cnt"))
    return g


def q_documents_readability(spark, d):
    """M7 and M8 over the whole given texts."""
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", TX.word_count(F.col("text")).cast("bigint").alias("n_words"),
                       F.round(TX.fk_grade(F.col("text")), 6).alias("fk_grade"))


def q_conversations_extraction(spark, d):
    """X1-X6 over every turn of the given conversations."""
    t = F.col("text")
    return S.table(spark, d, "conversations").select(
        "conv_id", "turn", X.verdict_strict(t).alias("verdict"), X.verdict_loose(t).alias("verdict_loose"),
        X.confidence_strict(t).alias("confidence"), X.internal_knowledge(t).alias("internal_knowledge"),
        F.size(X.bullets(t)).cast("bigint").alias("n_bullets"))


def _stub_answer():
    """A deterministic stand-in for a model: the answer depends on the prompt's length."""
    return lambda texts: [f"Verdict: [{('true', 'false', 'maybe')[len(t) % 3]}] Confidence score: [{len(t) % 101}]" for t in texts]


def _stub_logits():
    return lambda texts: [{"true": float(len(t) % 7), "false": float(len(t) % 5), "maybe": float(len(t) % 3)} for t in texts]


def _stub_score():
    return lambda c, r: [(len(a) / (len(a) + len(b)), len(b) / (len(a) + len(b)), 0.5) for a, b in zip(c, r)]


def q_hook_complete(spark, d):
    """U1 over the whole prompt table, answers extracted again."""
    a = HK.complete(_answers(spark, d).select(*_K, "prompt_text"), _stub_answer, out_col="answer", batch_size=64, keep=_K)
    return a.select(*_K, X.verdict_strict(F.col("answer")).alias("verdict"),
                    X.confidence_strict(F.col("answer")).alias("confidence"))


def q_hook_logits(spark, d):
    """U2 over the whole prompt table, to softmax."""
    a = HK.first_token_logits(_answers(spark, d).select(*_K, "prompt_text"), _stub_logits, batch_size=64)
    # read three times below: in a projection of its own
    a = a.select(*_K, LG.softmax(F.col("logits")).alias("p"))
    return a.select(*_K, *[F.round(F.element_at("p", F.lit(t)), 6).alias(f"p_{t}") for t in ("true", "false", "maybe")])


def q_hook_scores(spark, d):
    """U3 over every (claim, response) pair with a response."""
    a = _answers(spark, d).select(*_K, F.col("claim").alias("candidate"), F.col("response").alias("reference"))
    s = HK.score_pairs(a, _stub_score)
    return s.select(*_K, F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


QUERIES.update({
    "responses_ingest": _responses_ingest(False),
    "responses_ingest_wrapped": _responses_ingest(True),
    "judge_nested": lambda spark, d: JG.parse_judge(IN.explode_judge(IN.nested_judge(S.judge(spark, d)))),
    "tagged_evidence_fallback": q_tagged_evidence_fallback,
    "loose_quality": q_loose_quality,
    "bullet_string_stats": q_bullet_string_stats,
    "acu_hist": q_acu_hist,
    "category_by_mode_verdict": q_category_by_mode_verdict,
    "documents_readability": q_documents_readability,
    "conversations_extraction": q_conversations_extraction,
    "hook_complete": q_hook_complete,
    "hook_logits": q_hook_logits,
    "hook_scores": q_hook_scores,
})


# --- result items of drifting shape (S2, F13, E10, E13, E15) --------------------------
from evidentia.plans import drift as DR  # noqa: E402
from evidentia.sources import variant as V  # noqa: E402

QUERIES.update({
    "results_variant": lambda spark, d: DR.typed(DR.drifting_items(spark, d)),
    "results_variant_stats": lambda spark, d: DR.stats(DR.drifting_items(spark, d)),
    "results_variant_kinds": lambda spark, d: V.kinds(DR.drifting_items(spark, d)),
})


# --- stored and versioned tables, positions, observed counts, sections, soft scores --------
from pyspark.sql import Window  # noqa: E402

from evidentia.operators import align as AL  # noqa: E402
from evidentia.operators import numbering as NB  # noqa: E402
from evidentia.operators import observed as OB  # noqa: E402
from evidentia.operators import soft as SO  # noqa: E402
from evidentia.sources import stored as SD  # noqa: E402
from evidentia.sources.versions import VersionedTable  # noqa: E402
from evidentia.session import stage_table  # noqa: E402


def _store(spark, d, df, keys, label):
    """Buckets hold whole claims, as the answers are dealt."""
    return SD.stored(spark, SD.store(df, keys, label, S.claim_parts(spark, d), by=["claim_id"]))


def q_stored_merge_scores(spark, d):
    """J1 on stored tables: a score row for every item and run; the last run wins, and
    an item without scores would fail the job."""
    items = _parsed(spark, d, dealt=True).select(*_K)
    s = _scores(spark, d, dealt=True)
    pick = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    wide = s.groupBy(*_K).agg(*[pick(t, c).alias(f"{c}_{t}") for t in PR.TARGETS for c in ("precision", "f1")])
    run = lambda i, c: F.struct(F.lit(i).alias("row_ord"), *[F.col(f"{c}_{t}").alias(f"last_{t}") for t in PR.TARGETS])
    rows = EN.left_merge(items, wide, _K).select(*_K, F.inline(F.array(run(0, "precision"), run(1, "f1"))))
    return EN.left_merge(_store(spark, d, items, _K, "items"), _store(spark, d, rows, _K, "scores"), _K, order="row_ord", require_all=True)


def q_stored_merge_inverse(spark, d):
    """J2 on stored tables."""
    scores = PR.lexical_scores(_inverse_pairs(spark, d)).select(*_K, F.col("f1").alias("inverse_f1"))
    return EN.left_merge(_store(spark, d, _parsed(spark, d, dealt=True).select(*_K), _K, "items"), _store(spark, d, scores, _K, "inverse"), _K)


def q_stored_merge_judge_evaluators(spark, d):
    """J3 on stored tables."""
    keys = [*_K, "evaluator"]
    items = _parsed(spark, d, dealt=True).select(*_K, F.explode(F.array(*[F.lit(m) for m in S.MODELS])).alias("evaluator"))
    scores = JG.parse_judge(S.judge(spark, d, gaps=True, dealt=True)).withColumnRenamed("generator_model", "model")
    return EN.left_merge(_store(spark, d, items, keys, "items"), _store(spark, d, scores, keys, "judged"), keys)


def _run_files(spark, d, run):
    """A run's answers as files without ids, in item order; the second run lost some
    claims in one mode of one model."""
    a = S.answers(spark, d, run, by_claim=True)     # a file holds a range of the claims of each model and mode
    if run:
        a = a.filter(~((F.col("model") == "qwen") & (F.col("mode") == "mix") & (F.col("claim_key") % 17 == 0)))
    order = ["model", "mode", "claim_id", "prompt_no"]
    path = IO.scratch_path(spark, f"run-{run}")
    a.select(*order, "prompt", "response").sortWithinPartitions(*order).drop("claim_id", "prompt_no").write.partitionBy(
        "model", "mode").option("compression", "gzip").json(path)
    files = spark.read.schema("prompt string, response string, model string, mode string").json(path)
    return NB.file_positions(files, ["model", "mode"])


def q_positional_match(spark, d):
    """Two runs without ids, aligned by place, and their agreement."""
    a, b = (_run_files(spark, d, run).withColumn("verdict", X.verdict_strict(F.col("response"))).drop("response") for run in (0, 1))
    both = AL.aligned(a, b, ["model", "mode"])
    same = F.col("a.verdict").eqNullSafe(F.col("b.verdict"))
    return both.groupBy("mode", "model", F.col("a.prompt").alias("prompt")).agg(
        F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(same) / F.count(F.lit(1)), 6).alias("match_pct"),
        F.count_if(F.col("a.prompt") != F.col("b.prompt")).alias("n_wrong_prompt"))


def q_stage_replace(spark, d):
    """Responses are written, enriched twice over their own input, and read again;
    a stage that is done is not done twice."""
    t = VersionedTable(spark, IO.scratch_path(spark, "answers-versions"))
    t.write(_answers(spark, d).select(*_K, "response"), "responses", ["model", "mode"])
    r = F.col("response")
    t.enrich("verdicts", lambda x: x.select("*", X.verdict_strict(r).alias("verdict"), X.confidence_strict(r).alias("confidence")), ["model", "mode"])
    t.enrich("bullets", lambda x: x.select("*", F.array_join(X.bullets(r), " | ").alias("bullets_text")), ["model", "mode"])
    return t.enrich("verdicts", lambda x: x.limit(0)).select(*_K, "verdict", "confidence", "bullets_text")


def q_quality_observed(spark, d):
    """E7 in the pass that writes the parsed answers."""
    # chosen before they are counted: no column is pruned below the counts, so the prompts would be built too
    parsed = _parsed(spark, d).select(*_K, "verdict", "confidence", "bullets", "internal_knowledge")
    _, counts = OB.stage_observed(parsed, OB.quality_counts(S.PROMPTS), "parsed-answers")
    return OB.one_row(spark, counts)


MAX_SECTIONS = 40


def q_pair_inputs_sections(spark, d):
    """X11 and M9 with up to 40 evidence sections: the first evidence of each claimant's
    claims in one prompt, cut out of it again."""
    ev = S.evidence(spark, d).select("claimant", "claim_key", "row_ord", "evidence")
    first = F.row_number().over(Window.partitionBy("claimant").orderBy("claim_key", "row_ord"))
    ev = ev.withColumn("k", first).filter(F.col("k") <= MAX_SECTIONS)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence"))), lambda x: x["evidence"])
    rows = ev.groupBy("claimant").agg(texts.alias("ev")).select(
        "claimant", P.prompt_text("bullet_first", "basic", F.col("claimant"), F.col("ev")).alias("prompt"))
    return PR.section_pairs(rows, ["claimant"], F.concat(F.lit("what is known of "), "claimant"), F.col("prompt"))


def _signatures(spark, d):
    """Token signatures learned from all evidence and claim texts."""
    corpus = S.evidence(spark, d).select(F.explode(F.array("evidence", "claim")).alias("text"))
    return stage_table(SO.token_signatures(corpus), "signatures")


_PK = [*_K, "target"]

QUERIES.update({
    "stored_merge_scores": q_stored_merge_scores,
    "stored_merge_inverse": q_stored_merge_inverse,
    "stored_merge_judge_evaluators": q_stored_merge_judge_evaluators,
    "positional_match": q_positional_match,
    "stage_replace": q_stage_replace,
    "evidence_funnel_observed": lambda spark, d: OB.one_row(spark, OB.prepared_evidence(S.evidence(spark, d))[1]),
    "extraction_quality_observed": q_quality_observed,
    "pair_inputs_sections": q_pair_inputs_sections,
    "token_signatures": _signatures,
    "pair_scores_soft": lambda spark, d: SO.soft_scores(stage_table(_pairs(spark, d), "pairs"), _signatures(spark, d), _PK),
    "pair_scores_rescaled": lambda spark, d: SO.rescaled(stage_table(_pairs(spark, d), "pairs"), _signatures(spark, d), _PK),
})


# --- wide export of long lists, first claims of each mode ---------------------------------
from evidentia.operators import wide as WD  # noqa: E402


def q_claims_wide_slices(spark, d):
    """G4-G6 for lists of any length: written as files of bounded width, read back."""
    path = IO.scratch_path(spark, "claims-wide")
    WD.write_wide(WD.slices(S.evidence(spark, d), 4), path, 4)
    return WD.read_wide(spark, path, 4)


FIRST_CLAIMS = 100


def q_prompt_first_n(spark, d):
    """The prompts of the first 100 claims of each mode."""
    items = _answers(spark, d).filter((F.col("model") == "llama") & (F.col("prompt") == "basic"))
    return C.first_n(items.select("mode", "claim_id", "prompt_text"), FIRST_CLAIMS, ["mode"], ["claim_id"])


QUERIES.update({
    "claims_wide_slices": q_claims_wide_slices,
    "claims_wide_widths": lambda spark, d: WD.widths(WD.slices(S.evidence(spark, d))),
    "prompt_first_n": q_prompt_first_n,
})


# --- delimited files read by ranges ---------------------------------------------------------
from evidentia.sources import ranges as RG  # noqa: E402

RANGE_BYTES = 256 << 10
_TSV_COLUMNS = ["claim_id", "claim", "factcheck_verdict", "evidence", "evidence_stance"]


def q_evidence_tsv_ranges(spark, d):
    """The evidence as TSV whose cells hold newlines and quotes, each file read by many tasks."""
    ev = S.evidence(spark, d).withColumn("evidence", F.concat("evidence", F.lit(",\n\"quoted\"")))
    path = IO.scratch_path(spark, "evidence-tsv")
    IO.write_tsv(ev.select(*_TSV_COLUMNS), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _TSV_COLUMNS])
    return RG.read_tsv_ranges(spark, path, schema, RANGE_BYTES).drop("row_ord")


QUERIES["evidence_tsv_ranges"] = q_evidence_tsv_ranges
