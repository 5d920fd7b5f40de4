"""Surrogate views over the driver tables.

The driver ships TPC-H-like tables, not claim / evidence files. Each view
below re-reads them as the claim tables the reference works on, so every
query scales with ``lineitem`` / ``orders`` / ``embeddings``.
Every column is a SQL expression that Spark and DuckDB evaluate the same way,
so the oracle SQL builds the very same input rows.

evidence   lineitem joined to its order: one row per claim x evidence
answers    one row per claim x mode x model x prompt, with a response text
           chosen by key arithmetic from ten response shapes (see RESPONSES)
logits     first-token logits for true / false / maybe per answer
judge      judge text per answer x evaluator
tokens     embeddings split into text pairs of 64, candidate and reference side
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import keep_dealt

# ---------------------------------------------------------------------------
# Fixed values of the domain (vocabulary used by the reference's pipeline).
MODELS = ["llama", "mistral", "qwen"]
PROMPTS = ["basic", "internal", "claim"]
MODES = ["2support", "2refute", "mix", "1refute"]
# evidence needed per mode: (supports, refutes)
MODE_EVIDENCE = {"2support": (2, 0), "2refute": (0, 2), "mix": (1, 1), "1refute": (0, 1)}
VERDICTS = ["True", "False", "Half True"]
STANCES = ["supports", "insufficient-supports", "insufficient-neutral",
           "insufficient-contradictory", "insufficient-refutes", "refutes"]
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Evidence columns, each a SQL expression over lineitem x orders.
EVIDENCE_COLUMNS = {
    "claim_key": "o_orderkey",
    "id": "concat('ev-', cast(l_orderkey as string), '-', cast(l_linenumber as string))",
    "claim_id": ("CASE WHEN o_orderpriority = '4-NOT SPECIFIED' "
                 "THEN concat('borderlines-', cast(o_orderkey as string)) "
                 "ELSE concat(lower(substr(o_orderpriority, 3)), '-', cast(o_orderkey as string)) END"),
    "claim_source": "concat('desk ', cast(o_custkey % 7 as string))",
    "claim": ("concat('Order ', cast(o_orderkey as string), ' by customer ', "
              "cast(o_custkey as string), ' was filled')"),
    "claimant": "concat('customer ', cast(o_custkey as string))",
    "claim_date": "cast(cast(o_orderdate as date) as string)",
    "evidence_source": "concat('supplier ', cast(l_suppkey as string))",
    "evidence": ("concat('part ', cast(l_partkey as string), ' supp ', cast(l_suppkey as string), "
                 "' qty ', cast(cast(l_quantity as int) as string))"),
    "evidence_date": "cast(cast(l_shipdate as date) as string)",
    "factcheck_verdict": ("CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL "
                          "WHEN o_orderstatus = 'F' THEN 'False' "
                          "WHEN o_orderstatus = 'O' THEN 'True' "
                          "WHEN o_orderstatus = 'P' THEN 'Half True' END"),
    "is_gold": "l_linenumber = 1",
    "relevant": "l_quantity > 10",
    "evidence_stance": ("CASE l_returnflag WHEN 'N' THEN 'supports' WHEN 'R' THEN 'refutes' "
                        "ELSE 'insufficient-neutral' END"),
}
# File order of evidence inside a claim: these columns, in this order.
EVIDENCE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence table: one row per line item, claim attributes from its order.

    ``row_ord`` is a struct of the line-item columns that define file order
    inside a claim; no window (and so no extra sort) is needed to build it.
    """
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    joined = li.join(od, li.l_orderkey == od.o_orderkey)
    cols = [F.expr(e).alias(n) for n, e in EVIDENCE_COLUMNS.items()]
    cols.append(F.struct(*EVIDENCE_ORDER).alias("row_ord"))
    return joined.select(*cols)


# Evidence with gaps: every fifth text is null, every fifth empty.
GAP_EVIDENCE = ("CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE "
                + EVIDENCE_COLUMNS["evidence"] + " END")


def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``evidence`` with null and empty texts among the others."""
    li, od = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cols = [F.expr(GAP_EVIDENCE if n == "evidence" else e).alias(n) for n, e in EVIDENCE_COLUMNS.items()]
    return li.join(od, li.l_orderkey == od.o_orderkey).select(*cols, F.struct(*EVIDENCE_ORDER).alias("row_ord"))


def evidence_gaps_sql() -> str:
    return evidence_sql().replace(f"{EVIDENCE_COLUMNS['evidence']} AS evidence", f"{GAP_EVIDENCE} AS evidence")


def evidence_sql() -> str:
    """DuckDB text of the same view, with the order columns kept flat."""
    cols = ",\n  ".join(f"{e} AS {n}" for n, e in EVIDENCE_COLUMNS.items())
    order = ", ".join(EVIDENCE_ORDER)
    return (f"SELECT {cols},\n  {order}\n"
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


# ---------------------------------------------------------------------------
# Responses. Ten response shapes, picked per answer by key arithmetic, so the
# extraction rules meet brackets, missing parts, numbers out of range,
# synonyms, numbered quotes, prose numbers and multi-line text.
# Placeholders: {v} verdict word, {c} confidence, {k} knowledge word,
# {e1} {e2} first two evidence texts of the answer (claim text for the
# claim-only prompt), {t} true/false word. NL is a newline.
NL = "chr(10)"
RESPONSES = [
    "concat('Bullets: -- ', {e1}, ' -- ', {e2}, ' Internal knowledge: ', {k}, "
    "' Verdict: ', {v}, ' Confidence score: ', {c})",
    "concat('Here are the key factual insights: 1. ', {e1}, ' 2) ', {e2}, " + NL + ", "
    "'Internal knowledge: [', {k}, ']', " + NL + ", 'Verdict: [', {v}, ']', " + NL + ", "
    "'Confidence score: [', {c}, ']')",
    "concat('[', {v}, '] ', {c}, " + NL + ", '-- ', {e1}, " + NL + ", '-- ', {e2})",
    "concat('Verdict = ', {v}, ' (', {c}, ')')",
    "concat('It is not ', {v}, ' in my view, see 2 \"', {e1}, '\" and 3 \"', {e2}, '\"')",
    "concat('', '')",
    "concat({v}, ' - ', {c}, " + NL + ", 'bullets: - ', {e1}, ' - well-known fact in 2016. -- ', {e2})",
    "concat('Here is the analysis:', " + NL + ", '-- [', {e1}, ']', " + NL + ", '-- [', {e2}, ']', "
    + NL + ", 'I used no internal knowledge here.', " + NL + ", 'Verdict: ', {v})",
    "concat('Confidence score: ', cast({craw} * 10 as string), ' Verdict: ', {v})",
    "concat('The claim is ', {v}, '. Bullets: -- ', {e1}, ' internally: ', {t})",
]
VERDICT_WORDS = ["true", "false", "maybe", "unknown", "uncertain"]
KNOWLEDGE_WORDS = ["true", "false", "yes", "no"]


def _word(words: list[str], index_sql: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words))
    return f"(CASE ({index_sql}) % {len(words)} {arms} END)"


def answer_columns(run: int = 0) -> dict[str, str]:
    """SQL expressions of the synthetic answer, over columns
    claim_key, model_no, prompt_no, mode_no, ev1, ev2, claim.
    ``run`` 1 gives a second, partly different run of the same prompts."""
    p = answer_parts(run)
    arms = " ".join(f"WHEN {i} THEN " + r.format(**p) for i, r in enumerate(RESPONSES))
    return {"response": f"(CASE {p['shape']} {arms} END)"}


def answer_parts(run: int = 0) -> dict[str, str]:
    """The pieces a response is put together from, and the number of its shape."""
    key = f"(claim_key + {3 * run})"
    craw = f"(({key} * 13 + model_no * 7 + prompt_no * 3 + mode_no) % 110)"
    return {
        "v": _word(VERDICT_WORDS, f"{key} + model_no * 2 + prompt_no + mode_no"),
        "k": _word(KNOWLEDGE_WORDS, f"{key} + prompt_no"),
        "t": _word(["true", "false"], f"{key} + model_no"),
        "craw": craw,
        "c": f"cast({craw} as string)",
        "e1": "(CASE WHEN prompt_no = 2 THEN claim ELSE coalesce(ev1, '') END)",
        "e2": "(CASE WHEN prompt_no = 2 THEN claim ELSE coalesce(ev2, '') END)",
        "shape": f"(({key} * 7 + model_no * 3 + prompt_no + mode_no * 5) % {len(RESPONSES)})"}


def claim_key(claim_id: str = "claim_id") -> str:
    """Numeric key at the end of a claim id (SQL, both engines)."""
    return f"cast(regexp_extract({claim_id}, '([0-9]+)$', 1) as bigint)"


def _literal_rows(names: list[str], rows: list[tuple]) -> Column:
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)])
                              for r in rows]))


GROUPS_PER_TASK = 16        # whole groups of claims in one task (see ``answers``)
EVIDENCE_PER_TASK = 100_000  # a task sorts the answers of so much evidence in memory


def claim_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that claims are dealt to: as many as the session shuffles to, more for
    much evidence (its rows are counted from the files' footers)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf_dir, "lineitem").count() // EVIDENCE_PER_TASK)


def answers(spark: SparkSession, sf_dir: str, run: int = 0,
            style: str = "bullet_first", inverse: bool = False, by_claim: bool = False,
            groups: int = 0, dealt: bool = False) -> DataFrame:
    """One row per claim x mode x model x prompt type, with the prompt and a
    synthetic response. Built from the grouped claims (G1) with a verdict;
    a claim enters every mode its evidence allows (F9), 1refute only for
    claims whose verdict is True. Modes, models and prompt types are literal
    generators (inline), not joins. ``inverse`` reverses the evidence (G8). With
    ``by_claim`` the partitions are ranges of claim_id: the claims are dealt to them, not
    the many answers that each becomes. With ``groups`` they are dealt to that many groups
    by hash (column ``group_no``), a few to a partition: what is grouped by it later is not
    shuffled again. With ``dealt`` they are dealt by hash of claim_id, which has at most 36
    answers: what is grouped or joined by claim_id and more later is not shuffled again."""
    from evidentia.operators.claims import group_claims
    from evidentia.operators.prompts import prompt_text

    # no mode needs more than two pieces of evidence per stance
    cl = group_claims(evidence(spark, sf_dir), keep_null_verdict=False, max_per_stance=2)
    if by_claim:
        cl = cl.repartitionByRange("claim_id")
    if dealt:
        keep_dealt(spark)
        cl = cl.repartition(claim_parts(spark, sf_dir), "claim_id")
    more = []
    if groups:
        more = ["group_no"]
        parts = max(-(-groups // GROUPS_PER_TASK), min(groups, spark.sparkContext.defaultParallelism))
        cl = cl.withColumn("group_no", F.pmod(F.xxhash64("claim_id", "claim"), F.lit(groups))).repartition(parts, "group_no")
    modes = [(m, i, *MODE_EVIDENCE[m]) for i, m in enumerate(MODES)]
    x = cl.select("*", _literal_rows(["mode", "mode_no", "n_s", "n_r"], modes))
    x = x.filter((F.size("supports") >= F.col("n_s")) & (F.size("refutes") >= F.col("n_r"))
                 & ((F.col("mode") != "1refute") | (F.col("factcheck_verdict") == "True")))
    sel = F.concat(F.slice("supports", 1, F.col("n_s")), F.slice("refutes", 1, F.col("n_r")))
    if inverse:  # G8: the same evidence, reversed in the prompt
        sel = F.reverse(sel)
    x = x.select("claim_id", "claim", "factcheck_verdict", "mode", "mode_no", *more,
                 sel.alias("selected_evidence"),
                 F.expr(claim_key()).alias("claim_key"))
    mp = [(m, mi, p, pi) for mi, m in enumerate(MODELS) for pi, p in enumerate(PROMPTS)]
    x = x.select("*", _literal_rows(["model", "model_no", "prompt", "prompt_no"], mp))
    x = x.withColumn("ev1", F.get("selected_evidence", 0)).withColumn("ev2", F.get("selected_evidence", 1))
    x = x.select("*", *[F.expr(e).alias(f"_{n}") for n, e in answer_parts(run).items()])
    ptext = None
    for p in PROMPTS:
        e = prompt_text(style, p, F.col("claim"), F.col("selected_evidence"))
        ptext = F.when(F.col("prompt") == p, e) if ptext is None else ptext.when(F.col("prompt") == p, e)
    return x.select(
        F.lit(style).alias("style"), "model", "mode", "claim_id", "claim", "factcheck_verdict",
        "prompt", ptext.alias("prompt_text"), "selected_evidence",
        _response().alias("response"), "claim_key", "model_no", "prompt_no", "mode_no", *more)


def _response() -> Column:
    """``answer_columns`` over the columns of ``answer_parts``: a CASE of short arms,
    since generated code of more than 8,000 bytes is never compiled."""
    part = {n: f"_{n}" for n in ("v", "c", "craw", "k", "e1", "e2", "t")}
    arms = " ".join(f"WHEN {i} THEN " + r.format(**part) for i, r in enumerate(RESPONSES))
    return F.expr(f"CASE _shape {arms} END")


def answers_sql(run: int = 0, inverse: bool = False) -> str:
    """DuckDB text of ``answers`` (without the prompt text), reading the CTE
    ``claims`` (claim_id, claim, factcheck_verdict, supports, refutes)."""
    modes = ", ".join(f"('{m}', {i}, {MODE_EVIDENCE[m][0]}, {MODE_EVIDENCE[m][1]})"
                      for i, m in enumerate(MODES))
    mp = ", ".join(f"('{m}', {mi}, '{p}', {pi})"
                   for mi, m in enumerate(MODELS) for pi, p in enumerate(PROMPTS))
    sel = "list_concat(c.supports[1:m.n_s], c.refutes[1:m.n_r])"
    sel = f"list_reverse({sel})" if inverse else sel
    return f"""SELECT model, mode, claim_id, claim, factcheck_verdict, prompt,
  {answer_columns(run)["response"]} AS response,
  claim_key, model_no, prompt_no, mode_no, ev1, ev2, sel
FROM (
  SELECT c.claim_id, c.claim, c.factcheck_verdict, m.mode, m.mode_no,
         {claim_key("c.claim_id")} AS claim_key,
         {sel}[1] AS ev1,
         {sel}[2] AS ev2,
         {sel} AS sel
  FROM claims c, (VALUES {modes}) m(mode, mode_no, n_s, n_r)
  WHERE c.factcheck_verdict IS NOT NULL
    AND len(c.supports) >= m.n_s AND len(c.refutes) >= m.n_r
    AND (m.mode <> '1refute' OR c.factcheck_verdict = 'True')) b,
  (VALUES {mp}) mp(model, model_no, prompt, prompt_no)"""


def logit_sql(prompt_no: int, token_no: int) -> str:
    """First-token logit of a candidate token (SQL, both engines), in [-2, 2]."""
    return (f"(cast((claim_key * 13 + {token_no} * 5 + model_no + {prompt_no} * 3 + mode_no) % 41 "
            f"as double) / 10 - 2)")


def answer_logits() -> Column:
    """The logits stored with one answer (for its own prompt type), over
    columns claim_key, model_no, prompt_no, mode_no: the same values that
    ``logit_items`` lays out per item."""
    kv = []
    for ti, t in enumerate(["true", "false", "maybe"]):
        kv += [F.lit(t), F.expr(logit_sql("prompt_no", ti))]
    return F.create_map(*kv)


def logit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (model, mode, claim) with ``logits_{basic,internal,claim}``
    as MAP<STRING, DOUBLE> over the tokens true / false / maybe."""
    items = answers(spark, sf_dir).filter(F.col("prompt") == "basic")
    maps = []
    for pi, p in enumerate(PROMPTS):
        kv = []
        for ti, t in enumerate(["true", "false", "maybe"]):
            kv += [F.lit(t), F.expr(logit_sql(pi, ti))]
        maps.append(F.create_map(*kv).alias(f"logits_{p}"))
    return items.select("model", "mode", "claim_id", "claim_key", "model_no", "mode_no", *maps)


def judge_parts() -> dict[str, str]:
    """The numbers that a judge text is put together from, and the number of its shape."""
    a = {f"a{i}": (f"cast((claim_key * {5 + i} + model_no * 3 + prompt_no + evaluator_no * 2 + {i}) % 4 "
                   f"as string)") for i in range(1, 5)}
    return {**a, "rb": "cast((claim_key + evaluator_no) % 6 as string)",
            "shape": "((claim_key + evaluator_no + prompt_no) % 5)"}


def judge_text_sql(parts: dict[str, str] | None = None) -> str:
    """Judge answer text for one (answer, evaluator), over columns claim_key,
    model_no, prompt_no, evaluator_no (SQL, both engines), or over the columns that
    ``parts`` names. Five shapes: full, one line missing, empty, single dashes, wrong case."""
    p = parts or judge_parts()
    a, rb, shape, n = (lambda i: p[f"a{i}"]), p["rb"], p["shape"], NL
    full = (f"concat('Criterion 1: --', {a(1)}, '--', {n}, 'Criterion 2: --', {a(2)}, '--', {n}, "
            f"'Criterion 3: --', {a(3)}, '--', {n}, 'Criterion 4: --', {a(4)}, '--', {n}, "
            f"'Number of relevant bullets: --', {rb}, '--')")
    gap = (f"concat('Criterion 1: --', {a(1)}, '--', {n}, 'Criterion 2: --', {a(2)}, '--', {n}, "
           f"'Criterion 4: --', {a(4)}, '--', {n}, 'Number of relevant bullets: --', {rb}, '--')")
    single = (f"concat('Criterion 1: -', {a(1)}, {n}, 'Criterion 2: ', {a(2)}, {n}, "
              f"'Criterion 3: -', {a(3)}, '-', {n}, 'Criterion 4: ', {a(4)}, {n}, "
              f"'Number of relevant bullets: -', {rb}, '-')")
    case = f"concat('criterion 1: --1--', {n}, 'Number of relevant bullets: --', {rb}, '--')"
    return (f"(CASE {shape} WHEN 0 THEN {full} WHEN 1 THEN {gap} WHEN 2 THEN '' "
            f"WHEN 3 THEN {single} ELSE {case} END)")


def judge(spark: SparkSession, sf_dir: str, gaps: bool = False, dealt: bool = False) -> DataFrame:
    """Judge responses: one row per answer x evaluator (generator_model is the
    answering model). With ``gaps`` (a fixture for merges and their coverage)
    the judge skipped the claims whose key is a multiple of 17. ``dealt`` as in ``answers``."""
    a = answers(spark, sf_dir, dealt=dealt)
    if gaps:
        a = a.filter(F.col("claim_key") % 17 != 0)
    ev = a.select("*", _literal_rows(["evaluator", "evaluator_no"],
                                     [(m, i) for i, m in enumerate(MODELS)]))
    # the parts in a projection of their own: generated code of more than 8,000 bytes is never compiled
    parts = judge_parts()
    ev = ev.select("*", *[F.expr(e).alias(f"_{n}") for n, e in parts.items()])
    return ev.select(F.col("model").alias("generator_model"), "mode", "claim_id", "prompt",
                     "evaluator", F.expr(judge_text_sql({n: f"_{n}" for n in parts})).alias("eval_text"))


def judge_sql(gaps: bool = False) -> str:
    ev = ", ".join(f"('{m}', {i})" for i, m in enumerate(MODELS))
    return (f"SELECT model AS generator_model, mode, claim_id, prompt, evaluator, "
            f"{judge_text_sql()} AS eval_text FROM answers, (VALUES {ev}) e(evaluator, evaluator_no) "
            + ("WHERE claim_key % 17 <> 0" if gaps else ""))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors of text pairs from ``embeddings``: 64 consecutive ids are a pair,
    the first 32 its candidate side (0), the others its reference side (1). Pairs grow
    in number with the table, not in size."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 64).alias("pair_id"),
                    (F.floor(F.col("vec_id") / 32) % 2).cast("int").alias("side"),
                    F.col("vec_id").alias("tok_id"), F.col("embedding").alias("vec"))
