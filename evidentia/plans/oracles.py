"""DuckDB oracle SQL for each registered query.

Written independently of the Spark code: the same surrogate input (shared
column expressions from ``evidentia.sources.surrogate``), then plain SQL
(GROUP BY, FILTER, string_agg, regexp_*) for the query itself.
"""

from __future__ import annotations

import re

from evidentia.sources import surrogate as S

EVIDENCE = f"evidence AS ({S.evidence_sql()})"

KEPT = """kept AS (
  SELECT * FROM evidence
  WHERE relevant AND evidence_stance IN ('supports', 'refutes')
    AND claim_id IS NOT NULL AND claim IS NOT NULL)"""

FIRST_VERDICT = """per_claim AS (
  SELECT claim_id,
         arg_min(factcheck_verdict, (claim, factcheck_verdict))
           FILTER (WHERE factcheck_verdict IS NOT NULL) AS factcheck_verdict
  FROM kept GROUP BY claim_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def materialised(ctes: str) -> str:
    """The same WITH clause, each table of it built once however often it is read."""
    return re.sub(r"^(WITH |)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", re.sub(r"\n(\w+) AS \(", r"\n\1 AS MATERIALIZED (", ctes))


ORACLES: dict[str, str] = {}

ORACLES["category_by_verdict"] = with_(EVIDENCE, KEPT, FIRST_VERDICT) + """
SELECT category,
       CASE WHEN category <> 'borderlines' THEN t END AS true_cnt,
       CASE WHEN category <> 'borderlines' THEN f END AS false_cnt,
       CASE WHEN category <> 'borderlines' THEN h END AS half_true_cnt,
       total_cnt
FROM (
  SELECT regexp_extract(claim_id, '^([^-_]*)', 1) AS category,
         CAST(count(*) FILTER (WHERE trim(factcheck_verdict) = 'True') AS BIGINT) AS t,
         CAST(count(*) FILTER (WHERE trim(factcheck_verdict) = 'False') AS BIGINT) AS f,
         CAST(count(*) FILTER (WHERE trim(factcheck_verdict) = 'Half True') AS BIGINT) AS h,
         CAST(count(*) AS BIGINT) AS total_cnt
  FROM per_claim GROUP BY 1)
"""

# --- grouped claims and answers -------------------------------------------
_ORDER = ", ".join(S.EVIDENCE_ORDER)

CLAIMS = f"""claims AS (
  SELECT claim_id, claim, factcheck_verdict,
    coalesce(list(evidence ORDER BY {_ORDER}) FILTER (WHERE evidence_stance = 'supports'),
             []::VARCHAR[]) AS supports,
    coalesce(list(evidence ORDER BY {_ORDER}) FILTER (WHERE evidence_stance = 'refutes'),
             []::VARCHAR[]) AS refutes
  FROM kept GROUP BY claim_id, claim, factcheck_verdict)"""

ANSWERS = f"answers AS ({S.answers_sql(0)})"
ANSWERS_B = f"answers_b AS ({S.answers_sql(1)})"
BASE = (EVIDENCE, KEPT, CLAIMS, ANSWERS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def first_line(x: str) -> str:
    return f"regexp_extract({x}, '^([^\\n]*)', 1)"


def verdict_strict(x: str) -> str:
    t = strip(f"lower({x})")
    r1 = f"nullif(regexp_extract({t}, 'verdict\\s*[:=]\\s*\\[?\\s*(true|false|maybe|uncertain|unknown)', 1), '')"
    r2 = (f"nullif(regexp_extract({strip(first_line(t))}, "
          "'^[\\[({]?\\s*(true|false|maybe|uncertain|unknown)\\b', 1), '')")
    v = f"coalesce({r1}, {r2})"
    return f"(CASE WHEN {v} IN ('uncertain', 'unknown') THEN 'maybe' ELSE {v} END)"


def verdict_loose(x: str) -> str:
    t = f"lower({x})"
    return (f"(CASE WHEN regexp_matches({t}, '\\btrue\\b') THEN 'true' "
            f"WHEN regexp_matches({t}, '\\bfalse\\b') THEN 'false' "
            f"WHEN regexp_matches({t}, '\\b(?:maybe|unknown|uncertain)\\b') THEN 'maybe' END)")


def _score(s: str) -> str:
    n = f"try_cast({s} AS INTEGER)"
    return f"(CASE WHEN {n} BETWEEN 0 AND 100 THEN {n} END)"


def confidence_strict(x: str) -> str:
    t = strip(x)
    r1 = f"regexp_extract({t}, '(?i)confidence\\s*score\\s*:\\s*\\[?\\s*(\\d{{1,3}})', 1)"
    r2 = f"regexp_extract({t}, '(?i)\\b(?:true|false|maybe)\\b\\]?\\s*[\\s:\\-(\\[]*\\s*(\\d{{1,3}})', 1)"
    r3 = f"regexp_extract_all({first_line(t)}, '\\b(\\d{{1,3}})\\b', 1)[-1]"
    return _score(f"(CASE WHEN {r1} <> '' THEN {r1} WHEN {r2} <> '' THEN {r2} ELSE {r3} END)")


def confidence_loose(x: str) -> str:
    t = strip(x)
    r1 = f"regexp_extract({t}, '(?i)confidence\\s*score\\s*:\\s*(\\d{{1,3}})', 1)"
    r2 = f"regexp_extract({t}, '(?i)\\b(?:true|false|maybe)\\b[\\s:\\-(\\[]*(\\d{{1,3}})', 1)"
    r3 = f"nullif(regexp_extract({first_line(t)}, '\\b(\\d{{1,3}})\\b', 1), '')"
    return _score(f"(CASE WHEN {r1} <> '' THEN {r1} WHEN {r2} <> '' THEN {r2} ELSE {r3} END)")


def internal_knowledge(x: str) -> str:
    t = strip(f"lower({x})")
    r1 = (f"regexp_extract({t}, '\\binternal(?:ly)?[-\\s]+knowledge\\b\\s*[:=]\\s*\\[?\\s*"
          "(true|false|yes|no)', 1)")
    r4 = f"regexp_extract({t}, '\\binternally\\s*[:=]\\s*(true|false)\\s*$', 1)"
    return (f"(CASE WHEN {r1} = 'yes' THEN 'true' WHEN {r1} = 'no' THEN 'false' "
            f"WHEN {r1} <> '' THEN {r1} "
            f"WHEN regexp_matches({t}, '\\bno\\s+internal(?:ly)?\\s+knowledge\\b') "
            f"OR regexp_matches({t}, 'does\\s+not\\s+indicate\\s+any\\s+internal') THEN 'false' "
            f"WHEN {r4} <> '' THEN {r4} END)")


_HEAD = ("(?:here\\s+(?:is|are)\\s+the\\s+analysis|here\\s+are\\s+the\\s+key\\s+factual\\s+insights"
         "|here''s\\s+the\\s+analysis|bullets)")
_STOP = ("\\b(?:internal(?:ly)?|internal\\s+knowledg|internal\\s*knowledge|verdict"
         "|confidence\\s+score)\\b")
_MARK = "(^|[^\\w])(--|-|[0-9]+[.)])\\s"


def bullet_block(x: str) -> str:
    block = (f"(CASE WHEN regexp_matches({x}, '(?i){_HEAD}\\s*:') "
             f"THEN regexp_extract({x}, '(?is){_HEAD}\\s*:\\s*(.*)', 1) ELSE {x} END)")
    return (f"(CASE WHEN regexp_matches({block}, '(?i){_STOP}') "
            f"THEN regexp_extract({block}, '(?is)^(.*?){_STOP}', 1) ELSE {block} END)")


def bullets(x: str) -> str:
    """RE2 has no look-around. A neutral \\x02 is put after every whitespace
    character, so a marker's trailing space can be consumed while the next
    marker still has a non-word left neighbour; item starts are marked with
    \\x01, the \\x02 removed again, and the text split."""
    blk = bullet_block(x)
    spaced = f"regexp_replace({blk}, '(\\s)', '\\1' || chr(2), 'g')"
    marked = f"regexp_replace({spaced}, '{_MARK}', '\\1' || chr(1), 'g')"
    pieces = f"string_split(replace({marked}, chr(2), ''), chr(1))[2:]"
    dash = (f"list_transform(list_filter({pieces}, lambda b: {strip('b')} <> ''), "
            f"lambda b: trim({strip('b')}, '[]'))")
    quoted = (f"list_transform(list_filter(regexp_extract_all({blk}, '\\b\\d+\\s*\"([^\"]+)\"', 1), "
              f"lambda q: {strip('q')} <> ''), lambda q: {strip('q')})")
    items = f"list_concat({dash}, {quoted})"
    out = (f"list_transform(list_filter({items}, lambda b: {strip('b')} <> ''), "
           f"lambda b: {strip(chr(116) + 'rim(b, ' + chr(39) + '[] ' + chr(39) + ')')})")
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN []::VARCHAR[] ELSE {out} END)"


_K = "model, mode, claim_id, prompt"
ORACLES["verdict_strict"] = with_(*BASE) + f"SELECT {_K}, {verdict_strict('response')} AS verdict FROM answers"
ORACLES["verdict_loose"] = with_(*BASE) + f"SELECT {_K}, {verdict_loose('response')} AS verdict FROM answers"
ORACLES["confidence_strict"] = (with_(*BASE) +
                                f"SELECT {_K}, {confidence_strict('response')} AS confidence FROM answers")
ORACLES["confidence_loose"] = (with_(*BASE) +
                               f"SELECT {_K}, {confidence_loose('response')} AS confidence FROM answers")
ORACLES["internal_knowledge"] = (with_(*BASE) +
                                 f"SELECT {_K}, {internal_knowledge('response')} AS internal_knowledge "
                                 "FROM answers")
ORACLES["bullets"] = with_(*BASE) + f"""SELECT {_K}, CAST(len(b) AS BIGINT) AS n_bullets,
  array_to_string(b, ' | ') AS bullets_text
FROM (SELECT *, {bullets('response')} AS b FROM answers)"""

PARSED = f"""parsed AS (
  SELECT *, {verdict_strict('response')} AS verdict, {confidence_strict('response')} AS confidence,
         {bullets('response')} AS bullets, {internal_knowledge('response')} AS internal_knowledge
  FROM answers)"""

ORACLES["extraction_quality"] = with_(*BASE, PARSED) + """SELECT model, mode, prompt,
  CAST(count(*) AS BIGINT) AS n_answers,
  CAST(count(*) FILTER (WHERE verdict IS NULL) AS BIGINT) AS missing_verdict,
  CAST(count(*) FILTER (WHERE confidence IS NULL) AS BIGINT) AS missing_confidence,
  CAST(count(*) FILTER (WHERE len(bullets) = 0) AS BIGINT) AS missing_bullets,
  CAST(count(*) FILTER (WHERE internal_knowledge IS NULL) AS BIGINT) AS missing_knowledge
FROM parsed GROUP BY model, mode, prompt"""

# --- statistics ---------------------------------------------------------------
_G = "mode, model, prompt"


def _cnt(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


ORACLES["verdict_counts"] = with_(*BASE, PARSED) + f"""SELECT model, mode, prompt,
  {_cnt("verdict = 'true'")} AS n_true, {_cnt("verdict = 'false'")} AS n_false,
  {_cnt("verdict = 'maybe'")} AS n_maybe, {_cnt("verdict IS NOT NULL AND verdict <> ''")} AS n_total
FROM parsed GROUP BY model, mode, prompt"""


def _pct_table() -> str:
    aggs, outs = [], []
    for mo in S.MODES:
        aggs.append(f"{_cnt(f'mode = {chr(39)}{mo}{chr(39)}')} AS rows_{mo}")
        aggs.append(f"{_cnt(f'mode = {chr(39)}{mo}{chr(39)} AND verdict IS NOT NULL AND verdict <> {chr(39)}{chr(39)}')} AS tot_{mo}")
        for x in ("true", "false", "maybe"):
            aggs.append(f"{_cnt(f'mode = {chr(39)}{mo}{chr(39)} AND verdict = {chr(39)}{x}{chr(39)}')} AS n_{x}_{mo}")
            outs.append(f"round(CASE WHEN rows_{mo} = 0 THEN NULL WHEN tot_{mo} = 0 THEN 0.0 "
                        f"ELSE 100.0 * n_{x}_{mo} / tot_{mo} END, 6) AS pct_{x}_{mo}")
    return (f"SELECT model, prompt, {', '.join(outs)} FROM (SELECT model, prompt, {', '.join(aggs)} "
            "FROM parsed GROUP BY model, prompt)")


ORACLES["verdict_pct_table"] = with_(*BASE, PARSED) + _pct_table()


def _share(column: str, valid: list[str]) -> str:
    v = f"lower({strip(column)})"
    vals = ", ".join(f"'{x}'" for x in valid)
    lab = f"(CASE WHEN {column} IS NULL THEN 'missing' WHEN {v} IN ({vals}) THEN {v} ELSE 'missing' END)"
    cats = valid + ["missing"]
    cnts = ", ".join(f"{_cnt(f'lab = {chr(39)}{c}{chr(39)}')} AS c_{c}" for c in cats)
    pcts = ", ".join(f"round(100.0 * c_{c} / n, 6) AS pct_{c}" for c in cats)
    return (f"SELECT {_G}, n, {pcts} FROM (SELECT {_G}, CAST(count(*) AS BIGINT) AS n, {cnts} "
            f"FROM (SELECT {_G}, {lab} AS lab FROM parsed) GROUP BY {_G})")


ORACLES["verdict_share_missing"] = with_(*BASE, PARSED) + _share("verdict", ["true", "false", "maybe"])
ORACLES["internal_share"] = with_(*BASE, PARSED) + _share("internal_knowledge", ["true", "false"])


def _mean_sd(source: str, value: str, keys: str = _G, pop: bool = False) -> str:
    sd = "stddev_pop" if pop else "stddev_samp"
    return (f"SELECT {keys}, CAST(count(x) AS BIGINT) AS n, round(avg(x), 6) AS mean, "
            f"round({sd}(x), 6) AS sd FROM (SELECT {keys}, {value} AS x FROM {source}) GROUP BY {keys}")


def words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"


ITEM_BULLETS = f"""items AS (
  SELECT {_G}, len(bullets) AS bullet_count,
    CASE WHEN len(nb) > 0 THEN list_sum(list_transform(nb, lambda b: {words('b')})) / len(nb)
         ELSE 0.0 END AS avg_bullet_length
  FROM (SELECT *, list_filter(bullets, lambda b: {strip('b')} <> '') AS nb FROM parsed))"""

ORACLES["confidence_stats"] = with_(*BASE, PARSED) + _mean_sd("parsed", "confidence")
ORACLES["bullet_count_stats"] = with_(*BASE, PARSED, ITEM_BULLETS) + _mean_sd("items", "bullet_count")
ORACLES["bullet_length_stats"] = (with_(*BASE, PARSED, ITEM_BULLETS) +
                                  _mean_sd("items", "avg_bullet_length"))


def syllables(w: str) -> str:
    ww = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    g = f"len(regexp_extract_all({ww}, '[aeiouy]+'))"
    return (f"(CASE WHEN {ww} = '' THEN 0 ELSE greatest({g} - "
            f"(CASE WHEN suffix({ww}, 'e') AND {g} > 1 THEN 1 ELSE 0 END), 1) END)")


def fk_grade(x: str) -> str:
    ws = f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
    nw = f"len({ws})"
    ns = f"greatest(len(regexp_extract_all({x}, '[.!?]+')), 1)"
    nsyl = f"list_sum(list_transform({ws}, lambda w: {syllables('w')}))"
    return (f"(CASE WHEN {nw} > 0 THEN 0.39 * ({nw} / {ns}) + 11.8 * ({nsyl} / {nw}) - 15.59 END)")


ITEM_FK = f"""fk_items AS (
  SELECT {_G}, CASE WHEN len(g) > 0 THEN list_sum(g) / len(g) END AS fk_grade
  FROM (SELECT *, list_filter(list_transform(bullets, lambda b: {fk_grade('b')}),
                              lambda x: x IS NOT NULL) AS g FROM parsed))"""

ORACLES["fk_stats"] = with_(*BASE, PARSED, ITEM_FK) + _mean_sd("fk_items", "fk_grade")

PARSED_B = f"""parsed_b AS (
  SELECT *, {verdict_strict('response')} AS verdict FROM answers_b)"""

ORACLES["match_rate"] = with_(*BASE, ANSWERS_B, PARSED, PARSED_B) + f"""SELECT {_G},
  CAST(count(*) AS BIGINT) AS n,
  round(avg(CASE WHEN a.verdict IS NOT DISTINCT FROM b.verdict THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS match_pct
FROM parsed a JOIN parsed_b b USING (model, mode, claim_id, prompt)
WHERE (model, mode) IN (
  SELECT (x.model, x.mode) FROM
    (SELECT model, mode, count(*) AS na FROM parsed GROUP BY ALL) x
    JOIN (SELECT model, mode, count(*) AS nb FROM parsed_b GROUP BY ALL) y USING (model, mode)
  WHERE na = nb)
GROUP BY {_G}"""

ORACLES["subset_semi"] = with_(
    EVIDENCE, KEPT, CLAIMS.replace("claims AS (", "claims AS MATERIALIZED (", 1),
    ANSWERS.replace("answers AS (", "answers AS MATERIALIZED (", 1),
    "mixed AS MATERIALIZED (SELECT DISTINCT model, claim_id FROM answers WHERE mode = 'mix')") + """
SELECT model, mode, claim_id, prompt FROM answers SEMI JOIN mixed USING (model, claim_id) WHERE mode = '1refute'"""

ORACLES["sample_sizes"] = with_(*BASE) + """SELECT mode, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(floor(count(*) / 9) AS BIGINT) AS n_items_compat,
  CAST(count(DISTINCT claim_id) AS BIGINT) AS n_claims
FROM answers GROUP BY mode"""

# --- claims and prompts ---------------------------------------------------------
from evidentia.operators import prompts as _P  # noqa: E402

_CLAIMS_TEXT = """SELECT claim_id, claim, factcheck_verdict,
  CAST(len(supports) AS BIGINT) AS n_supports, CAST(len(refutes) AS BIGINT) AS n_refutes,
  array_to_string(supports, '|') AS supports_text, array_to_string(refutes, '|') AS refutes_text
FROM {src} WHERE len(supports) > 0 OR len(refutes) > 0"""

ORACLES["claims_grouped"] = with_(EVIDENCE, KEPT, CLAIMS) + _CLAIMS_TEXT.format(src="claims")
ORACLES["claims_wide"] = ORACLES["claims_grouped"]
ORACLES["claims_first_row"] = with_(EVIDENCE) + _CLAIMS_TEXT.format(src=f"""(
  SELECT claim_id,
    arg_min(claim, ({_ORDER})) AS claim,
    arg_min(factcheck_verdict, ({_ORDER})) AS factcheck_verdict,
    coalesce(list(evidence ORDER BY {_ORDER}) FILTER (WHERE evidence_stance = 'supports'), []::VARCHAR[]) AS supports,
    coalesce(list(evidence ORDER BY {_ORDER}) FILTER (WHERE evidence_stance = 'refutes'), []::VARCHAR[]) AS refutes
  FROM evidence
  WHERE relevant AND NOT starts_with(claim_id, 'borderlines-')
    AND evidence_stance IN ('supports', 'refutes')
  GROUP BY claim_id)""")

ORACLES["evidence_funnel"] = with_(EVIDENCE) + """SELECT
  CAST(count(*) AS BIGINT) AS raw_rows,
  CAST(count(*) FILTER (WHERE relevant) AS BIGINT) AS relevant_rows,
  CAST(count(*) FILTER (WHERE relevant AND NOT starts_with(claim_id, 'borderlines-')) AS BIGINT)
    AS relevant_not_borderline_rows,
  CAST(count(*) FILTER (WHERE relevant AND NOT starts_with(claim_id, 'borderlines-')
    AND evidence_stance IN ('supports', 'refutes')) AS BIGINT) AS kept_stance_rows,
  CAST(count(DISTINCT claim_id) FILTER (WHERE relevant AND NOT starts_with(claim_id, 'borderlines-')
    AND evidence_stance IN ('supports', 'refutes')) AS BIGINT) AS kept_claims
FROM evidence"""

ORACLES["category_by_mode_total"] = with_(*BASE, FIRST_VERDICT) + """, uni AS (
  SELECT DISTINCT regexp_extract(claim_id, '^([^-_]*)', 1) AS category FROM per_claim),
per_cat AS (
  SELECT regexp_extract(claim_id, '^([^-_]*)', 1) AS category,
    count(*) FILTER (WHERE mode = '2support') AS c1, count(*) FILTER (WHERE mode = '2refute') AS c2,
    count(*) FILTER (WHERE mode = 'mix') AS c3, count(*) AS tot
  FROM answers WHERE model = 'llama' AND prompt = 'basic' GROUP BY 1),
full_t AS (
  SELECT u.category, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3,
         coalesce(tot, 0) AS tot
  FROM uni u LEFT JOIN per_cat p USING (category))
SELECT category, CAST(c1 AS BIGINT) AS cnt_2support, CAST(c2 AS BIGINT) AS cnt_2refute,
       CAST(c3 AS BIGINT) AS cnt_mix, CAST(tot AS BIGINT) AS total_cnt FROM full_t
UNION ALL
SELECT 'Total', CAST(sum(c1) AS BIGINT), CAST(sum(c2) AS BIGINT), CAST(sum(c3) AS BIGINT),
       CAST(sum(tot) AS BIGINT) FROM full_t"""

CLAIMS_V = """claims_v AS (SELECT * FROM claims WHERE factcheck_verdict IS NOT NULL)"""

ORACLES["prompt_inputs"] = with_(EVIDENCE, KEPT, CLAIMS, CLAIMS_V) + """SELECT claim_id,
  array_to_string(list_reverse(list_concat(supports[1:1], refutes[1:1])), '|') AS selected_text
FROM claims_v WHERE len(supports) >= 1 AND len(refutes) >= 1"""


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def prompt_sql(style: str, ptype: str, claim: str, sel: str) -> str:
    head = f"['<Claim>: ' || {claim} || chr(10)]"
    ev = ("[]::VARCHAR[]" if ptype == "claim" else
          f"list_transform({sel}, lambda x, i: '<Evidence ' || i || '>: ' || x || chr(10))")
    instr = _sql_lit(_P.instruction_text(style, ptype))
    return f"array_to_string(list_concat({head}, {ev}, [{instr}]), chr(10))"


def _prompt_oracle(style: str) -> str:
    parts = []
    for mode in S.MODES:
        n_s, n_r = S.MODE_EVIDENCE[mode]
        for inverse in (False, True):
            sel = f"list_concat(supports[1:{n_s}], refutes[1:{n_r}])"
            sel = f"list_reverse({sel})" if inverse else sel
            cols = ", ".join(f"{prompt_sql(style, p, 'claim', sel)} AS {p}_prompt" for p in _P.PROMPT_TYPES)
            parts.append(f"SELECT '{mode}' AS mode, {str(inverse).lower()} AS inverse, claim_id, claim, "
                         f"factcheck_verdict AS fact_check, {cols} FROM claims "
                         f"WHERE factcheck_verdict IN ('True', 'False', 'Half True') "
                         f"AND len(supports) >= {n_s} AND len(refutes) >= {n_r}")
    return with_(EVIDENCE, KEPT, CLAIMS) + "\nUNION ALL ".join(parts)


for _style in _P.STYLES:
    ORACLES[f"prompt_{_style}"] = _prompt_oracle(_style)

ORACLES["prompt_inputs_gaps"] = with_(
    f"evidence AS ({S.evidence_gaps_sql()})",
    KEPT.replace("AND claim_id IS NOT NULL", "AND evidence <> '' AND claim_id IS NOT NULL"),
    CLAIMS, CLAIMS_V) + """SELECT claim_id,
  array_to_string(list_reverse(list_concat(supports[1:1], refutes[1:1])), '|') AS selected_text
FROM claims_v WHERE len(supports) >= 1 AND len(refutes) >= 1"""
ORACLES["prompt_inputs_gaps_wide"] = ORACLES["prompt_inputs_gaps"]

_JUDGE_INSTR = _sql_lit(
    "\n<Instruction>:\nScore the bullet list: 1 if a criterion holds, 0 if "
    "not. Criterion 1: the bullets do not contradict each other. "
    "Criterion 2: they are enough to judge the claim. Criterion 3: they "
    "do not repeat each other. Criterion 4: they are clear. Then count the "
    "bullets that matter for judging the claim. Output only the scores:\n" + _P.JUDGE_FORMAT)

EVAL_PROMPTS = f"""SELECT model, mode, claim_id, prompt,
  '<Claim>: ' || claim || chr(10) || '<Bullet list>:' || chr(10)
  || coalesce(array_to_string(list_transform(bullets, lambda b: '- ' || b), chr(10)), '')
  || {_JUDGE_INSTR} AS eval_prompt
FROM parsed"""
ORACLES["eval_prompts"] = with_(*BASE, PARSED) + EVAL_PROMPTS


def _chat_sql(model: str, prompt: str, templates: dict[str, str]) -> str:
    arms = []
    for name, tpl in templates.items():
        pre, post = tpl.replace("{system}", _P.SYSTEM_TEXT).split("{prompt}")
        arms.append(f"WHEN {model} = '{name}' THEN {_sql_lit(pre)} || {prompt} || {_sql_lit(post)}")
    return "(CASE " + " ".join(arms) + " END)"


_PTEXT = "(CASE prompt " + " ".join(
    f"WHEN '{p}' THEN {prompt_sql('bullet_first', p, 'claim', 'sel')}" for p in _P.PROMPT_TYPES) + " END)"
ORACLES["chat_wrapped"] = with_(*BASE) + f"""SELECT model, mode, claim_id, prompt,
  {_chat_sql('model', _PTEXT, _P.CHAT_TEMPLATES)} AS chat_prompt FROM answers"""
_EVALUATORS = ", ".join(f"('{m}')" for m in S.MODELS)
ORACLES["judge_chat_wrapped"] = with_(*BASE, PARSED, f"ep AS ({EVAL_PROMPTS})") + f"""SELECT model, mode, claim_id, prompt,
  evaluator, {_chat_sql('evaluator', 'eval_prompt', _P.JUDGE_TEMPLATES)} AS chat_prompt
FROM ep, (VALUES {_EVALUATORS}) e(evaluator)"""


def _tag(x: str, tag: str, nxt: list[str]) -> str:
    alts = "|".join(nxt + ["$"])
    return (f"(CASE WHEN contains({x}, '{tag}') THEN "
            f"{strip(f'regexp_extract({x}, {_sql_lit(f"(?s){tag}\\s*(.*?)(?:{alts})")}, 1)')} END)")


_PB = prompt_sql("bullet_first", "basic", "claim", "sel")
ORACLES["tagged_evidence"] = with_(*BASE) + f"""SELECT model, mode, claim_id,
  {_tag('pt', '<Evidence 1>:', ['<Evidence 2>:', '<Instruction>:'])} AS evidence_1,
  {_tag('pt', '<Evidence 2>:', ['<Instruction>:'])} AS evidence_2
FROM (SELECT *, {_PB} AS pt FROM answers WHERE prompt = 'basic')"""

# --- logits ---------------------------------------------------------------------
_TOKS = ["true", "false", "maybe"]
_PR = ["basic", "internal", "claim"]


def _logit_cols() -> str:
    return ", ".join(f"{S.logit_sql(pi, ti)} AS l_{p}_{t}"
                     for pi, p in enumerate(_PR) for ti, t in enumerate(_TOKS))


def _softmax_cols() -> str:
    out = []
    for p in _PR:
        mx = f"greatest({', '.join(f'l_{p}_{t}' for t in _TOKS)})"
        s = " + ".join(f"exp(l_{p}_{t} - {mx})" for t in _TOKS)
        out += [f"exp(l_{p}_{t} - {mx}) / ({s}) AS p_{p}_{t}" for t in _TOKS]
    return ", ".join(out)


def _dp(pw: str, po: str) -> str:
    return (f"(CASE WHEN {pw} >= {po} THEN (CASE WHEN {po} < 1 THEN ({pw} - {po}) / (1 - {po}) ELSE 0.0 END) "
            f"ELSE (CASE WHEN {po} > 0 THEN ({pw} - {po}) / {po} ELSE 0.0 END) END)")


LOGIT_ITEMS = f"""litems AS (SELECT model, mode, claim_id, {_logit_cols()} FROM answers WHERE prompt = 'basic'),
probs AS (SELECT model, mode, claim_id, {_softmax_cols()} FROM litems),
toks AS (
  SELECT model, mode, claim_id, t.token,
    CASE t.token WHEN 'true' THEN p_claim_true WHEN 'false' THEN p_claim_false ELSE p_claim_maybe END AS p_claim,
    CASE t.token WHEN 'true' THEN p_basic_true WHEN 'false' THEN p_basic_false ELSE p_basic_maybe END AS p_basic,
    CASE t.token WHEN 'true' THEN p_internal_true WHEN 'false' THEN p_internal_false ELSE p_internal_maybe END AS p_internal
  FROM probs, (VALUES ('true'), ('false'), ('maybe')) t(token)),
toks2 AS (SELECT *, {_dp('p_basic', 'p_claim')} AS delta_p_basic,
                    {_dp('p_internal', 'p_claim')} AS delta_p_internal FROM toks),
dlong AS (
  SELECT model, mode, claim_id, token, 'basic' AS delta_type, round(delta_p_basic, 12) AS delta_p FROM toks2
  UNION ALL
  SELECT model, mode, claim_id, token, 'internal', round(delta_p_internal, 12) FROM toks2),
acus AS (
  SELECT model, mode, claim_id,
    CASE WHEN mode IN ('2support', '2refute') THEN sum(w * delta_p_basic) / count(*) END AS acu_basic,
    CASE WHEN mode IN ('2support', '2refute') THEN sum(w * delta_p_internal) / count(*) END AS acu_internal
  FROM (SELECT *, CASE WHEN mode = '2support' THEN (CASE WHEN token = 'true' THEN 1.0 ELSE -1.0 END)
                       WHEN mode = '2refute' THEN (CASE WHEN token = 'false' THEN 1.0 ELSE -1.0 END) END AS w
        FROM toks2)
  GROUP BY model, mode, claim_id)"""

LBASE = (*BASE, LOGIT_ITEMS)

ORACLES["softmax_delta"] = with_(*LBASE) + """SELECT model, mode, claim_id, token,
  round(p_claim, 6) AS p_claim, round(p_basic, 6) AS p_basic, round(p_internal, 6) AS p_internal,
  round(delta_p_basic, 6) AS delta_p_basic, round(delta_p_internal, 6) AS delta_p_internal FROM toks2"""

ORACLES["delta_long"] = with_(*LBASE) + """SELECT model, mode, claim_id, token, delta_type,
  round(delta_p, 6) AS delta_p, model || '-' || delta_type AS model_evidence FROM dlong"""

ORACLES["acu"] = with_(*LBASE) + """SELECT model, mode, claim_id, round(acu_basic, 6) AS acu_basic,
  round(acu_internal, 6) AS acu_internal FROM acus"""

ORACLES["acu_summary"] = with_(*LBASE) + """SELECT mode, model, round(avg(acu_basic), 6) AS mean,
  round(stddev_pop(acu_basic), 6) AS sd, CAST(count(acu_basic) AS BIGINT) AS n
FROM acus WHERE mode IN ('2support', '2refute') AND acu_basic IS NOT NULL GROUP BY mode, model"""

ORACLES["acu_combined"] = with_(*LBASE) + """SELECT acu_type, mode, model, round(avg(acu), 6) AS mean,
  round(stddev_pop(acu), 6) AS sd, CAST(count(acu) AS BIGINT) AS n
FROM (SELECT mode, model, 'acu_basic' AS acu_type, acu_basic AS acu FROM acus
      UNION ALL SELECT mode, model, 'acu_internal', acu_internal FROM acus)
WHERE mode IN ('2support', '2refute') AND acu IS NOT NULL GROUP BY acu_type, mode, model"""

ORACLES["delta_hist"] = with_(*LBASE) + """, rng AS (
  SELECT model, mode, delta_type, min(delta_p) AS lo, max(delta_p) AS hi FROM dlong GROUP BY ALL)
SELECT model, mode, delta_type, token,
  CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((delta_p - lo) / (hi - lo) * 40), 39) END AS INTEGER) AS bin,
  CAST(count(*) AS BIGINT) AS n, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi
FROM dlong JOIN rng USING (model, mode, delta_type) GROUP BY ALL"""

ORACLES["delta_box"] = with_(*LBASE) + """, d AS (SELECT *, model || '-' || delta_type AS model_evidence FROM dlong),
q AS (SELECT mode, token, model_evidence, quantile_cont(delta_p, 0.25) AS q1,
        quantile_cont(delta_p, 0.5) AS median, quantile_cont(delta_p, 0.75) AS q3
      FROM d GROUP BY ALL),
x AS (SELECT d.*, q1, median, q3,
        delta_p >= q1 - 1.5 * (q3 - q1) AND delta_p <= q3 + 1.5 * (q3 - q1) AS inside
      FROM d JOIN q USING (mode, token, model_evidence))
SELECT mode, token, model_evidence, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(delta_p) FILTER (WHERE inside), 6) AS whisker_lo,
  round(max(delta_p) FILTER (WHERE inside), 6) AS whisker_hi,
  CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_outliers
FROM x GROUP BY mode, token, model_evidence, q1, median, q3"""


def _argmax(p: str) -> str:
    ls = [f"l_{p}_{t}" for t in _TOKS]
    best = f"greatest({', '.join(ls)})"
    return "(CASE " + " ".join(f"WHEN {c} = {best} THEN '{t}'" for c, t in zip(ls, _TOKS)) + " END)"


_FT = strip("response")
ORACLES["first_token_audit"] = with_(*BASE) + f""", li AS (
  SELECT model, mode, claim_id, {_logit_cols()} FROM answers WHERE prompt = 'basic'),
x AS (
  SELECT a.model, a.mode, a.prompt,
    CASE a.prompt WHEN 'basic' THEN {_argmax('basic')} WHEN 'internal' THEN {_argmax('internal')}
         ELSE {_argmax('claim')} END AS predicted,
    CASE WHEN coalesce({_FT}, '') = '' THEN '<EMPTY>' ELSE regexp_extract({_FT}, '^(\\S+)', 1) END AS actual
  FROM answers a JOIN li USING (model, mode, claim_id))
SELECT model, mode, prompt, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE lower(actual) = predicted) AS BIGINT) AS n_agree,
  round(100.0 * avg(CASE WHEN lower(actual) = predicted THEN 1.0 ELSE 0.0 END), 6) AS agree_pct
FROM x GROUP BY model, mode, prompt"""


def normalised() -> dict[str, str]:
    """DuckDB's round keeps the sign of a tiny negative value (-0.0); Spark's does
    not. Adding 0.0 turns -0.0 into 0.0 and leaves every other value unchanged."""
    return {k: v.replace("round(", "0.0 + round(") for k, v in ORACLES.items()}

# --- judge --------------------------------------------------------------------------
JUDGE = f"judge AS ({S.judge_sql()})"


def _jf(label: str) -> str:
    return f"try_cast(nullif(regexp_extract(eval_text, '{label}\\s*-*(-?\\d+)', 1), '') AS INTEGER)"


_JCOLS = {"criterion_1": "Criterion 1:", "criterion_2": "Criterion 2:", "criterion_3": "Criterion 3:",
          "criterion_4": "Criterion 4:", "relevant_bullets": "Number of relevant bullets:"}
JUDGED = ("judged AS (SELECT generator_model, mode, claim_id, prompt, evaluator, " +
          ", ".join(f"CASE WHEN eval_text <> '' THEN {_jf(l)} END AS {c}" for c, l in _JCOLS.items()) +
          " FROM judge)")
JBASE = (*BASE, JUDGE, JUDGED)
JGAPS = (*BASE, f"judge AS ({S.judge_sql(gaps=True)})", JUDGED)

ORACLES["judge_scores"] = with_(*JBASE) + "SELECT * FROM judged"

ORACLES["judge_stats"] = with_(*JBASE) + ", lng AS (" + " UNION ALL ".join(
    f"SELECT evaluator, '{c}' AS criterion, mode, generator_model, prompt, {c} AS score FROM judged "
    f"WHERE {c} IS NOT NULL" for c in _JCOLS) + """)
SELECT evaluator, criterion, mode, generator_model, prompt,
  CAST(count(v) AS BIGINT) AS n_valid, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_invalid,
  round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd
FROM (SELECT *, criterion = 'relevant_bullets' OR score IN (0, 1) AS ok,
             CASE WHEN criterion = 'relevant_bullets' OR score IN (0, 1) THEN score END AS v FROM lng)
GROUP BY evaluator, criterion, mode, generator_model, prompt"""

ORACLES["merge_judge"] = with_(*JGAPS) + ", pa AS (SELECT generator_model AS model, mode, claim_id, prompt, " \
    "CAST(count(criterion_1) AS BIGINT) AS n_scored, " + \
    ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _JCOLS) + \
    " FROM judged GROUP BY ALL) SELECT a.model, a.mode, a.claim_id, a.prompt, n_scored, " + \
    ", ".join(f"mean_{c}" for c in _JCOLS) + \
    " FROM answers a LEFT JOIN pa USING (model, mode, claim_id, prompt)"

ORACLES["join_coverage"] = with_(*JGAPS) + """, lk AS (SELECT DISTINCT model, mode, claim_id FROM answers),
rk AS (SELECT DISTINCT generator_model AS model, mode, claim_id FROM judge),
j AS (SELECT lk.claim_id AS lid, rk.claim_id AS rid, coalesce(lk.claim_id, rk.claim_id) AS cid
      FROM lk FULL OUTER JOIN rk USING (model, mode, claim_id))
SELECT CAST(count(lid) AS BIGINT) AS n_left, CAST(count(rid) AS BIGINT) AS n_right,
  CAST(count(*) FILTER (WHERE lid IS NOT NULL AND rid IS NOT NULL) AS BIGINT) AS n_matched,
  CAST(count(*) FILTER (WHERE lid IS NOT NULL AND rid IS NULL) AS BIGINT) AS n_missing,
  (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT lid AS c FROM j WHERE rid IS NULL
     ORDER BY c LIMIT 5)) AS missing_examples
FROM j"""

ORACLES["unmatched_ids"] = with_(*JGAPS) + """SELECT DISTINCT model, mode, claim_id FROM answers a
WHERE NOT EXISTS (SELECT 1 FROM judge j WHERE j.generator_model = a.model AND j.mode = a.mode
                  AND j.claim_id = a.claim_id)"""

ORACLES["merge_judge_evaluators"] = materialised(with_(*JGAPS)) + f"""SELECT a.model, a.mode, a.claim_id, a.prompt, e.evaluator,
  {", ".join(_JCOLS)}
FROM answers a CROSS JOIN (VALUES {_EVALUATORS}) e(evaluator) LEFT JOIN judged j ON j.generator_model = a.model
  AND j.mode = a.mode AND j.claim_id = a.claim_id AND j.prompt = a.prompt AND j.evaluator = e.evaluator"""

# --- pairs ---------------------------------------------------------------------------
_PT = prompt_sql("bullet_first", "basic", "claim", "sel")


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\w]+'), lambda t: t <> '')"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


PAIRS = f"""pt AS (SELECT *, coalesce(array_to_string(bullets, ' '), '') AS cand,
    CASE WHEN prompt = 'internal' THEN {prompt_sql('bullet_first', 'internal', 'claim', 'sel')}
         ELSE {_PT} END AS ptext FROM parsed),
pairs AS (
  SELECT * FROM (
    SELECT model, mode, claim_id, prompt, 'evidence_1' AS target, cand AS candidate,
      {_tag('ptext', '<Evidence 1>:', ['<Evidence 2>:', '<Instruction>:'])} AS reference
    FROM pt WHERE prompt <> 'claim'
    UNION ALL
    SELECT model, mode, claim_id, prompt, 'evidence_2', cand,
      {_tag('ptext', '<Evidence 2>:', ['<Instruction>:'])} FROM pt WHERE prompt <> 'claim'
    UNION ALL
    SELECT model, mode, claim_id, prompt, 'claim', cand, claim FROM pt)
  WHERE NOT {_blank('candidate')} AND NOT {_blank('reference')})"""


def _lexical(src: str, keys: str) -> str:
    return f"""ct AS (SELECT {keys}, tok, count(*) AS c
  FROM (SELECT {keys}, unnest({_tokens('candidate')}) AS tok FROM {src}) GROUP BY ALL),
rt AS (SELECT {keys}, tok, count(*) AS r
  FROM (SELECT {keys}, unnest({_tokens('reference')}) AS tok FROM {src}) GROUP BY ALL),
per AS (SELECT {keys}, sum(c) AS nc, sum(CASE WHEN r IS NOT NULL THEN c END) AS mc,
          sum(r) AS nr, sum(CASE WHEN c IS NOT NULL THEN r END) AS mr
  FROM ct FULL OUTER JOIN rt USING ({keys}, tok) GROUP BY {keys}),
pr AS (SELECT {keys}, coalesce(mc, 0) / nc AS p, coalesce(mr, 0) / nr AS r FROM per),
scores AS (SELECT {keys}, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p IS NOT NULL AND r IS NOT NULL THEN 0.0 END, 4)
    AS f1 FROM pr)"""


_PK = "model, mode, claim_id, prompt, target"
PBASE = (*BASE, PARSED, PAIRS)
ORACLES["pair_inputs"] = with_(*PBASE) + "SELECT * FROM pairs"
ORACLES["pair_scores"] = with_(*PBASE, _lexical("pairs", _PK)) + "SELECT * FROM scores"

SCORE_COLS = """sc AS (SELECT model, mode, claim_id, prompt, CAST(count(*) AS BIGINT) AS n_targets,
  any_value(f1) FILTER (WHERE target = 'evidence_1') AS lexical_evidence_1,
  any_value(f1) FILTER (WHERE target = 'evidence_2') AS lexical_evidence_2,
  any_value(f1) FILTER (WHERE target = 'claim') AS lexical_claim
  FROM scores GROUP BY model, mode, claim_id, prompt)"""

ORACLES["pair_scores_map"] = with_(*PBASE, _lexical("pairs", _PK), SCORE_COLS) + "SELECT * FROM sc"
MERGED = """merged AS (SELECT a.model, a.mode, a.claim_id, a.prompt, lexical_evidence_1, lexical_evidence_2,
  lexical_claim FROM parsed a LEFT JOIN sc USING (model, mode, claim_id, prompt))"""
ORACLES["merge_scores"] = with_(*PBASE, _lexical("pairs", _PK), SCORE_COLS, MERGED) + "SELECT * FROM merged"
ORACLES["bert_diff"] = with_(*PBASE, _lexical("pairs", _PK), SCORE_COLS, MERGED) + _mean_sd(
    "merged", "CASE WHEN prompt = 'claim' THEN 0.0 ELSE abs(lexical_evidence_1 - lexical_evidence_2) END")

ANSWERS_INV = f"answers_i AS ({S.answers_sql(0, inverse=True)})"
PARSED_INV = f"""parsed_i AS (SELECT *, {bullets('response')} AS bullets FROM answers_i)"""
INV = """inv AS (SELECT model, mode, claim_id, prompt, 'inverse' AS target,
    coalesce(array_to_string(a.bullets, ' '), '') AS candidate,
    coalesce(array_to_string(b.bullets, ' '), '') AS reference
  FROM parsed a JOIN parsed_i b USING (model, mode, claim_id, prompt)),
inv2 AS (SELECT * FROM inv WHERE candidate <> '' AND reference <> '')"""
IBASE = (*BASE, ANSWERS_INV, PARSED, PARSED_INV, INV, _lexical("inv2", _PK))
ORACLES["inverse_stats"] = with_(*IBASE) + _mean_sd("scores", "f1")
ORACLES["merge_inverse"] = materialised(with_(*IBASE)) + """SELECT a.model, a.mode, a.claim_id, a.prompt, f1 AS inverse_f1
FROM parsed a LEFT JOIN scores s USING (model, mode, claim_id, prompt)"""
ORACLES["merge_scores_last"] = materialised(with_(*PBASE, _lexical("pairs", _PK), f"""dup AS (
  SELECT {_PK}, 0 AS row_ord, precision AS score FROM scores UNION ALL SELECT {_PK}, 1, f1 FROM scores),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_PK} ORDER BY row_ord DESC) AS k FROM dup) WHERE k = 1),
wide AS (SELECT model, mode, claim_id, prompt,
  max(score) FILTER (WHERE target = 'evidence_1') AS last_evidence_1,
  max(score) FILTER (WHERE target = 'evidence_2') AS last_evidence_2,
  max(score) FILTER (WHERE target = 'claim') AS last_claim FROM last GROUP BY ALL)""")) + """
SELECT a.model, a.mode, a.claim_id, a.prompt, last_evidence_1, last_evidence_2, last_claim
FROM answers a LEFT JOIN wide USING (model, mode, claim_id, prompt)"""

ORACLES["key_equality"] = with_(*BASE, ANSWERS_B) + """, ka AS (SELECT DISTINCT model, mode, claim_id FROM answers),
kb AS (SELECT DISTINCT model, mode, claim_id FROM answers_b),
j AS (SELECT model, mode, ka.claim_id AS a, kb.claim_id AS b FROM ka FULL OUTER JOIN kb USING (model, mode, claim_id))
SELECT model, mode, CAST(count(a) AS BIGINT) AS n_a, CAST(count(b) AS BIGINT) AS n_b,
  CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS n_both,
  count(a) = count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL)
    AND count(b) = count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS same_keys
FROM j GROUP BY model, mode"""

ORACLES["key_equality_gaps"] = ORACLES["key_equality"].replace(
    "claim_id FROM answers_b)", "claim_id FROM answers_b WHERE model <> 'qwen' OR claim_key % 17 <> 0)")

ORACLES["greedy_match"] = """WITH tok AS (
  SELECT CAST(floor(vec_id / 64) AS BIGINT) AS pair_id, CAST(floor(vec_id / 32) AS BIGINT) % 2 AS side, vec_id AS tok_id,
         CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
sims AS (SELECT c.pair_id, c.tok_id AS ct, r.tok_id AS rt, list_cosine_similarity(c.vec, r.vec) AS s
         FROM tok c JOIN tok r ON c.pair_id = r.pair_id AND c.side = 0 AND r.side = 1),
p AS (SELECT pair_id, avg(m) AS p FROM (SELECT pair_id, ct, max(s) AS m FROM sims GROUP BY ALL) GROUP BY ALL),
r AS (SELECT pair_id, avg(m) AS r FROM (SELECT pair_id, rt, max(s) AS m FROM sims GROUP BY ALL) GROUP BY ALL)
SELECT pair_id, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) END, 4) AS f1
FROM (SELECT DISTINCT pair_id FROM tok) LEFT JOIN p USING (pair_id) LEFT JOIN r USING (pair_id)"""

# --- sources and sinks -------------------------------------------------------------
ORACLES["claims_split_tsv"] = with_(EVIDENCE, KEPT, CLAIMS) + _CLAIMS_TEXT.format(
    src="(SELECT * FROM claims WHERE factcheck_verdict IN ('True', 'False', 'Half True'))")
ORACLES["answers_json_grid"] = with_(*BASE, PARSED) + """SELECT model, mode, claim_id, prompt, verdict,
  confidence, array_to_string(bullets, ' | ') AS bullets_text FROM parsed"""


# --- ingest, nested scores, further statistics, given texts, hooks -----------------------
ORACLES["responses_ingest"] = with_(*BASE) + f"""SELECT {_K}, factcheck_verdict, {_PTEXT} AS prompt_text, response,
  {", ".join("(CASE prompt_no " + " ".join(f"WHEN {pi} THEN {S.logit_sql(pi, ti)}" for pi in range(3)) + f" END) AS logit_{t}" for ti, t in enumerate(_TOKS))}
FROM answers"""
ORACLES["responses_ingest_wrapped"] = ORACLES["responses_ingest"]
ORACLES["judge_nested"] = ORACLES["judge_scores"]
_FALLBACK = (f"(CASE WHEN claim_key % 3 <> 0 THEN {_PB} ELSE "
             f"{prompt_sql('bullet_first', 'internal', 'claim', 'sel')} END)")
ORACLES["tagged_evidence_fallback"] = with_(*BASE) + f"""SELECT model, mode, claim_id,
  {_tag('pt', '<Evidence 1>:', ['<Evidence 2>:', '<Instruction>:'])} AS evidence_1,
  {_tag('pt', '<Evidence 2>:', ['<Instruction>:'])} AS evidence_2
FROM (SELECT *, {_FALLBACK} AS pt FROM answers WHERE prompt = 'basic')"""
ORACLES["loose_quality"] = with_(*BASE) + f"""SELECT model, mode, prompt, CAST(count(*) AS BIGINT) AS n_answers,
  CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS missing_verdict,
  CAST(count(*) FILTER (WHERE c IS NULL) AS BIGINT) AS missing_confidence
FROM (SELECT *, {verdict_loose('response')} AS v, {confidence_loose('response')} AS c FROM answers)
GROUP BY model, mode, prompt"""
_STORED = ("list_filter(list_transform(string_split('-- ' || array_to_string(bullets, ' -- '), '--'), "
           f"lambda x: {strip('x')}), lambda x: x <> '')")
ORACLES["bullet_string_stats"] = with_(
    *BASE, PARSED, f"parsed2 AS (SELECT {_K}, {_STORED} AS bullets FROM parsed)",
    ITEM_BULLETS.replace("FROM parsed)", "FROM parsed2)")) + f"""SELECT {_G}, CAST(count(*) AS BIGINT) AS n,
  round(avg(bullet_count), 6) AS mean_count, round(avg(avg_bullet_length), 6) AS mean_length FROM items GROUP BY {_G}"""
ORACLES["acu_hist"] = with_(*LBASE) + """, al AS (
  SELECT model, mode, 'acu_basic' AS acu_type, round(acu_basic, 12) AS acu FROM acus WHERE acu_basic IS NOT NULL
  UNION ALL SELECT model, mode, 'acu_internal', round(acu_internal, 12) FROM acus WHERE acu_internal IS NOT NULL),
rng AS (SELECT model, acu_type, min(acu) AS lo, max(acu) AS hi FROM al GROUP BY ALL)
SELECT model, acu_type, mode,
  CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((acu - lo) / (hi - lo) * 40), 39) END AS INTEGER) AS bin,
  CAST(count(*) AS BIGINT) AS n, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi
FROM al JOIN rng USING (model, acu_type) GROUP BY ALL"""
ORACLES["category_by_mode_verdict"] = with_(*BASE) + f"""SELECT model,
  regexp_extract(claim_id, '^([^-_]*)', 1) AS category, factcheck_verdict,
  {", ".join(f"CAST(count(*) FILTER (WHERE mode = '{m}') AS BIGINT) AS cnt_{m}" for m in S.MODES)},
  CAST(count(*) AS BIGINT) AS total_cnt FROM answers WHERE prompt = 'basic' GROUP BY ALL"""
ORACLES["documents_readability"] = f"""SELECT doc_id, CAST({words('text')} AS BIGINT) AS n_words,
  round({fk_grade('text')}, 6) AS fk_grade FROM documents"""
ORACLES["conversations_extraction"] = f"""SELECT conv_id, turn, {verdict_strict('text')} AS verdict,
  {verdict_loose('text')} AS verdict_loose, {confidence_strict('text')} AS confidence,
  {internal_knowledge('text')} AS internal_knowledge, CAST(len({bullets('text')}) AS BIGINT) AS n_bullets
FROM conversations"""
ORACLES["hook_complete"] = with_(*BASE) + f"""SELECT {_K},
  CASE length(pt) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'maybe' END AS verdict,
  CAST(length(pt) % 101 AS INTEGER) AS confidence FROM (SELECT *, {_PTEXT} AS pt FROM answers)"""
ORACLES["hook_logits"] = with_(*BASE) + f"""SELECT {_K},
  round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS p_true, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS p_false,
  round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) AS p_maybe
FROM (SELECT *, length({_PTEXT}) % 7 AS a, length({_PTEXT}) % 5 AS b, length({_PTEXT}) % 3 AS c FROM answers)"""
ORACLES["hook_scores"] = with_(*BASE) + f"""SELECT {_K}, round(length(claim) / (length(claim) + length(response)), 6) AS precision,
  round(length(response) / (length(claim) + length(response)), 6) AS recall FROM answers"""

# --- result items of drifting shape: what each shape must give, without any JSON -----------
DRIFT = """drift AS (SELECT model, mode, claim_id, claim_key,
  CASE claim_key % 7 WHEN 0 THEN CAST(claim_key % 110 AS DOUBLE) WHEN 1 THEN CAST(claim_key % 110 AS DOUBLE)
    WHEN 5 THEN claim_key % 90 + 0.5 END AS confidence,
  CASE WHEN claim_key % 7 IN (3, 4) THEN 'missing' WHEN claim_key % 7 IN (2, 6) THEN 'bad' ELSE 'ok' END AS confidence_state,
  CASE WHEN claim_key % 5 = 3 THEN (10 + claim_key % 90) / 100.0 END::DOUBLE AS score,
  CASE claim_key % 5 WHEN 3 THEN 'ok' WHEN 4 THEN 'bad' ELSE 'missing' END AS score_state,
  CASE WHEN claim_key % 3 = 2 THEN round((claim_key % 12 + 2.5) / 2, 6) END::DOUBLE AS fk_grade,
  CAST(CASE WHEN claim_key % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_bad_grades
  FROM answers WHERE prompt = 'basic')"""
ORACLES["results_variant"] = with_(*BASE, DRIFT) + "SELECT * EXCLUDE (claim_key) FROM drift"
ORACLES["results_variant_stats"] = with_(*BASE, DRIFT) + "SELECT mode, model, CAST(count(*) AS BIGINT) AS n_items, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE {c}_state = '{s}') AS BIGINT) AS {c}_{s}" for c in ("confidence", "score")
    for s in ("ok", "missing", "bad")) + """, round(avg(confidence), 6) AS mean_confidence,
  round(stddev_samp(confidence), 6) AS sd_confidence, round(avg(score), 6) AS mean_score,
  CAST(count(fk_grade) AS BIGINT) AS n_graded, round(avg(fk_grade), 6) AS mean_fk FROM drift GROUP BY mode, model"""
ORACLES["results_variant_kinds"] = with_(*BASE, DRIFT) + """SELECT field, kind, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(['model', 'mode', 'claim_id']) AS field, 'STRING' AS kind FROM drift
  UNION ALL SELECT 'key', 'BIGINT' FROM drift
  UNION ALL SELECT 'confidence', ['BIGINT', 'STRING', 'STRING', NULL, 'VOID', 'DECIMAL', 'OBJECT'][claim_key % 7 + 1] FROM drift
  UNION ALL SELECT 'bert_scores', [NULL, 'VOID', 'OBJECT', 'OBJECT', 'OBJECT'][claim_key % 5 + 1] FROM drift
  UNION ALL SELECT 'bullets_fk', [NULL, 'ARRAY', 'ARRAY'][claim_key % 3 + 1] FROM drift)
WHERE kind IS NOT NULL GROUP BY field, kind"""

# --- stored and versioned tables, positions, observed counts, sections ----------------------
ORACLES["stored_merge_scores"] = ORACLES["merge_scores_last"]
ORACLES["stored_merge_inverse"] = ORACLES["merge_inverse"]
ORACLES["stored_merge_judge_evaluators"] = ORACLES["merge_judge_evaluators"]
ORACLES["stage_replace"] = ORACLES["answers_json_grid"]
ORACLES["evidence_funnel_observed"] = ORACLES["evidence_funnel"]
ORACLES["positional_match"] = with_(*BASE, ANSWERS_B) + f"""SELECT mode, model, prompt, CAST(count(*) AS BIGINT) AS n,
  round(100.0 * count(*) FILTER (WHERE {verdict_strict('a.response')} IS NOT DISTINCT FROM {verdict_strict('b.response')})
        / count(*), 6) AS match_pct, CAST(0 AS BIGINT) AS n_wrong_prompt
FROM answers a JOIN answers_b b USING (model, mode, claim_id, prompt)
WHERE NOT (model = 'qwen' AND mode = 'mix') OR NOT EXISTS (
  SELECT 1 FROM answers_b x WHERE x.model = 'qwen' AND x.mode = 'mix' AND x.claim_key % 17 = 0)
GROUP BY mode, model, prompt"""
ORACLES["extraction_quality_observed"] = with_(*BASE, PARSED) + "SELECT " + ", ".join(
    f"CAST(count(*) FILTER (WHERE prompt = '{p}') AS BIGINT) AS n_{p}, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE prompt = '{p}' AND {cond}) AS BIGINT) AS missing_{c}_{p}" for c, cond in (
            ("verdict", "verdict IS NULL"), ("confidence", "confidence IS NULL"), ("internal_knowledge", "internal_knowledge IS NULL"),
            ("bullets", "len(bullets) = 0"))) for p in S.PROMPTS) + " FROM parsed"
ORACLES["pair_inputs_sections"] = with_(EVIDENCE) + f"""SELECT claimant, 'evidence_' || k AS target,
  'what is known of ' || claimant AS candidate, evidence AS reference
FROM (SELECT claimant, evidence, row_number() OVER (PARTITION BY claimant ORDER BY claim_key, {_ORDER}) AS k FROM evidence)
WHERE k <= 40"""

# --- soft scores -------------------------------------------------------------------------------
_SIG = " + ".join(f"(CASE WHEN sum(CASE WHEN (h >> {k}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << k} ELSE 0 END)::BIGINT" for k in range(48))
SIGNATURES = f"""toks AS (SELECT {_tokens('text')} AS t FROM (SELECT evidence AS text FROM evidence UNION ALL SELECT claim FROM evidence)),
ctx AS (SELECT t[i] AS tok, ('0x' || substr(md5(t[i + o]), 1, 12))::BIGINT AS h
  FROM toks, unnest(range(1, len(t) + 1)) AS u(i), unnest([-2, -1, 1, 2]) AS v(o) WHERE i + o BETWEEN 1 AND len(t)),
sig AS (SELECT tok, {_SIG} AS sig FROM ctx GROUP BY tok)"""


def _soft(src: str, name: str) -> str:
    """Scores of the distinct (candidate, reference) of a table."""
    return f"""{name}_u AS (SELECT DISTINCT candidate, reference FROM {src}),
{name}_t AS (SELECT text, tok, count(*) AS n FROM (SELECT text, unnest({_tokens('text')}) AS tok FROM (
  SELECT candidate AS text FROM {name}_u UNION SELECT reference FROM {name}_u)) GROUP BY ALL),
{name}_k AS (SELECT x.*, sig FROM {name}_t x LEFT JOIN sig USING (tok)),
{name}_s AS (SELECT candidate, reference, c.tok AS ct, c.n AS cn, r.tok AS rt, r.n AS rn,
    CASE WHEN c.tok = r.tok THEN 24 ELSE greatest(coalesce(24 - bit_count(xor(c.sig, r.sig)), 0), 0) END AS s
  FROM {name}_u JOIN {name}_k c ON c.text = candidate JOIN {name}_k r ON r.text = reference),
{name}_p AS (SELECT candidate, reference, sum(cn * m) / (24.0 * sum(cn)) AS p FROM (
  SELECT candidate, reference, ct, any_value(cn) AS cn, max(s) AS m FROM {name}_s GROUP BY ALL) GROUP BY ALL),
{name}_r AS (SELECT candidate, reference, sum(rn * m) / (24.0 * sum(rn)) AS r FROM (
  SELECT candidate, reference, rt, any_value(rn) AS rn, max(s) AS m FROM {name}_s GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT candidate, reference, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM {name}_p JOIN {name}_r USING (candidate, reference))"""


ORACLES["token_signatures"] = with_(EVIDENCE, SIGNATURES) + "SELECT tok, sig FROM sig"
SBASE = materialised(with_(*PBASE, SIGNATURES, _soft("pairs", "soft")))
ORACLES["pair_scores_soft"] = SBASE + f"SELECT {_PK}, precision, recall, f1 FROM pairs LEFT JOIN soft USING (candidate, reference)"
ORACLES["pair_scores_rescaled"] = materialised(with_(*PBASE, SIGNATURES, _soft("pairs", "soft"), f"""num AS (
  SELECT row_number() OVER (ORDER BY md5(to_json({{model: model, mode: mode, claim_id: claim_id, prompt: prompt, target: target}})::VARCHAR),
    candidate, reference) - 1 AS k, count(*) OVER () AS n, candidate, reference FROM pairs),
shifted AS (SELECT a.candidate, b.reference FROM num a JOIN num b ON b.k = (a.k + 1) % a.n)""", _soft("shifted", "rnd"),
    "base AS (SELECT sum(round(f1 * 10000)::BIGINT) / (10000.0 * count(f1)) AS b FROM shifted JOIN rnd USING (candidate, reference))")) + f"""
SELECT {_PK}, f1, round(b, 6) AS baseline, round((f1 - b) / (1 - b), 4) AS f1_rescaled
FROM pairs LEFT JOIN soft USING (candidate, reference), base"""

# --- wide export of long lists, first claims of each mode -----------------------------------
_PLACES = with_(EVIDENCE, KEPT) + f"""SELECT claim_id, claim, factcheck_verdict, evidence_stance AS stance,
  row_number() OVER (PARTITION BY claim_id, claim, factcheck_verdict, evidence_stance ORDER BY {_ORDER}) AS place, evidence FROM kept"""
ORACLES["claims_wide_slices"] = _PLACES
ORACLES["claims_wide_widths"] = f"SELECT stance, CAST(max(place) AS BIGINT) AS width FROM ({_PLACES}) GROUP BY stance"
ORACLES["prompt_first_n"] = with_(*BASE) + f"""SELECT mode, claim_id, prompt_text FROM (
  SELECT mode, claim_id, {_PB} AS prompt_text, row_number() OVER (PARTITION BY mode ORDER BY claim_id) AS k
  FROM answers WHERE model = 'llama' AND prompt = 'basic') WHERE k <= 100"""

ORACLES["evidence_tsv_ranges"] = with_(EVIDENCE) + """SELECT claim_id, claim, factcheck_verdict,
  evidence || ',' || chr(10) || '"quoted"' AS evidence, evidence_stance FROM evidence"""
