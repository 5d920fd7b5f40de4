"""Prompt assembly (P-1 .. P-8) over claim tables.

Instructions live in a 4 x 3 literal map (style x prompt type). The lookup
is a constant expression, so no join or broadcast is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.claims import first_n, select_evidence

# ---------------------------------------------------------------------------
# The answer formats the parsers expect (one per prompt style).
FORMAT_BULLET_FIRST = ("Bullets: -- [point 1] -- [point 2] -- [point 3] (... up to 7 points) "
                       "Internal knowledge: [true/false] Verdict: [true/false/maybe] "
                       "Confidence score: [score]")
FORMAT_VERDICT_FIRST = ("[true/false/maybe] Confidence score: [score] "
                        "Bullets: -- [point 1] -- [point 2] -- [point 3] (... up to 7 points) "
                        "Internal knowledge: [true/false]")
FORMAT_VERDICT_CONF = "[true/false/maybe] Confidence score: [score]"
FORMAT_VERDICT_ONLY = "[true/false/maybe]"
JUDGE_FORMAT = ("Criterion 1: --x--\nCriterion 2: --x--\nCriterion 3: --x--\n"
                "Criterion 4: --x--\nNumber of relevant bullets: --y--")
STYLES = ["bullet_first", "verdict_first", "verdict_conf", "verdict_only"]
PROMPT_TYPES = ["basic", "internal", "claim"]
# ---------------------------------------------------------------------------

_SOURCE = {
    "basic": ("Read the claim and the evidence above.",
              "Use only the evidence given."),
    "internal": ("Read the claim and the evidence above.",
                 "Use the evidence given and what you know yourself."),
    "claim": ("Read the claim above.", "Use what you know yourself."),
}
_TASK = {
    "bullet_first": ("List the facts that matter most for judging the claim (3 to 7 points), "
                     "then judge whether the claim is true.", FORMAT_BULLET_FIRST),
    "verdict_first": ("Judge whether the claim is true first, then list the facts that "
                      "matter most (3 to 7 points).", FORMAT_VERDICT_FIRST),
    "verdict_conf": ("Judge whether the claim is true and say how sure you are (1 to 100).",
                     FORMAT_VERDICT_CONF),
    "verdict_only": ("Judge whether the claim is true. Answer with the verdict alone.",
                     FORMAT_VERDICT_ONLY),
}


# Rules that the parsers and metrics rely on, per style that asks for the part.
_RULES = {
    "confidence": "The confidence score is a whole number from 1 (guess) to 100 (certain).",
    "bullets": ("Each point is one plain statement of fact; do not mention the claim, the evidence "
                "numbers or these instructions in it."),
    "knowledge": ("Internal knowledge is true if any point rests on something you know yourself "
                  "and not on the evidence, else false."),
}
_RULES_OF = {"bullet_first": ["bullets", "knowledge", "confidence"],
             "verdict_first": ["confidence", "bullets", "knowledge"],
             "verdict_conf": ["confidence"], "verdict_only": []}


def instruction_text(style: str, prompt_type: str) -> str:
    lead, source = _SOURCE[prompt_type]
    task, fmt = _TASK[style]
    rules = "".join(" " + _RULES[r] for r in _RULES_OF[style])
    return (f"<Instruction>: {lead} {task} {source} "
            f"Answer in exactly this format: \n{fmt} "
            "The verdict is one lowercase word: true, false or maybe; use maybe only when "
            f"the information is contradictory or not enough.{rules}")


def _instruction_map() -> Column:
    kv = []
    for s in STYLES:
        for p in PROMPT_TYPES:
            kv += [F.lit(f"{s}/{p}"), F.lit(instruction_text(s, p))]
    return F.create_map(*kv)


def evidence_lines(evidence: Column) -> Column:
    """P-5: ``<Evidence i>: text`` lines, numbered from 1."""
    return F.transform(evidence, lambda x, i: F.concat(F.lit("<Evidence "), (i + 1).cast("string"),
                                                       F.lit(">: "), x, F.lit("\n")))


def prompt_text(style: str, prompt_type: str, claim: Column, evidence: Column) -> Column:
    """Claim line, evidence lines (none for the claim-only prompt), instruction;
    joined by newlines."""
    head = F.array(F.concat(F.lit("<Claim>: "), claim, F.lit("\n")))
    ev = (F.array().cast("array<string>") if prompt_type == "claim" else evidence_lines(evidence))
    tail = F.array(F.element_at(_instruction_map(), F.lit(f"{style}/{prompt_type}")))
    return F.array_join(F.concat(head, ev, tail), "\n")


def build_prompts(claims: DataFrame, style: str, n_supports: int, n_refutes: int,
                  inverse: bool = False, first: int | None = None) -> DataFrame:
    """P-1..P-4: one row per claim with enough evidence, three prompts each. ``first``
    keeps that many claims by claim id (G9); by default every claim is kept."""
    sel = first_n(select_evidence(claims, n_supports, n_refutes, inverse), first, [], ["claim_id"])
    ev = F.col("selected_evidence")
    return sel.select(
        "claim_id", "claim", F.col("factcheck_verdict").alias("fact_check"),
        *[prompt_text(style, p, F.col("claim"), ev).alias(f"{p}_prompt") for p in PROMPT_TYPES])


def judge_prompt(claim: Column, bullets: Column) -> Column:
    """P-6: claim, the bullets as ``- b`` lines, and the judge instruction."""
    lines = F.coalesce(F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n"),
                       F.lit(""))
    return F.concat(F.lit("<Claim>: "), claim, F.lit("\n<Bullet list>:\n"), lines,
                    F.lit("\n<Instruction>:\nScore the bullet list: 1 if a criterion holds, 0 if "
                          "not. Criterion 1: the bullets do not contradict each other. "
                          "Criterion 2: they are enough to judge the claim. Criterion 3: they "
                          "do not repeat each other. Criterion 4: they are clear. Then count the "
                          "bullets that matter for judging the claim. Output only the scores:\n"),
                    F.lit(JUDGE_FORMAT))


# P-8: chat wrapping as plain strings, a template per model.
# The public chat formats of the model families.
CHAT_TEMPLATES = {
    "llama": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>"
              "<|start_header_id|>user<|end_header_id|>\n\n{prompt}<|eot_id|>"
              "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "mistral": "<s>[INST] <<SYS>>\n{system}\n<</SYS>>\n\n{prompt} [/INST]",
    "qwen": ("<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{prompt}<|im_end|>\n"
             "<|im_start|>assistant\n"),
}
# the judge is asked without a system text
JUDGE_TEMPLATES = {
    "llama": ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n{prompt}<|eot_id|>"
              "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "mistral": "<s>[INST] {prompt} [/INST]",
    "qwen": "<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n",
}
SYSTEM_TEXT = "You are a careful fact-checking assistant."


def chat_wrap(model: Column, prompt: Column, templates: dict[str, str] | None = None) -> Column:
    """Wrap a prompt in the chat format of its model. ``templates`` maps a model
    to a text with {prompt} (and {system}); a row whose model has none fails the
    job instead of going on without a prompt."""
    out = None
    for name, tpl in (templates or CHAT_TEMPLATES).items():
        pre, post = tpl.replace("{system}", SYSTEM_TEXT).split("{prompt}")
        expr = F.concat(F.lit(pre), prompt, F.lit(post))
        out = F.when(model == name, expr) if out is None else out.when(model == name, expr)
    return out.otherwise(F.raise_error(F.concat(F.lit("no chat template for model "),
                                                F.coalesce(model, F.lit("null")))))
