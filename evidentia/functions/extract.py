"""Extraction rules over free response text, as native Column expressions.

All rules run inside whole-stage code generation (regexp_* and higher-order
functions), no Python UDF. Two dialects exist: *strict* (bullet-first and
verdict-first runs) and *loose* (verdict-only and verdict+confidence runs).

Java regexes default to ASCII classes; ``(?U)`` makes ``\\w \\d \\s \\b``
Unicode-aware as in Python (pitfall P2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import first_line, nullif_empty, strip_ws

# ---------------------------------------------------------------------------
# The words and patterns the rules accept.
VERDICT_WORDS = "true|false|maybe|uncertain|unknown"
MAYBE_SYNONYMS = ["uncertain", "unknown"]
VERDICTS = {w: "maybe" if w in MAYBE_SYNONYMS else w for w in VERDICT_WORDS.split("|")}
KNOWLEDGE_VALUES = "true|false|yes|no"
KNOWLEDGE = {"true": "true", "false": "false", "yes": "true", "no": "false"}
BULLET_HEADERS = (r"here\s+(?:is|are)\s+the\s+analysis"
                  r"|here\s+are\s+the\s+key\s+factual\s+insights"
                  r"|here's\s+the\s+analysis"
                  r"|bullets")
BULLET_STOP_WORDS = (r"internal(?:ly)?|internal\s+knowledg|internal\s*knowledge"
                     r"|verdict|confidence\s+score")
# ``--``, ``-``, ``1.`` or ``1)`` before white space, no word character in front; the
# look behind comes after the first character, which few places pass
BULLET_START = r"(?:-(?<!\w-)-?|\d(?<!\w\d)\d*+[.)])\s+"
# PY_WHITESPACE, what str.strip() removes, as a regex class
PY_SPACE = (r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
            r"\x{202f}\x{205f}\x{3000}]")
JUDGE_FIELDS = {
    "criterion_1": "Criterion 1:",
    "criterion_2": "Criterion 2:",
    "criterion_3": "Criterion 3:",
    "criterion_4": "Criterion 4:",
    "relevant_bullets": "Number of relevant bullets:",
}
# ---------------------------------------------------------------------------

def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A column named twice is computed twice wherever the plan does not see that it is the
# same (in every branch of a CASE), so these three read theirs once.
def _meaning(word: Column, meanings: dict[str, str]) -> Column:
    """What a captured word stands for; NULL for '' (no match)."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in meanings.items() for x in kv]), word)


def _first_match(t: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL without one. The rest of the text is taken
    along, so no second match is looked for."""
    return F.get(F.regexp_extract_all(t, F.lit(rf"{pattern}(?s:.*+)"), 1), 0)


def _score(s: Column) -> Column:
    """Digits -> INT; values outside 0..100 give NULL."""
    return F.get(F.sequence(F.lit(0), F.lit(100)), s.try_cast("int"))


# X1 ------------------------------------------------------------------------
def verdict_strict(text: Column | str) -> Column:
    """``verdict: [x]`` anywhere, else the first line starting with the word
    (optionally after an opening bracket). unknown / uncertain -> maybe."""
    t = F.lower(_as_col(text))
    r1 = F.regexp_extract(t, rf"(?U)verdict\s*[:=]\s*\[?\s*({VERDICT_WORDS})", 1)
    # the line ends at the first newline after the leading white space
    r2 = F.regexp_extract(t, rf"(?U)\A{PY_SPACE}*+[\[({{]?[\s&&[^\n]]*({VERDICT_WORDS})\b", 1)
    return F.coalesce(_meaning(r1, VERDICTS), _meaning(r2, VERDICTS))


# X2 ------------------------------------------------------------------------
def verdict_loose(text: Column | str) -> Column:
    """Word ``true`` anywhere wins, then ``false``, then maybe / unknown /
    uncertain -> maybe."""
    t = F.lower(_as_col(text))
    return (F.when(t.rlike(r"(?U)\btrue\b"), F.lit("true"))
            .when(t.rlike(r"(?U)\bfalse\b"), F.lit("false"))
            .when(t.rlike(r"(?U)\b(?:maybe|unknown|uncertain)\b"), F.lit("maybe")))


# X3 ------------------------------------------------------------------------
def confidence_strict(text: Column | str) -> Column:
    """``confidence score: [n]``, else a verdict word followed by a number,
    else the LAST 1-3 digit number of the first line. The first rule that
    matches decides; a value over 100 gives NULL without falling through."""
    t = _as_col(text)
    r1 = _first_match(t, r"(?iU)(?=c)confidence\s*score\s*:\s*\[?\s*(\d{1,3})")
    # the classes in front let most places fail at once
    r2 = _first_match(t, r"(?iU)(?=[tfm])\b(?:true|false|maybe)\b\]?\s*[\s:\-(\[]*\s*(\d{1,3})")
    # NULL without a match, not '': try_cast throws and catches an error for each ''
    r3 = _first_match(t, rf"(?U)\A{PY_SPACE}*+[^\n]*\b(\d{{1,3}})\b")
    return _score(F.coalesce(r1, r2, r3))


# X4 ------------------------------------------------------------------------
def confidence_loose(text: Column | str) -> Column:
    """As X3 without bracket support; the third rule takes the FIRST number."""
    t = strip_ws(_as_col(text))
    r1 = F.regexp_extract(t, r"(?iU)confidence\s*score\s*:\s*(\d{1,3})", 1)
    r2 = F.regexp_extract(t, r"(?iU)\b(?:true|false|maybe)\b[\s:\-(\[]*(\d{1,3})", 1)
    r3 = F.regexp_extract(first_line(t), r"(?U)\b(\d{1,3})\b", 1)
    return _score(F.when(r1 != "", r1).when(r2 != "", r2).otherwise(nullif_empty(r3)))


# X5 ------------------------------------------------------------------------
def internal_knowledge(text: Column | str) -> Column:
    """'true' / 'false' / NULL: an explicit ``internal knowledge: x`` field,
    then the phrases that deny internal knowledge, then ``internally: x`` at
    the very end."""
    t = F.lower(_as_col(text))
    r1 = F.regexp_extract(
        t, rf"(?U)(?=i)\binternal(?:ly)?[-\s]+knowledge\b\s*[:=]\s*\[?\s*({KNOWLEDGE_VALUES})", 1)
    denies = (t.rlike(r"(?U)(?=n)\bno\s+internal(?:ly)?\s+knowledge\b")
              | t.rlike(r"(?U)does\s+not\s+indicate\s+any\s+internal"))
    r4 = F.regexp_extract(t, rf"(?U)(?=i)\binternally\s*[:=]\s*(true|false){PY_SPACE}*+\z", 1)
    return F.coalesce(_meaning(r1, KNOWLEDGE), F.when(denies, F.lit("false")), _meaning(r4, KNOWLEDGE))


# X6 ------------------------------------------------------------------------
def bullet_block(text: Column | str) -> Column:
    """Text after the bullet header (or all of it), cut before the first
    stop word (internal..., verdict, confidence score)."""
    t = _as_col(text)
    # the classes in front let most places fail at once: headers begin with he or bu,
    # stop words with in, ve or co (case folding takes the two Turkish i for an i)
    block = F.coalesce(_first_match(t, rf"(?iU)(?=[hb][eu])(?:{BULLET_HEADERS})\s*:\s*([\s\S]*)"), t)
    stop = rf"(?isU)(?=(?-i:[ivcIVC\x{{130}}\x{{131}}][neoNEO]))\b(?:{BULLET_STOP_WORDS})\b"
    return F.regexp_replace(block, F.lit(rf"{stop}.*+"), F.lit(""))


def bullets(text: Column | str) -> Column:
    """ARRAY<STRING> of bullet items: items start at ``--``, ``-``, ``1.`` or
    ``1)`` not preceded by a word character and followed by whitespace; then
    numbered quotes (``2 "..."``) are appended. Brackets are stripped."""
    return bullets_from_block(bullet_block(text), text)


def _tidy(item: Column) -> Column:
    """A stripped item without brackets and spaces around it, stripped."""
    edge = (item.startswith("[") | item.startswith("]") | item.endswith("[") | item.endswith("]"))
    return F.when(edge, strip_ws(F.btrim(item, F.lit("[] ")))).otherwise(item)


def _block_items(block: Column) -> Column:
    none = F.array().cast("array<string>")
    stripped = lambda pattern: F.transform(F.regexp_extract_all(block, F.lit(pattern), 1), strip_ws)
    # blank between its brackets
    blank = rf"\A[\[\]]*+{PY_SPACE}*+[\[\]]*+\z"
    dash = F.filter(stripped(rf"(?sU){BULLET_START}(.*?)(?={BULLET_START}|\z)"), lambda b: ~b.rlike(blank))
    quoted = F.when(block.contains('"'), F.filter(stripped(r'(?U)\b\d+\s*"([^"]+)"'), lambda b: b != "")).otherwise(none)
    return F.transform(F.concat(dash, quoted), _tidy)


def bullets_from_block(block: Column | str, text: Column | str) -> Column:
    """X6 after ``bullet_block``: lets a job compute the block once in its own
    projection (it is read twice here)."""
    # in a lambda over one element, so the block is computed once, whatever the plan;
    # regexp_extract_all keeps its compiled pattern, split compiles it for every row
    out = F.get(F.transform(F.array(_as_col(block)), _block_items), 0)
    return F.when(_as_col(text).isNull() | (_as_col(text) == ""),
                  F.array().cast("array<string>")).otherwise(out)


# X9 ------------------------------------------------------------------------
def judge_field(text: Column | str, label: str) -> Column:
    """``<label> --n--``: the greedy ``-*`` means a minus sign is never kept."""
    t = _as_col(text)
    number = F.regexp_extract(t, rf"\Q{label}\E\s*-*(-?\d+)", 1)
    # a text without the label is not searched; '' (no number) is taken out, since try_cast
    # throws and catches an error for it, and a test before it would match twice
    return F.get(F.array_remove(F.array(F.when(t.contains(label), number)), F.lit("")), 0).try_cast("int")


def judge_scores(text: Column | str) -> Column:
    """STRUCT of the five judge fields; NULL for an empty text."""
    t = _as_col(text)
    s = F.struct(*[judge_field(t, lab).alias(name) for name, lab in JUDGE_FIELDS.items()])
    return F.when(t.isNotNull() & (t != ""), s)


# X11 -----------------------------------------------------------------------
def tagged_section(text: Column | str, tag: str, next_tags: list[str]) -> Column:
    """Text after ``tag`` up to the first of ``next_tags`` or the end, stripped;
    NULL when the tag is absent or the text is empty."""
    t = _as_col(text)
    nxt = "|".join(rf"\Q{x}\E" for x in next_tags)
    body = F.regexp_extract(t, rf"(?s)\Q{tag}\E\s*(.*?)(?={nxt}|$)", 1)
    return F.when(t.contains(tag), strip_ws(body))


def evidence_pair(prompt: Column | str) -> tuple[Column, Column]:
    """``<Evidence 1>:`` and ``<Evidence 2>:`` sections of a prompt."""
    return (tagged_section(prompt, "<Evidence 1>:", ["<Evidence 2>:", "<Instruction>:"]),
            tagged_section(prompt, "<Evidence 2>:", ["<Instruction>:"]))


def evidence_sections(prompt: Column | str) -> Column:
    """All ``<Evidence i>:`` sections of a prompt in one pass, whatever their number:
    ARRAY<STRUCT<index, text>> in prompt order, texts stripped."""
    t = _as_col(prompt)
    each = F.lit(r"(?s)<Evidence (\d+)>:\s*(.*?)(?=<Evidence \d+>:|<Instruction>:|\z)")
    zipped = F.arrays_zip(F.regexp_extract_all(t, each, 1).alias("index"), F.regexp_extract_all(t, each, 2).alias("text"))
    return F.transform(zipped, lambda x: F.struct(x["index"].try_cast("int").alias("index"), strip_ws(x["text"]).alias("text")))


# X13 -----------------------------------------------------------------------
def first_token(text: Column | str) -> Column:
    """First whitespace-separated token of the output, '<EMPTY>' if blank."""
    t = strip_ws(_as_col(text))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("<EMPTY>")).otherwise(
        F.regexp_extract(t, r"(?U)^(\S+)", 1))
