"""Claim / evidence operators: filters, grouping by claim, wide layout.

Every function is DataFrame -> DataFrame; nothing is collected to the driver
except the list width of the wide export (``max_list_width``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP_STANCES = ["supports", "refutes"]


def category(claim_id: Column | str) -> Column:
    """Text of the claim id before the first '-' or '_' (F6)."""
    return F.regexp_extract(F.col(claim_id) if isinstance(claim_id, str) else claim_id,
                            r"^([^-_]*)", 1)


def relevant_only(evidence: DataFrame) -> DataFrame:
    """keep relevant evidence; a null flag is dropped."""
    return evidence.filter(F.col("relevant") == F.lit(True))


def drop_borderlines(evidence: DataFrame) -> DataFrame:
    """drop claims whose id starts with 'borderlines-'."""
    return evidence.filter(~F.col("claim_id").startswith("borderlines-"))


def supports_or_refutes(evidence: DataFrame) -> DataFrame:
    """stance is supports or refutes."""
    return evidence.filter(F.col("evidence_stance").isin(KEEP_STANCES))


def _ordered(stance: str) -> Column:
    # Collect structs so that a null evidence text still counts; the
    # struct is null only for rows of the other stance, which collect drops.
    item = F.struct(F.col("row_ord").alias("o"), F.col("evidence").alias("e"))
    coll = F.collect_list(F.when(F.col("evidence_stance") == stance, item))
    return F.transform(F.array_sort(coll), lambda x: x["e"])


CLAIM_KEYS = ["claim_id", "claim", "factcheck_verdict"]


def valid_evidence(text: Column) -> Column:
    """evidence counts for prompts only if it is neither null nor empty."""
    return text.isNotNull() & (text != "")


def first_k_per_stance(evidence: DataFrame, k: int) -> DataFrame:
    """The first ``k`` evidence rows (file order) of each claim and stance.

    ``row_number() <= k`` is planned as a WindowGroupLimit that also runs
    before the shuffle, so a claim with very much evidence sends at most k
    rows per map task instead of all of them."""
    w = Window.partitionBy(*CLAIM_KEYS, "evidence_stance").orderBy("row_ord")
    return evidence.withColumn("_rank", F.row_number().over(w)) \
        .filter(F.col("_rank") <= k).drop("_rank")


def group_claims(evidence: DataFrame, keep_null_verdict: bool = True,
                 max_per_stance: int | None = None, valid_only: bool | None = None) -> DataFrame:
    """G1 + F1 + F4 + F5: one row per (claim_id, claim, factcheck_verdict) with
    the ordered supports and refutes lists; claims with neither are dropped.

    Null keys are dropped as a pandas group-by does; ``keep_null_verdict``
    keeps claims without a fact-check verdict (the borderlines claims).
    The stance filter runs before the shuffle so that only the evidence that
    ends up in a list is moved. With ``max_per_stance`` only the first k
    supports and refutes are kept (enough for prompts and mode checks, which
    need at most two), and the lists stay bounded whatever a claim holds. Null
    and empty texts are dropped before they are ranked (``valid_only``, by
    default with ``max_per_stance``); the plain exports keep them (P9).
    """
    ev = supports_or_refutes(relevant_only(evidence))
    if max_per_stance is not None if valid_only is None else valid_only:
        ev = ev.filter(valid_evidence(F.col("evidence")))
    ev = ev.filter(F.col("claim_id").isNotNull() & F.col("claim").isNotNull())
    if not keep_null_verdict:
        ev = ev.filter(F.col("factcheck_verdict").isNotNull())
    if max_per_stance is not None:
        ev = first_k_per_stance(ev, max_per_stance)
    out = ev.groupBy(*CLAIM_KEYS).agg(
        _ordered("supports").alias("supports"), _ordered("refutes").alias("refutes"))
    return out.filter((F.size("supports") > 0) | (F.size("refutes") > 0))


def group_claims_first_row(evidence: DataFrame) -> DataFrame:
    """G2 + F1-F5: group by claim_id only; claim text and verdict come from the
    claim's first evidence row (file order). Borderlines claims are dropped."""
    ev = supports_or_refutes(drop_borderlines(relevant_only(evidence)))
    out = ev.groupBy("claim_id").agg(
        F.min_by("claim", "row_ord").alias("claim"),
        F.min_by("factcheck_verdict", "row_ord").alias("factcheck_verdict"),
        _ordered("supports").alias("supports"),
        _ordered("refutes").alias("refutes"))
    return out.filter((F.size("supports") > 0) | (F.size("refutes") > 0))


def max_list_width(claims: DataFrame) -> tuple[int, int]:
    """Longest supports and refutes lists (a single driver scalar pair)."""
    row = claims.agg(F.coalesce(F.max(F.size("supports")), F.lit(0)).alias("s"),
                     F.coalesce(F.max(F.size("refutes")), F.lit(0)).alias("r")).first()
    return int(row["s"]), int(row["r"])


def to_wide(claims: DataFrame, n_supports: int, n_refutes: int, pad: str | None = "") -> DataFrame:
    """Arrays to padded columns support_evidence_1..n, refute_evidence_1..m.
    ``pad`` is '' for the G1 path and None for the G2 path."""
    def cell(arr: str, i: int) -> Column:
        v = F.get(F.col(arr), F.lit(i))
        return v if pad is None else F.when(F.lit(i) < F.size(arr), v).otherwise(F.lit(pad))
    cols = [F.col("claim_id"), F.col("claim"), F.col("factcheck_verdict")]
    cols += [cell("supports", i).alias(f"support_evidence_{i + 1}") for i in range(n_supports)]
    cols += [cell("refutes", i).alias(f"refute_evidence_{i + 1}") for i in range(n_refutes)]
    return claims.select(*cols)


def from_wide(wide: DataFrame) -> DataFrame:
    """Padded columns back to compact arrays, skipping null and empty cells."""
    s_cols = sorted([c for c in wide.columns if c.startswith("support_evidence_")],
                    key=lambda c: int(c.rsplit("_", 1)[1]))
    r_cols = sorted([c for c in wide.columns if c.startswith("refute_evidence_")],
                    key=lambda c: int(c.rsplit("_", 1)[1]))

    def compact(cols: list[str]) -> Column:
        if not cols:
            return F.array().cast("array<string>")
        return F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))
    keep = [c for c in wide.columns if c not in s_cols + r_cols]
    return wide.select(*keep, compact(s_cols).alias("supports"), compact(r_cols).alias("refutes"))


def select_evidence(claims: DataFrame, n_supports: int, n_refutes: int,
                    inverse: bool = False) -> DataFrame:
    """F9 + G7 + G8: claims with at least n valid supports and m valid refutes, and
    the first n supports followed by the first m refutes (reversed if asked)."""
    ok = claims.withColumns({c: F.filter(c, valid_evidence) for c in ("supports", "refutes")})
    ok = ok.filter((F.size("supports") >= n_supports) & (F.size("refutes") >= n_refutes))
    sel = F.concat(F.slice("supports", 1, n_supports) if n_supports else F.array().cast("array<string>"),
                   F.slice("refutes", 1, n_refutes) if n_refutes else F.array().cast("array<string>"))
    if inverse:
        sel = F.reverse(sel)
    return ok.withColumn("selected_evidence", sel)


def verdict_split(claims: DataFrame) -> DataFrame:
    """S6 filter: only the three verdicts kept by the split (others dropped)."""
    return claims.filter(F.col("factcheck_verdict").isin("True", "False", "Half True"))


def funnel(evidence: DataFrame) -> DataFrame:
    """E5: counts after each filter of the claim preparation, in one pass."""
    rel = F.col("relevant") == F.lit(True)
    nb = ~F.col("claim_id").startswith("borderlines-")
    st = F.col("evidence_stance").isin(KEEP_STANCES)
    return evidence.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(rel).alias("relevant_rows"),
        F.count_if(rel & nb).alias("relevant_not_borderline_rows"),
        F.count_if(rel & nb & st).alias("kept_stance_rows"),
        F.count_distinct(F.when(rel & nb & st, F.col("claim_id"))).alias("kept_claims"))


def first_n(rows: DataFrame, n: int | None, group: list[str], order: list[str]) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (make it unique: the claim
    id last), exactly ``n`` where there are so many; all rows for None, the default of
    every prompt builder. The rows are numbered by ranges, so no group is sorted in
    one task, whatever ``n`` is."""
    from evidentia.operators.numbering import numbered
    if n is None:
        return rows
    numbers = numbered(rows, [F.asc(c) for c in (*group, *order)], "_no")
    first, here = numbers.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.min("_no").alias("_first")), None
    for c in group:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        here = same if here is None else here & same
    joined = numbers.join(first, here) if group else numbers.withColumn("_first", F.lit(0))
    return joined.filter(F.col("_no") - F.col("_first") < n).select(*rows.columns)
