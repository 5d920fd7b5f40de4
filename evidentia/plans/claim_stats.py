"""Claim-level statistics: E1 (category x verdict), E2 (category x mode), E5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import strip_ws
from evidentia.operators import claims as C

VALID_VERDICTS = ["True", "False", "Half True"]


def first_verdict_from_evidence(evidence: DataFrame) -> DataFrame:
    """G1 + G3 in a single aggregate: the claims that survive G1 and the first
    non-null verdict of each. After the stance filter every (claim_id, claim,
    verdict) group holds a support or a refute, so F5 holds for all of them and
    one partial/final aggregate on claim_id is enough."""
    ev = C.supports_or_refutes(C.relevant_only(evidence))
    ev = ev.filter(F.col("claim_id").isNotNull() & F.col("claim").isNotNull())
    return ev.groupBy("claim_id").agg(
        F.min_by("factcheck_verdict",
                 F.when(F.col("factcheck_verdict").isNotNull(),
                        F.struct("claim", "factcheck_verdict"))).alias("factcheck_verdict"))


def category_by_verdict(per_claim: DataFrame) -> DataFrame:
    """Claims per category and verdict. ``total_cnt`` counts every claim of
    the category, also those with another or no verdict. The borderlines row
    carries only its total; its verdict cells are NULL (G18).

    Conditional counts instead of ``pivot``: one exchange, no distinct pass."""
    per = per_claim.select(C.category("claim_id").alias("category"),
                           strip_ws(F.col("factcheck_verdict")).alias("v"))
    g = per.groupBy("category").agg(
        F.count_if(F.col("v") == "True").alias("true_cnt"),
        F.count_if(F.col("v") == "False").alias("false_cnt"),
        F.count_if(F.col("v") == "Half True").alias("half_true_cnt"),
        F.count(F.lit(1)).alias("total_cnt"))
    real = F.col("category") != "borderlines"
    return g.select("category",
                    *[F.when(real, F.col(c)).alias(c) for c in ("true_cnt", "false_cnt", "half_true_cnt")],
                    "total_cnt")


def category_by_mode_total(answers_items: DataFrame, categories: DataFrame,
                           modes: list[str]) -> DataFrame:
    """Items per category x mode over a category universe (G16), with the
    category total and a margin row 'Total' (G17, via rollup).

    ``answers_items``: one row per item with claim_id and mode.
    ``categories``: the universe, one column ``category``.
    """
    items = answers_items.select(C.category("claim_id").alias("category"),
                                 strip_ws(F.col("mode")).alias("mode"))
    aggs = [F.count_if(F.col("mode") == m).alias(f"cnt_{m}") for m in modes]
    per_cat = items.groupBy("category").agg(*aggs, F.count(F.lit(1)).alias("total_cnt"))
    # re-index to the universe: categories outside it are dropped, missing ones are zero
    uni = categories.select("category").distinct()
    full = uni.join(per_cat, "category", "left").na.fill(0)
    value_cols = [f"cnt_{m}" for m in modes] + ["total_cnt"]
    rolled = full.rollup("category").agg(*[F.sum(c).alias(c) for c in value_cols],
                                         F.grouping("category").alias("g"))
    return rolled.select(
        F.when(F.col("g") == 1, F.lit("Total")).otherwise(F.col("category")).alias("category"),
        *[F.col(c).cast("bigint").alias(c) for c in value_cols])
