"""Response extraction job (X1-X8) and its quality aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import extract as X

ANSWER_KEYS = ["model", "mode", "claim_id", "prompt"]


def extract_answers(answers: DataFrame, dialect: str = "strict", text: str = "response") -> DataFrame:
    """Typed columns from the response text in one projection.

    strict: X1 verdict, X3 confidence, X5 knowledge flag, X6 bullets.
    loose:  X2 verdict, X4 confidence (the ``conf`` runs); no bullets.
    """
    t = F.col(text)
    if dialect == "strict":
        # the bullet block feeds two regex passes: compute it once, in its own
        # projection (not collapsed into the next one, as it is read twice)
        staged = answers.withColumn("_bullet_block", X.bullet_block(t))
        return staged.select(
            *answers.columns,
            X.verdict_strict(t).alias("verdict"),
            X.confidence_strict(t).alias("confidence"),
            X.bullets_from_block(F.col("_bullet_block"), t).alias("bullets"),
            X.internal_knowledge(t).alias("internal_knowledge"))
    if dialect == "loose":
        return answers.select("*", X.verdict_loose(t).alias("verdict"),
                              X.confidence_loose(t).alias("confidence"))
    raise ValueError(f"unknown dialect {dialect!r}")


def extraction_quality(parsed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per group, answers with a missing verdict / confidence / bullets /
    knowledge flag (the warnings the reference prints, as one aggregate)."""
    keys = keys or ["model", "mode", "prompt"]
    return parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.count_if(F.col("verdict").isNull()).alias("missing_verdict"),
        F.count_if(F.col("confidence").isNull()).alias("missing_confidence"),
        F.count_if(F.size("bullets") == 0).alias("missing_bullets"),
        F.count_if(F.col("internal_knowledge").isNull()).alias("missing_knowledge"))
