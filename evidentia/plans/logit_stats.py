"""Evidence-usage metrics from first-token logits.

One lazy plan: items -> softmax -> delta-P -> long rows -> aggregates. The
small per-group tables (histogram ranges, box fences) have one row per
(model, mode, type) or (mode, token, model_evidence): their size is fixed by
the vocabulary (3 models x 4 modes x 3 tokens x 2 types), not by the data, so
joining them back is a broadcast of a bounded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import logits as L
from evidentia.plans.quantiles import exact_quantiles
from evidentia.session import materialize, stage_table

ITEM = ["model", "mode", "claim_id"]


def probabilities(items: DataFrame) -> DataFrame:
    """Per item: softmax of each prompt's logits and delta-P of the evidence
    prompts against the claim-only prompt."""
    p_b, p_i, p_c = (L.softmax(F.col(f"logits_{p}")) for p in ("basic", "internal", "claim"))
    return items.select(*ITEM, p_b.alias("p_basic"), p_i.alias("p_internal"), p_c.alias("p_claim")) \
        .withColumn("delta_basic", L.delta_p(F.col("p_basic"), F.col("p_claim"))) \
        .withColumn("delta_internal", L.delta_p(F.col("p_internal"), F.col("p_claim")))


def long_tokens(probs: DataFrame) -> DataFrame:
    """One row per item x token."""
    x = probs.select("*", F.explode(F.map_keys("p_claim")).alias("token"))
    t = F.col("token")
    return x.select(*ITEM, "token",
                    F.element_at("p_claim", t).alias("p_claim"),
                    F.element_at("p_basic", t).alias("p_basic"),
                    F.element_at("p_internal", t).alias("p_internal"),
                    F.element_at("delta_basic", t).alias("delta_p_basic"),
                    F.element_at("delta_internal", t).alias("delta_p_internal"))


def delta_long(tokens: DataFrame) -> DataFrame:
    """M5 + G12: melt the two delta-P columns into (delta_type, delta_p).

    delta-P is rounded to 12 digits: two mathematically equal probabilities
    can differ in the last bits after ``exp``, and with a zero IQR that noise
    alone would decide whether a value is an outlier or which bin it is in."""
    m = tokens.select(*ITEM, "token", F.round("delta_p_basic", 12).alias("basic"),
                      F.round("delta_p_internal", 12).alias("internal"))
    u = m.unpivot([*ITEM, "token"], ["basic", "internal"], "delta_type", "delta_p")
    return u.withColumn("model_evidence", F.concat_ws("-", "model", "delta_type"))


def acu_items(probs: DataFrame) -> DataFrame:
    """M6: ACU per item for the basic and internal prompts."""
    mode = F.col("mode")
    return probs.select(*ITEM, L.acu(F.col("delta_basic"), mode).alias("acu_basic"),
                        L.acu(F.col("delta_internal"), mode).alias("acu_internal"))


def acu_summary(acus: DataFrame, column: str = "acu_basic",
                modes: tuple[str, ...] = ("2support", "2refute")) -> DataFrame:
    """Mean, population sd and N of the ACU per (mode, model); NULL ACU
    dropped (F12). Only modes with a direction are summarised."""
    x = F.col(column)
    # avg / stddev / count skip NULL ACU by themselves; filtering on the ACU
    # column would be pushed into the projection and compute it twice
    g = acus.filter(F.col("mode").isin(list(modes))).groupBy("mode", "model").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"),
        F.count(x).alias("n"))
    return g.filter(F.col("n") > 0)


def acu_combined(acus: DataFrame, modes: tuple[str, ...] = ("2support", "2refute")) -> DataFrame:
    """Both ACU types side by side as rows of (acu_type, mode, model)."""
    u = acus.unpivot(ITEM, ["acu_basic", "acu_internal"], "acu_type", "acu")
    x = F.col("acu")
    return u.filter(F.col("mode").isin(list(modes)) & x.isNotNull()) \
        .groupBy("acu_type", "mode", "model").agg(
            F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("sd"),
            F.count(x).alias("n"))


def histogram(long: DataFrame, value: str, group: list[str], by: list[str], bins: int = 40) -> DataFrame:
    """Equal-width histogram with ``bins`` bins per ``group``; the range
    is shared by every ``by`` value (as one plot with hue). The last bin is
    closed (P13)."""
    # read twice (range, then binning): materialise the narrow input once
    long = materialize(long.select(*group, *by, value))
    # a row per group: staged, its size is known, and the long table is not shuffled for it
    rng = stage_table(long.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "hist-range")
    x = long.join(rng, group)
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) / width * bins), F.lit(bins - 1)))
    return x.select(*group, *by, b.cast("int").alias("bin"), "lo", "hi") \
        .groupBy(*group, *by, "bin").agg(F.count(F.lit(1)).alias("n"),
                                         F.round(F.first("lo"), 6).alias("lo"),
                                         F.round(F.first("hi"), 6).alias("hi"))


def boxplot(long: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Quartiles (linear interpolation), whiskers = furthest values inside
    1.5 IQR fences, number of outliers, per group. The quartiles are exact and
    computed without gathering a group in one task (``exact_quantiles``)."""
    # read by every quantile step and the whisker pass: materialise it once
    long = materialize(long.select(*group, value))
    q = exact_quantiles(long, value, group, [0.25, 0.5, 0.75]).select(
        *group, F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    q = stage_table(q, "box-quartiles")
    iqr = F.col("q3") - F.col("q1")
    x = long.join(q, group).withColumn("inside", (
        (F.col(value) >= F.col("q1") - 1.5 * iqr) & (F.col(value) <= F.col("q3") + 1.5 * iqr)))
    v = F.col(value)
    return x.groupBy(*group, "q1", "median", "q3").agg(
        F.min(F.when(F.col("inside"), v)).alias("whisker_lo"),
        F.max(F.when(F.col("inside"), v)).alias("whisker_hi"),
        F.count_if(~F.col("inside")).alias("n_outliers")) \
        .select(*group, *[F.round(c, 6).alias(c) for c in
                          ("q1", "median", "q3", "whisker_lo", "whisker_hi")], "n_outliers")
