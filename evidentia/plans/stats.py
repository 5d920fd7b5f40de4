"""Grouped statistics over parsed answers.

All statistics are conditional aggregates over (mode, model, prompt), so
each is one partial + final aggregate; pandas ``std`` is the sample
standard deviation (``stddev_samp``), NULL for a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import strip_ws, word_count

GROUP = ["mode", "model", "prompt"]
VERDICT_SET = ["true", "false", "maybe"]


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def normalise_label(c: Column, valid: list[str]) -> Column:
    """F8: NULL -> 'missing'; strip + lower; outside the valid set -> 'missing'."""
    v = F.lower(strip_ws(c))
    return F.when(c.isNull(), F.lit("missing")).when(v.isin(valid), v).otherwise(F.lit("missing"))


def verdict_counts(parsed: DataFrame) -> DataFrame:
    """Counts of true / false / maybe per (model, mode, prompt); total
    counts only rows with a non-empty verdict (F10)."""
    v = F.col("verdict")
    return parsed.groupBy("model", "mode", "prompt").agg(
        *[F.count_if(v == x).alias(f"n_{x}") for x in VERDICT_SET],
        F.count_if(v.isNotNull() & (v != "")).alias("n_total"))


def verdict_pct_table(parsed: DataFrame, modes: list[str]) -> DataFrame:
    """Per (model, prompt), the share (in %) of each verdict per mode, wide
    by mode: 0 when a mode has rows but no verdict, NULL when it has no rows."""
    v, m = F.col("verdict"), F.col("mode")
    aggs = []
    for mo in modes:
        aggs.append(F.count_if(m == mo).alias(f"rows_{mo}"))
        aggs.append(F.count_if((m == mo) & v.isNotNull() & (v != "")).alias(f"tot_{mo}"))
        aggs += [F.count_if((m == mo) & (v == x)).alias(f"n_{x}_{mo}") for x in VERDICT_SET]
    g = parsed.groupBy("model", "prompt").agg(*aggs)
    out = [F.col("model"), F.col("prompt")]
    for mo in modes:
        for x in VERDICT_SET:
            pct = (F.when(F.col(f"rows_{mo}") == 0, F.lit(None).cast("double"))
                   .when(F.col(f"tot_{mo}") == 0, F.lit(0.0))
                   .otherwise(100.0 * F.col(f"n_{x}_{mo}") / F.col(f"tot_{mo}")))
            out.append(_r(pct).alias(f"pct_{x}_{mo}"))
    return g.select(*out)


def label_share(parsed: DataFrame, column: str, valid: list[str]) -> DataFrame:
    """Share (%) of each label and of 'missing' per (mode, model, prompt)."""
    lab = normalise_label(F.col(column), valid)
    cats = valid + ["missing"]
    g = parsed.select(*GROUP, lab.alias("lab")).groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("lab") == c).alias(f"c_{c}") for c in cats])
    return g.select(*GROUP, "n", *[_r(100.0 * F.col(f"c_{c}") / F.col("n")).alias(f"pct_{c}")
                                   for c in cats])


def mean_sd(df: DataFrame, value: Column, keys: list[str] | None = None,
            population: bool = False) -> DataFrame:
    """Mean and standard deviation (sample by default) of a value per group;
    NULL values are skipped as pandas does."""
    keys = keys or GROUP
    sd = F.stddev_pop if population else F.stddev_samp
    return df.select(*keys, value.alias("x")).groupBy(*keys).agg(
        F.count("x").alias("n"), _r(F.avg("x")).alias("mean"), _r(sd("x")).alias("sd"))


def bullet_item_stats(parsed: DataFrame) -> DataFrame:
    """Per item: bullet count (missing -> 0) and mean words per non-blank
    bullet (0 when there is none) (E11, E12, M8)."""
    b = F.coalesce(F.col("bullets"), F.array().cast("array<string>"))
    # the word counts are read twice below: compute them in their own projection
    staged = parsed.select(*GROUP, F.size(b).alias("bullet_count"),
                           F.transform(F.filter(b, lambda x: strip_ws(x) != ""), word_count).alias("_w"))
    total = F.aggregate("_w", F.lit(0).cast("bigint"), lambda a, x: a + x)
    avg_len = F.when(F.size("_w") > 0, total / F.size("_w")).otherwise(F.lit(0.0))
    return staged.select(*GROUP, "bullet_count", avg_len.alias("avg_bullet_length"))


def match_rate(parsed_a: DataFrame, parsed_b: DataFrame) -> DataFrame:
    """J5 + E14: verdict agreement (%) between two runs, keyed on
    (model, mode, claim_id, prompt); NULL = NULL counts as a match. A
    (model, mode) pair whose runs differ in size is skipped, as in the
    reference's positional comparison.

    One full outer join reads each run once: the run sizes, the matched rows
    and the agreements are counted in the same aggregate; the size check
    per (model, mode) is a window over its (at most three) prompt rows."""
    keys = ["model", "mode", "claim_id", "prompt"]
    a = parsed_a.select(*keys, F.col("verdict").alias("va"), F.lit(True).alias("in_a"))
    b = parsed_b.select(*keys, F.col("verdict").alias("vb"), F.lit(True).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    g = a.join(b, keys, "full_outer").groupBy(*GROUP).agg(
        F.count("in_a").alias("na"), F.count("in_b").alias("nb"),
        F.count_if(both).alias("n"),
        F.count_if(both & F.col("va").eqNullSafe(F.col("vb"))).alias("agree"))
    w = Window.partitionBy("model", "mode")
    g = g.withColumn("na_all", F.sum("na").over(w)).withColumn("nb_all", F.sum("nb").over(w))
    return g.filter((F.col("na_all") == F.col("nb_all")) & (F.col("n") > 0)).select(
        *GROUP, "n", _r(100.0 * F.col("agree") / F.col("n")).alias("match_pct"))


def subset_semi(answers: DataFrame, keep_mode: str = "1refute", ref_mode: str = "mix") -> DataFrame:
    """Rows of ``keep_mode`` whose claim is also answered in ``ref_mode``
    by the same model (a left-semi join: no duplicates, no right columns)."""
    keep = answers.filter(F.col("mode") == keep_mode)
    ref = answers.filter(F.col("mode") == ref_mode).select("model", "claim_id")
    return keep.join(ref, ["model", "claim_id"], "left_semi")


def sample_sizes(parsed: DataFrame) -> DataFrame:
    """Per mode the row count, the reference's rows / 9 and the
    exact number of distinct claims."""
    return parsed.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.floor(F.count(F.lit(1)) / 9).cast("bigint").alias("n_items_compat"),
        F.count_distinct("claim_id").alias("n_claims"))


def fk_item_stats(parsed: DataFrame) -> DataFrame:
    """E13 input: per item the mean grade of its bullets (NULL grades and items
    without bullets are skipped)."""
    from evidentia.functions.text import bullets_fk
    fk = bullets_fk(F.coalesce(F.col("bullets"), F.array().cast("array<string>")))
    # the grades are read three times below: compute them in their own projection
    staged = parsed.select(*GROUP, F.filter(F.transform(fk, lambda s: s["fk_grade"]),
                                            lambda g: g.isNotNull()).alias("_g"))
    total = F.aggregate("_g", F.lit(0.0), lambda a, g: a + g)
    return staged.select(*GROUP, F.when(F.size("_g") > 0, total / F.size("_g")).alias("fk_grade"))
