"""Exact quantiles without gathering a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in the
final aggregation buffer. Here each needed rank is narrowed down by counting:
a value range is cut into ``buckets`` equal-width buckets, the values are
counted per bucket (partial + final aggregate), and a running count over the
at most ``buckets`` rows of a range finds the bucket that holds the rank. The
smallest and largest value of that bucket are the next range, until they are
equal or the range holds at most ``small`` values, which are then ranked
directly. So outliers only cost one more step: whatever they do to the first
buckets, the next range starts from the values that are there.

The state has one row per group and needed rank. It is staged after each step,
so its size is known and the values are joined with it by broadcast as long
as it is small; the values themselves are never shuffled, only their counts.

The result is the exact order statistic, with linear interpolation between
ranks floor(h) and floor(h) + 1, h = p * (n - 1) (numpy's default).
The input is read once per step: pass a materialised or cheap DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import stage_table


def exact_quantiles(df: DataFrame, value: str, group: list[str], probs: list[float],
                    buckets: int = 1 << 12, small: int = 1 << 16) -> DataFrame:
    """One row per group with a column ``q_{i}`` per probability ``probs[i]``."""
    base = df.select(*group, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    rng = base.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    # the ranks each probability needs: floor(h) and the next one
    h = F.col("p") * (F.col("n") - 1)
    state = rng.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p")).select(
        *group, "i", (h - F.floor(h)).alias("frac"), "lo", "hi", "n", F.lit(0).cast("long").alias("before"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("side"), F.floor(h).cast("long").alias("r")),
            F.struct(F.lit(1).alias("side"), F.least(F.floor(h) + 1, F.col("n") - 1).cast("long").alias("r")))))
    state = stage_table(state, "quantile-ranks")
    keys = [*group, "lo", "hi"]

    def narrowed(todo: DataFrame, cut) -> DataFrame:
        """The ranks of ``todo`` with the range and count of the part (by ``cut``) that holds them."""
        inside = base.join(todo.select(*keys).distinct(), group).filter(
            (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        per = inside.groupBy(*keys, cut.alias("b")).agg(
            F.count(F.lit(1)).alias("nb"), F.min("v").alias("bmin"), F.max("v").alias("bmax"))
        upto = F.sum("nb").over(Window.partitionBy(*keys).orderBy("b"))
        per = per.select(*keys, "bmin", "bmax", "nb", (upto - F.col("nb")).alias("under"))
        rest = F.col("r") - F.col("before") - F.col("under")
        return todo.join(per, keys).filter((rest >= 0) & (rest < F.col("nb"))).select(
            *group, "i", "frac", F.col("bmin").alias("lo"), F.col("bmax").alias("hi"), F.col("nb").alias("n"),
            (F.col("before") + F.col("under")).alias("before"), "side", "r")

    # lo and hi are values, so they fall into different buckets and every range shrinks
    part = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    bucket = F.least(F.floor(part * max(buckets, 2)), F.lit(max(buckets, 2) - 1))
    big = (F.col("lo") < F.col("hi")) & (F.col("n") > small)
    while not state.filter(big).isEmpty():
        state = stage_table(state.filter(~big).unionByName(narrowed(state.filter(big), bucket)), "quantile-ranks")
    state = state.filter("lo = hi").unionByName(narrowed(state.filter("lo < hi"), F.col("v")))
    at = lambda i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("lo")))
    frac = lambda i: F.max(F.when(F.col("i") == i, F.col("frac")))
    return state.groupBy(*group).agg(*[
        (at(i, 0) + frac(i) * (at(i, 1) - at(i, 0))).alias(f"q_{i}") for i in range(len(probs))])
