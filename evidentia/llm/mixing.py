"""Mixing sources to target weights, natively in Spark.

Each source gets a target number of words; a document is taken whole, up to
``max_repeat`` times. Its hash decides: every document of a source is taken
``floor(target / source_size)`` times, and once more if its hash lies under the
source's threshold. The budgets are nested: a larger target only adds takes.

The thresholds come from hash histograms, not from sorting. Words are summed by
source and hash bucket (4,096 buckets), a running sum per source finds the
bucket in which the budget ends, and only that bucket is split again by the
next 12 bits of the hash, twice. What is left is one bucket of a 36-bit hash
(one document, unless ids repeat), taken or left, whichever is nearer.

A source's rows never meet in one task: the sums are combined before the
shuffle, and the running sums have at most 4,096 rows per source and step. The
targets need one row per source in one window.

Defined results: a null text has size 0; the null source is a source of its
own, last in order; null ids hash like one id, and rows with equal ids are
taken alike, so a budget that ends inside such a group misses by at most half
the group; a source without words has target 0; an empty table gives an empty
result. Columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.common import WORD_SQL, stage

BITS, LEVELS = 12, 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """36 bits of the id's MD5, as a number."""
    h = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4)
    return F.conv(h, 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """source, source_size, target: the weights' shares of all words, no target
    above ``max_repeat`` times its source. Resharing the excess by weight until
    none is above equals one level L with target = min(cap, L * weight): sources
    fill up in the order of cap / weight."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    place = F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                (F.pmod(place, F.lit(n)) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    # the level if all earlier sources are full and this one and the later ones are not
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
             ) / F.sum("weight").over(after)
    src = src.withColumn("level", level)
    src = src.withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    src = src.withColumn("fit", F.first("level", ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least("cap", F.col("fit") * F.col("weight")), F.lit(0.0))
    return src.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, repeats, cut: documents with hash < cut are
    taken once more than ``repeats``."""
    size = F.col("source_size")
    repeats = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = targets.withColumn("repeats", repeats).withColumn(
        "budget", F.col("target") - F.col("repeats") * size).withColumn("prefix", F.lit(0).cast("long"))
    for step in range(LEVELS):
        shift = BITS * (LEVELS - 1 - step)
        rows = sized.withColumn("slot", F.shiftright("hash", shift))
        if step:  # only the boundary bucket of each source goes on
            edge = state.select(F.col("source").alias("s_source"), "prefix")
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s_source"))
                             & (F.shiftright("hash", shift + BITS) == F.col("prefix"))).drop("s_source", "prefix")
        hist = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("slot"))
        hist = hist.select(F.col("source").alias("h_source"), "slot", "words", upto.alias("upto"))
        # words in the buckets that fit whole, and the bucket after them
        found = hist.join(state, F.col("h_source").eqNullSafe(F.col("source"))).groupBy("h_source").agg(
            F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("inside"),
            F.min(F.when(F.col("upto") > F.col("budget"), F.struct("slot", "words"))).alias("edge"))
        state = stage(state.join(found, F.col("h_source").eqNullSafe(F.col("source")), "left").select(
            "source", "source_size", "target", "repeats",
            (F.col("budget") - F.coalesce("inside", F.lit(0))).alias("budget"),
            # only a source without words has no such bucket
            F.coalesce(F.col("edge.slot"), F.lit(0)).alias("prefix"), F.col("edge.words").alias("edge_words")), "cut")
    # the last bucket is taken if that lands nearer to the budget
    nearer = F.coalesce(F.col("edge_words") < 2 * F.col("budget"), F.lit(False))
    return state.select("source", "source_size", "target", "repeats",
                        (F.col("prefix") + nearer.cast("long")).alias("cut"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        n_words(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash"))
    sized = stage(sized, "sizes")  # four passes follow; the texts are read once
    targets = stage(source_targets(sized, weights, max_repeat), "targets")
    cuts = thresholds(sized, targets).withColumnRenamed("source", "c_source")
    takes = F.least(F.col("repeats") + (F.col("hash") < F.col("cut")).cast("long"), F.lit(max_repeat))
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("c_source"))).select(
        "doc_id", "size", "source_size", "target", (takes * F.col("size")).alias("taken"))
