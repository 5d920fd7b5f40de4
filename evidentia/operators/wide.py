"""Wide export of evidence lists of any length (G4, G5, S5) and its way back.

The export has a column per piece of evidence. Here the columns are cut into files of
``WIDTH`` columns with shared keys: folder ``stance=.../slice=k`` holds the pieces
k * WIDTH + 1 to (k + 1) * WIDTH of the claims that have so many. So neither a plan
nor a row grows with the longest list: a claim with thousands of pieces of evidence
has several rows, each of ``WIDTH`` cells, gathered on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.claims import CLAIM_KEYS, relevant_only, supports_or_refutes
from evidentia.sources.io import null_tokens, write_tsv

WIDTH = 256


def slices(evidence: DataFrame, width: int = WIDTH) -> DataFrame:
    """claim keys, stance, slice, texts: the evidence of each claim and stance in file
    order, ``width`` pieces a row (the last row of a list has fewer). The order is a
    running number, which needs no list."""
    ev = supports_or_refutes(relevant_only(evidence)).filter(F.col("claim_id").isNotNull() & F.col("claim").isNotNull())
    place = F.row_number().over(Window.partitionBy(*CLAIM_KEYS, "evidence_stance").orderBy("row_ord")) - 1
    ev = ev.select(*CLAIM_KEYS, F.col("evidence_stance").alias("stance"), F.col("evidence").alias("e"), place.alias("at"))
    piece = F.struct("at", "e")                     # a struct: null texts keep their place
    rows = ev.groupBy(*CLAIM_KEYS, "stance", F.floor(F.col("at") / width).cast("int").alias("slice")).agg(
        F.array_sort(F.collect_list(piece)).alias("p"))
    return rows.select(*CLAIM_KEYS, "stance", "slice", F.transform("p", lambda x: x["e"]).alias("texts"))


def widths(rows: DataFrame) -> DataFrame:
    """stance, width: the longest list of each stance, from the slices alone."""
    per = rows.groupBy(*CLAIM_KEYS, "stance").agg(F.sum(F.size("texts")).alias("n"))
    return per.groupBy("stance").agg(F.max("n").alias("width"))


def write_wide(rows: DataFrame, path: str, width: int = WIDTH) -> None:
    """The slices as TSV files with a header, a column per place."""
    cells = [F.get("texts", F.lit(i)).alias(f"evidence_{i + 1}") for i in range(width)]
    write_tsv(rows.select(*CLAIM_KEYS, *cells, "stance", "slice"), path, ["stance", "slice"])


def read_wide(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """claim keys, stance, place (from 1), evidence: the exported cells that are not empty."""
    names = [*CLAIM_KEYS, *[f"evidence_{i + 1}" for i in range(width)]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("stance", T.StringType()),
                                                                            T.StructField("slice", T.IntegerType())])
    raw = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option(
        "escape", '"').schema(schema).csv(path)
    cells = F.array(*[F.col(n) for n in names[len(CLAIM_KEYS):]])
    keys = [null_tokens(F.col(c)).alias(c) for c in CLAIM_KEYS]
    long = raw.select(*keys, "stance", "slice", F.posexplode(cells).alias("i", "evidence"))
    return long.filter(F.col("evidence").isNotNull() & (F.col("evidence") != "")).select(
        *CLAIM_KEYS, "stance", (F.col("slice") * width + F.col("i") + 1).cast("long").alias("place"), "evidence")
