"""Lists without ids, aligned by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import stage_table


def aligned(a: DataFrame, b: DataFrame, group: list[str], pos: str = "pos") -> DataFrame:
    """Rows of ``a`` and ``b`` that stand at the same place of the same group, as
    structs ``a`` and ``b``. A group whose two lists differ in length is left out,
    since there a place does not tell which rows belong together."""
    sizes = a.groupBy(*group).agg(F.count(F.lit(1)).alias("_na")).join(
        b.groupBy(*group).agg(F.count(F.lit(1)).alias("_nb")), group).filter("_na = _nb").select(*group)
    sizes = stage_table(sizes, "equal-lists")
    left = a.select(*group, pos, F.struct(*[c for c in a.columns if c not in (*group, pos)]).alias("a")).join(sizes, group, "left_semi")
    right = b.select(*group, pos, F.struct(*[c for c in b.columns if c not in (*group, pos)]).alias("b"))
    return left.join(right, [*group, pos])


def unequal(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """The groups that ``aligned`` leaves out, with both lengths."""
    n = lambda df, name: df.groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    both = n(a, "n_a").join(n(b, "n_b"), group, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.filter("n_a <> n_b")
