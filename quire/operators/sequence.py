"""Sequence operators: what list walks become over ordered rows.

All take ``by`` (the columns of one sequence, as doc_id) and ``order`` (what orders it; must be a total order). Chained
on the same ``by`` and ``order`` they share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def window(by: list[str], order: list) -> "W":
    return W.partitionBy(*by).orderBy(*order)


def before(by: list[str], order: list) -> "W":
    """All rows before the present one."""
    return window(by, order).rowsBetween(W.unboundedPreceding, -1)


def until(by: list[str], order: list) -> "W":
    return window(by, order).rowsBetween(W.unboundedPreceding, 0)


def renumber(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """``name``: place in the sequence, from 0."""
    return df.withColumn(name, (F.row_number().over(window(by, order)) - 1).cast("int"))


def islands(df: DataFrame, by: list[str], order: list, start: Column, name: str) -> DataFrame:
    """``name``: number of the island, from 1, where ``start`` is true of each island's first row."""
    return df.withColumn("_start", F.coalesce(start, F.lit(False)).cast("long")).withColumn(name, F.sum("_start").over(until(by, order))).drop("_start")


def runs_of_equal(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """``name``: number of the maximal run of equal values."""
    prev = F.lag(value).over(window(by, order))
    first = F.lag(F.lit(1)).over(window(by, order)).isNull()
    return islands(df.withColumn("_new", first | ~F.col(value).eqNullSafe(prev)), by, order, F.col("_new"), name).drop("_new")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(window(keys, order))).where("_rank = 1").drop("_rank")


def carry_forward(df: DataFrame, by: list[str], order: list, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``name``: the last ``value`` that was not null."""
    w = until(by, order) if inclusive else before(by, order)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def collapse_repeats(df: DataFrame, by: list[str], order: list, value: Column, applies: Column | None = None) -> DataFrame:
    """Rows without those equal to the row before. Equality is transitive, so the row before stands for the last kept."""
    df = df.withColumn("_v", value)
    same = F.coalesce(F.col("_v") == F.lag("_v").over(window(by, order)), F.lit(False))
    same = same if applies is None else same & applies
    return df.withColumn("_same", same).where(~F.col("_same")).drop("_v", "_same")


def stable_partition(df: DataFrame, by: list[str], first: Column, order: list, name: str) -> DataFrame:
    """``name``: new places in which rows of ``first`` come before the others, each in their old order."""
    return df.withColumn("_first", (~F.coalesce(first, F.lit(False))).cast("int")).withColumn(name, (F.row_number().over(window(by, ["_first", *order])) - 1).cast("int")).drop("_first")


def running_before(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """``name``: sum of ``value`` over the rows before."""
    return df.withColumn(name, F.coalesce(F.sum(value).over(before(by, order)), F.lit(0)))


def gap_sessions(df: DataFrame, by: list[str], order: list, at: Column, gap: Column | float, name: str) -> DataFrame:
    """``name``: number of the session; a step of more than ``gap`` begins the next."""
    df = df.withColumn("_at", at)
    step = F.col("_at") - F.lag("_at").over(window(by, order))
    return islands(df.withColumn("_step", step), by, order, F.col("_step").isNull() | (F.col("_step") > gap), name).drop("_at", "_step")


def delete_ranges(df: DataFrame, by: list[str], order: str, end: Column) -> DataFrame:
    """Rows without those in [place, end) of any row whose ``end`` is not null. ``order`` is a place."""
    df = df.withColumn("_end", end)
    return df.withColumn("_reach", F.max("_end").over(until(by, [order]))).where(F.col("_reach").isNull() | (F.col("_reach") <= F.col(order))).drop("_end", "_reach")


def nearest_value(df: DataFrame, keys: list[str], at: str, candidate: Column, ident: Column) -> Column:
    """struct(d, id) of the row nearest to each by ``at`` among those where ``candidate``; of equal distances the least id.

    Two running windows, one a direction, so no pairs are made; null if there is no candidate.
    """
    gap = lambda c: F.abs(F.col(at) - c["at"])
    back = F.max(F.when(candidate, F.struct(F.col(at).alias("at"), (-ident).alias("id")))).over(W.partitionBy(*keys).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.max(F.when(candidate, F.struct((-F.col(at)).alias("at"), (-ident).alias("id")))).over(W.partitionBy(*keys).orderBy(F.desc(at)).rangeBetween(W.unboundedPreceding, W.currentRow))
    one = F.when(back.isNotNull(), F.struct(gap(back).alias("d"), (-back["id"]).alias("id")))
    two = F.when(ahead.isNotNull(), F.struct(F.abs(F.col(at) + ahead["at"]).alias("d"), (-ahead["id"]).alias("id")))
    return F.least(one, two)
