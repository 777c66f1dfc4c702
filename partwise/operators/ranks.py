"""Exact running totals, ranks and order statistics in many tasks: no task holds a group.

Rows are dealt by ranges of (group, value), written once so that the ranges stay as they are, and counted per range; what
stands before a row is the total of the ranges before its own and of the rows before it in its range.  Equal values are
counted first, so a value that fills a third of a group is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise


def joined_back(df: DataFrame, found: DataFrame, keys, columns, how: str = "left") -> DataFrame:
    """``df`` with ``columns`` of ``found`` by equal ``keys``; null keys are equal."""
    told = found.select(*[F.col(k).alias(f"key_{i}_") for i, k in enumerate(keys)], *columns)
    on = reduce(lambda x, y: x & y, [df[k].eqNullSafe(told[f"key_{i}_"]) for i, k in enumerate(keys)])
    return df.join(told, on, how).drop(*[f"key_{i}_" for i in range(len(keys))])


def running_totals(df: DataFrame, by, order, amounts) -> DataFrame:
    """``df`` with ``below_<a>`` for every amount: its total over the rows of the same group that stand before the row.

    Rows must differ in ``(*by, *order)``; ``order`` holds columns or sort orders.  Nulls form a group of their own.
    """
    ranged = materialise(df.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range_", *by).agg(*[F.sum(a).alias(f"all_{a}") for a in amounts])
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range_", *by, *[F.coalesce(F.sum(f"all_{a}").over(before), F.lit(0)).alias(f"from_{a}") for a in amounts])
    inside = Window.partitionBy("range_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = joined_back(ranged, offsets, ["range_", *by], [f"from_{a}" for a in amounts], "inner")
    return rows.select(*df.columns, *[(F.col(f"from_{a}") + F.coalesce(F.sum(a).over(inside), F.lit(0))).alias(f"below_{a}") for a in amounts])


def running_least(df: DataFrame, by, order, column: str) -> DataFrame:
    """``df`` with ``least_<column>``: the least value of the rows of the same group up to the row; rows as in ``running_totals``."""
    ranged = materialise(df.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range_", *by).agg(F.min(column).alias("least_")).withColumn("from_", F.min("least_").over(before))
    inside = Window.partitionBy("range_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = joined_back(ranged, offsets, ["range_", *by], ["from_"], "inner")
    return rows.select(*df.columns, F.least(F.min(column).over(inside), "from_").alias(f"least_{column}"))


def value_counts(df: DataFrame, column: str, by, **sums: Column) -> DataFrame:
    """``by, column, n, below_n`` and the sums of each distinct value of a group."""
    counted = df.groupBy(*by, column).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return running_totals(counted, by, [column], ["n"])


def quantiles(df: DataFrame, column: str, by, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of every group, between neighbours by their distance: ``by`` and one column a share; nulls are left out."""
    told = value_counts(df.where(F.col(column).isNotNull()), column, by)
    size = joined_back(told, told.groupBy(*by).agg(F.max(F.col("below_n") + F.col("n")).alias("size_")), by, ["size_"], "inner") if by else told.withColumn("size_", F.lit(told.agg(F.sum("n")).first()[0] or 0))
    last = lambda k: F.max(F.when((F.col("below_n") <= k) & (k < F.col("below_n") + F.col("n")), F.col(column)))
    place = {name: F.lit(share) * (F.col("size_") - 1) for name, share in shares.items()}
    ends = size.groupBy(*by).agg(F.max("size_").alias("size_"), *[last(f(p)).alias(f"{side}_{name}") for name, p in place.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    return ends.select(*by, *[(F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * (p - F.floor(p))).alias(name) for name, p in place.items()])
