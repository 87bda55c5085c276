"""Orders and running sums inside groups, of which one may hold most of the rows.

A group is cut into ranges of its order's first column by quantiles of the whole
table, a bounded number of cut points. Ranges are summed (combined before the
shuffle), the ranges before are added, and rows are ranked and summed inside
their range only, so no task sees a whole group. Equal values lie in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def range_of(df: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """The number of the range of quantiles that a value is in, from 0; nulls are in the first."""
    cuts = sorted(set(df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))), F.lit(0))


def running_in_ranges(df: DataFrame, keys: list[str], block: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (this row included) over each group's order; ``block`` must rise with that order."""
    x = df.withColumn("__block", block).withColumns({f"__v_{k}": c for k, c in sums.items()})
    # with no keys all rows are one group, whose window sees a row for each range
    blocks = x.groupBy(*keys, "__block").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__block").alias("__b"),
                           *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"__c_{k}": F.sum(f"__v_{k}").over(inside) for k in sums})
    same = F.col("__block") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return x.join(blocks, same).select(*df.columns, "__block", *[(F.col(f"__before_{k}") + F.col(f"__c_{k}")).alias(k) for k in sums])
