"""Top-k by value, tournaments, set operations on keys, ordered unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbox.functions.expr import hash_uniform


def elite(df: DataFrame, fitness: str, k: int) -> DataFrame:
    """Every row whose value is among the k best, so ties at the k-th all stay. NaN and null never do.

    The k-th value comes from a top-k, which keeps k rows in each task; the rest
    is a comparison that reaches the scan.
    """
    valid = df.where(F.col(fitness).isNotNull() & ~F.isnan(F.col(fitness).cast("double")))
    top = valid.select(fitness).orderBy(F.desc(fitness)).limit(k).agg(F.min(fitness)).first()[0]
    return valid.limit(0) if top is None else valid.where(F.col(fitness) >= F.lit(top))


def tournaments(df: DataFrame, key: str, fitness: str, count: int, size: int, seed: int = 0) -> DataFrame:
    """Winners of ``count`` tournaments of ``size`` rows drawn by hash: t, key, fitness; the first drawn wins a tie."""
    x = df.select(key, fitness).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    x = x.withColumn("__u", hash_uniform(F.lit(seed), F.col("t"), F.col(key)))
    # rank in two steps: a bounded list for each task and tournament would do as well; Spark prunes rank limits before the shuffle
    drawn = x.withColumn("__place", F.row_number().over(Window.partitionBy("t").orderBy("__u", key))).where(F.col("__place") <= size)
    won = drawn.withColumn("__rank", F.row_number().over(Window.partitionBy("t").orderBy(F.desc(fitness), "__place"))).where("__rank = 1")
    return won.select("t", key, fitness)


def first_best(df: DataFrame, value: str, order: str) -> DataFrame:
    """The row of greatest value, the first of equals: one row."""
    return df.where(~F.isnan(F.col(value).cast("double"))).orderBy(F.desc(value), F.asc(order)).limit(1)


def shared_keys(a: DataFrame, b: DataFrame, key: str, exclude: list[str] | None = None) -> DataFrame:
    """Rows of a whose key also is in b and holds none of the excluded parts."""
    out = a.join(b.select(key).distinct(), key, "left_semi")
    for part in exclude or []:
        out = out.where(~F.contains(F.col(key).cast("string"), F.lit(part)))
    return out


def other_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def ordered_union(parts: list[tuple[DataFrame, bool]], order: str) -> DataFrame:
    """Rows of all parts, duplicates kept, with ``part`` and a sort value: a part marked True comes in reverse."""
    out = None
    for i, (df, backwards) in enumerate(parts):
        x = df.withColumns({"part": F.lit(i), "place": -F.col(order) if backwards else F.col(order)})
        out = x if out is None else out.unionByName(x)
    return out
