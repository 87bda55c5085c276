"""Reproducible sampling: every draw is a hash of keys, so it does not depend on partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbox.functions.expr import hash_uniform


#: Blocks of keys, at most: the rows that the one window over all blocks sees.
BLOCKS = 4096


def prefix_sums(df: DataFrame, key: str, value: str, out: str, blocks: int = BLOCKS) -> DataFrame:
    """Running sum of whole numbers by a key, without a task that sees all rows.

    Keys are cut into ``blocks`` parts of equal width between the least and the
    greatest; parts are summed (partial sums before the shuffle), the parts
    before are added, and rows are summed inside their part. However far apart
    keys are, the window over parts sees at most ``blocks`` rows.
    """
    least, most = df.agg(F.min(key), F.max(key)).first()
    if least is None:
        return df.withColumn(out, F.lit(None).cast("long"))
    x = df.withColumn("__block", F.floor((F.col(key) - F.lit(least)) / max(1, -(-(most - least + 1) // blocks))))
    sums = x.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("__block").alias("__b"), before.alias("__before"))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__inside", F.sum(value).over(inside)).join(sums, F.col("__block") == F.col("__b"))
    return x.withColumn(out, F.col("__before") + F.col("__inside")).drop("__block", "__b", "__before", "__inside")


def weighted_sample(df: DataFrame, key: str, weight: str, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` draws with replacement, in proportion to whole-number weights: draw, and the key drawn.

    Draws and the intervals of running weights meet in buckets of equal width,
    an equi-join; an interval that spans several buckets goes to each.
    """
    sums = prefix_sums(df.where(F.col(weight) > 0).select(key, weight), key, weight, "__to")
    total = df.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return df.sparkSession.createDataFrame([], f"draw bigint, {key} {dict(df.dtypes)[key]}")
    step = max(1, total // max(1, draws))
    sums = sums.withColumn("__from", F.col("__to") - F.col(weight))
    spans = sums.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__from") / step), F.floor((F.col("__to") - 1) / step))))
    d = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(hash_uniform(F.lit(seed), F.col("id")) * total).cast("long").alias("__at"))
    d = d.withColumn("__b", F.floor(F.col("__at") / step))
    return d.join(spans, (F.col("__b") == F.col("__bucket")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))).select("draw", key)


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: the least hashes."""
    return df.orderBy(hash_uniform(F.lit(seed), F.col(key)), key).limit(n)


def shuffled(df: DataFrame, key: str, epoch: int, out: str = "place") -> DataFrame:
    """A sort value for each row that differs from epoch to epoch; sorting by (place, key) shuffles."""
    return df.withColumn(out, hash_uniform(F.lit(epoch), F.col(key)))


def between(u: Column, lo, hi) -> Column:
    """A uniform number scaled to [lo, hi]."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return lo + u * (hi - lo)


def random_sizes(key: Column, size: int, stride: int, seed: int = 0) -> Column:
    """Image sizes from half to one and a half times ``size``, in whole strides."""
    lo, hi = int(size * 0.5), int(size * 1.5) + stride
    return (F.floor((F.floor(hash_uniform(F.lit(seed), key) * (hi - lo)) + lo) / stride) * stride).cast("long")
