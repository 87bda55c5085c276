"""Label statistics: counts, class weights, image weights, range checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(labels: DataFrame, classes: int, cls: str = "cls") -> DataFrame:
    """A row for each class 0 to classes - 1: count and weight.

    Inverse counts, scaled to sum 1; a class without labels counts as 1
    (definition ours). Numbers of classes are small, so the table of all of
    them is a literal range and the sum a scalar over one row a class.
    """
    counts = labels.groupBy(F.col(cls).cast("int").alias("__c")).agg(F.count(F.lit(1)).alias("count"))
    every = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    x = every.join(counts, F.col("cls") == F.col("__c"), "left").select("cls", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    inverse = (F.lit(1.0) / F.greatest(F.col("count"), F.lit(1))).cast("decimal(30,18)")
    from pyspark.sql import Window

    total = F.sum(inverse).over(Window.partitionBy(F.lit(0)))
    return x.select("cls", "count", (inverse.cast("double") / total.cast("double")).alias("weight"))


def image_weights(labels: DataFrame, weights: DataFrame, image: str, cls: str) -> DataFrame:
    """Sum of the class weights of each image's labels (exact decimals inside, so the order of rows is immaterial)."""
    w = weights.select(F.col("cls").alias("__c"), F.col("weight").cast("decimal(28,15)").alias("__w"))
    x = labels.groupBy(image, cls).agg(F.count(F.lit(1)).alias("n")).join(w, F.col(cls) == F.col("__c"))
    return x.groupBy(image).agg(F.sum(F.col("n").cast("decimal(10,0)") * F.col("__w")).cast("double").alias("weight"), F.sum("n").alias("labels"))


def label_range(labels: DataFrame, classes: int, cls: str = "cls") -> DataFrame:
    """One row: the largest label, the number of labels, and whether all lie below ``classes``."""
    return labels.agg(F.max(cls).cast("long").alias("largest"), F.count(F.lit(1)).alias("labels"), (F.coalesce(F.max(cls), F.lit(-1)) < classes).alias("ok"))


def require_range(labels: DataFrame, classes: int, cls: str = "cls") -> DataFrame:
    """The same rows; reading one whose label is not below ``classes`` raises."""
    bad = F.concat(F.lit("label out of range: "), F.col(cls).cast("string"))
    return labels.withColumn(cls, F.when(F.col(cls) < classes, F.col(cls)).otherwise(F.raise_error(bad).cast(labels.schema[cls].dataType)))


def concatenated(df: DataFrame, array: str, keys: list[str]) -> DataFrame:
    """Elements of array rows as rows: keys, pos, value."""
    return df.select(*keys, F.posexplode(array).alias("pos", "value"))
