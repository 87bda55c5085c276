"""Scores of predictions: fitness, precision, recall, average precision (definitions ours, from the common scheme)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbox.operators.ranges import RANGES, range_of, running_in_ranges

#: Weights of precision, recall, mAP at 0.5 and mAP over 0.5 to 0.95.
FITNESS = (0.0, 0.0, 0.1, 0.9)


def fitness(precision: Column, recall: Column, map50: Column, map95: Column, weights=FITNESS) -> Column:
    return sum((F.lit(w) * c for w, c in zip(weights[1:], (recall, map50, map95), strict=True)), F.lit(weights[0]) * precision)


def precision_recall(df: DataFrame, keys: list[str], predicted: Column, truth: Column) -> DataFrame:
    """Counts and rates of yes/no predictions by group; a rate without cases is 0."""
    count = lambda c: F.sum(c.cast("long"))
    x = df.groupBy(*keys).agg(count(predicted & truth).alias("tp"), count(predicted & ~truth).alias("fp"), count(~predicted & truth).alias("fn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    return x.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})


def average_precision(df: DataFrame, cls: list[str], conf: str, ident: str, hit: str, truths: DataFrame) -> DataFrame:
    """Area under the precision envelope of each class: cls, predictions, truths, ap.

    ``hit`` says whether a prediction found a truth, ``truths`` has ``truths``
    for each class. Precision at a rank is raised to the best at any later rank.
    Ranks are taken over ranges of confidence, so a class of any size is split.
    """
    block = F.lit(RANGES) - range_of(df, conf)
    x = running_in_ranges(df, cls, block, [F.desc(conf), F.asc(ident)], {"__tp": F.col(hit).cast("long"), "__n": F.lit(1).cast("long")})
    x = x.withColumn("__p", F.col("__tp") / F.col("__n"))
    best = x.groupBy(*cls, "__block").agg(F.max("__p").alias("__best"))
    after = Window.partitionBy(*cls).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.select(*cls, "__block", F.max("__best").over(after).alias("__after"))
    later = Window.partitionBy(*cls, "__block").orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__e", F.max("__p").over(later)).join(best, [*cls, "__block"])
    envelope = F.greatest("__e", "__after").cast("decimal(28,18)")
    # recall only grows at hits, each by 1 / truths
    area = x.groupBy(*cls).agg(F.count(F.lit(1)).alias("predictions"), F.sum(F.when(F.col(hit), envelope).otherwise(F.lit(0).cast("decimal(28,18)"))).alias("__a"))
    return area.join(truths, cls).select(*cls, "predictions", "truths", F.round(F.col("__a").cast("double") / F.col("truths"), 9).alias("ap"))


#: Overlaps at which predictions are scored.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def average_precisions(matched: DataFrame, cls: str, conf: str, ident: str, truths: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Average precision of each class at each overlap: cls, least, predictions, truths, ap.

    ``matched`` has each prediction with the overlap ``iou`` of the truth that it
    found at the lowest threshold, or null. A truth's best prediction is the same
    at every threshold that it reaches, so one match serves all.
    """
    x = matched.withColumn("least", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    x = x.withColumn("hit", F.coalesce(F.col("iou") >= F.col("least"), F.lit(False)))
    per = truths.withColumn("least", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return average_precision(x, [cls, "least"], conf, ident, "hit", per)


def validation(ap: DataFrame, lowest: float = THRESHOLDS[0]) -> DataFrame:
    """One row: map50, the mean over classes at the lowest overlap, and map, the mean over all overlaps too."""
    mean = lambda c: F.round(F.sum(c.cast("decimal(28,12)")).cast("double") / F.count(c), 9)
    return ap.agg(mean(F.when(F.col("least") == lowest, F.col("ap"))).alias("map50"), mean(F.col("ap")).alias("map"), F.count_distinct("cls").alias("classes"))


def mean_ap(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("classes"))
