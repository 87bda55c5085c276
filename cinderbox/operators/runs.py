"""Training runs as metric tables: running means, best so far, early stopping, step triggers, checkpoints.

Windows are partitioned by run, so runs are handled side by side; sums are taken
over decimals, which keeps them exact whatever the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbox.functions.expr import warmup_accumulate
from cinderbox.operators.ranges import range_of, running_in_ranges


def _upto(run: list[str], order: list) -> Window:
    return Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_mean(df: DataFrame, run: list[str], order: list, value: str, out: str = "mean") -> DataFrame:
    w = _upto(run, order)
    return df.withColumn(out, F.sum(F.col(value).cast("decimal(28,6)")).over(w).cast("double") / F.count(value).over(w))


def best_so_far(df: DataFrame, run: list[str], order: list, value: str, start: float = 0.0) -> DataFrame:
    """Adds ``best`` (running maximum from ``start``) and ``improved`` (strictly above all before). NaN counts as null."""
    v = F.when(~F.isnan(value), F.col(value))
    before = F.max(v).over(Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    best = F.greatest(F.max(v).over(_upto(run, order)), F.lit(start))
    return df.withColumns({"best": best, "improved": F.coalesce(v > F.greatest(F.coalesce(before, F.lit(start)), F.lit(start)), F.lit(False))})


def best_row(df: DataFrame, run: list[str], value: str, order: str, also: list[str]) -> DataFrame:
    """The row of greatest value of each run, the latest of equals. NaN never wins."""
    s = F.max(F.struct(F.col(value), F.col(order), *[F.col(c) for c in also])).alias("b")
    return df.where(~F.isnan(value)).groupBy(*run).agg(s).select(*run, "b.*")


def early_stop(df: DataFrame, run: list[str], order: list, value: str, patience: int) -> DataFrame:
    """One row a run: last_best (epoch of the best value seen, an equal one counts) at the stop, stop (first epoch at least ``patience`` after it, or null)."""
    x = df.withColumn("epoch", (F.row_number().over(Window.partitionBy(*run).orderBy(*order)) - 1).cast("long"))
    w = _upto(run, [F.col("epoch")])
    x = x.withColumn("__best", F.greatest(F.max(value).over(w), F.lit(0.0)))
    x = x.withColumn("last_best", F.coalesce(F.max(F.when(F.col(value) >= F.col("__best"), F.col("epoch"))).over(w), F.lit(0).cast("long")))
    late = F.when(F.col("epoch") - F.col("last_best") >= patience, F.struct("epoch", "last_best"))
    return x.groupBy(*run).agg(F.min(late).alias("s"), F.count(F.lit(1)).alias("epochs")).select(*run, "epochs", F.col("s.epoch").alias("stop"), F.col("s.last_best").alias("last_best"))


def ordinal(df: DataFrame, run: list[str], order: list, out: str = "ni") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*run).orderBy(*order)) - 1)


def ordinal_in_ranges(df: DataFrame, run: list[str], first: str, then: list[str], out: str = "ni") -> DataFrame:
    """The same for few runs of many rows: ordered by ``first``, and rows of equal value by the others, in ranges of it."""
    x = df.withColumn("__first", F.unix_micros(F.col(first).cast("timestamp")) if dict(df.dtypes)[first].startswith("timestamp") else F.col(first))
    x = running_in_ranges(x, run, range_of(x, "__first"), [F.col(c).asc() for c in (first, *then)], {"__n": F.lit(1).cast("long")})
    return x.withColumn(out, F.col("__n") - 1).drop("__n", "__block", "__first")


def global_step(batch: Column, epoch: Column, batches: Column | int) -> Column:
    return batch + (batches if isinstance(batches, Column) else F.lit(batches)) * epoch


def step_trigger(counts: DataFrame, run: list[str], steps: str, warmup: int, batch_size: int, nominal: int = 64) -> DataFrame:
    """For each run of ``steps`` batches: how often the optimizer fires, and at which batch last.

    It fires when at least the batch's accumulation has passed since it last
    did (from -1). The accumulation changes in warm-up, so this is a fold.
    """
    zero = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("fires"))

    def step(acc: Column, ni: Column) -> Column:
        fire = ni - acc.last >= warmup_accumulate(ni, warmup, batch_size, nominal)
        return F.struct(F.when(fire, ni).otherwise(acc.last).alias("last"), (acc.fires + F.when(fire, 1).otherwise(0)).cast("long").alias("fires"))

    folded = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col(steps).cast("long") - 1), zero, step)
    return counts.withColumn("__f", folded).select(*run, steps, F.col("__f.fires").alias("fires"), F.col("__f.last").alias("last_fire"))


def previous(df: DataFrame, run: list[str], order: list, value: str, out: str, default=0.0) -> DataFrame:
    """The value of the row before, as feedback from the epoch before."""
    return df.withColumn(out, F.lag(value, 1, default).over(Window.partitionBy(*run).orderBy(*order)))


def checkpoints(df: DataFrame, run: list[str], epoch: str, fitness: str, period: int = -1, last_epoch: int | None = None) -> DataFrame:
    """Which files each epoch writes: last always, best when no epoch before was better, periodic every ``period``."""
    x = best_so_far(df, run, [F.col(epoch)], fitness)
    periodic = (F.lit(period) > 0) & (F.col(epoch) % F.lit(max(period, 1)) == 0)
    return x.withColumns({"save_last": F.lit(True), "save_best": F.col(fitness) == F.col("best"), "save_periodic": periodic})


def save_gate(nosave: Column, final: Column, evolve: Column) -> Column:
    return ~nosave | (final & ~evolve)


def validate_gate(noval: Column, final: Column) -> Column:
    return ~noval | final


def progress_line(epoch: Column, values: list[Column], instances: Column, size: Column) -> Column:
    """Fields eleven wide, numbers to four significant digits."""
    return F.format_string("%11s" + "%11.4g" * len(values) + "%11d%11d", epoch, *values, instances, size)


def gradient_norm(df: DataFrame, run: list[str], grad: str, limit: float = 10.0) -> DataFrame:
    """Global norm of each run's gradient and the factor that clips it."""
    norm = F.sqrt(F.sum(F.col(grad) * F.col(grad)))
    return df.groupBy(*run).agg(norm.alias("norm")).withColumn("scale", F.least(F.lit(1.0), F.lit(limit) / F.col("norm")))
