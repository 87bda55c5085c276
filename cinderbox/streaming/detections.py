"""The live detection plan on a stream: read, infer by plug-in, threshold, suppress, label, sink; hooks and stopping."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Hooks(StreamingQueryListener):
    """Named actions that run on events; an action may ask for the query to stop."""

    #: Names that the training loop knows.
    NAMES = ("on_pretrain_routine_start", "on_pretrain_routine_end", "on_train_start", "on_train_epoch_start", "on_train_batch_start", "on_train_batch_end",
             "on_train_epoch_end", "on_fit_epoch_end", "on_model_save", "on_train_end", "on_params_update")

    def __init__(self):
        self.actions: dict[str, list[Callable]] = {}
        self.stop = False

    def register(self, name: str, action: Callable) -> None:
        if name not in self.NAMES:
            raise ValueError(f"unknown event {name}")
        self.actions.setdefault(name, []).append(action)

    def run(self, name: str, *args) -> None:
        for action in self.actions.get(name, ()):
            if action(*args) is False:
                self.stop = True

    def onQueryStarted(self, event) -> None:
        self.run("on_train_start", event)

    def onQueryProgress(self, event) -> None:
        self.run("on_train_batch_end", event)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.run("on_train_end", event)


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A parquet table of a folder as a stream; its schema is read from the table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, hooks: Hooks | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a batch plan on each micro-batch until the source is used up and returns what was written.

    Each micro-batch writes a folder of its own and overwrites it when it is
    run again, so rows are written once whatever fails.
    """
    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if hooks:
            hooks.run("on_train_batch_end", number)

    query: StreamingQuery = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}-state").start()
    try:
        if hooks is None:
            query.processAllAvailable()
        while hooks is not None and query.isActive and not hooks.stop:
            time.sleep(0.1)
            last = query.lastProgress
            if last is not None and not last.numInputRows and not query.status["isDataAvailable"]:
                break
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.parquet(path).drop("batch")


def best_so_far_stream(stream: DataFrame, run: str, value: str, ts: str, patience: int) -> DataFrame:
    """Keyed state on a stream of metric rows: run, ts, value, best, stop (set ``patience`` rows after the last best and kept).

    Rows of a run are taken in ts order inside a micro-batch.
    """
    import pandas as pd

    kind = dict(stream.dtypes)[run]

    def step(key, frames, state):
        best, since = state.get if state.exists else (float("-inf"), 0)
        rows = []
        for f in frames:
            for r in f.sort_values(ts).itertuples(index=False):
                v = getattr(r, value)
                best, since = (v, 0) if v >= best else (best, since + 1)
                rows.append((key[0], getattr(r, ts), v, best, since >= patience))
        state.update((best, since))
        yield pd.DataFrame(rows, columns=[run, ts, value, "best", "stop"])

    return stream.select(run, F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value)).groupBy(run).applyInPandasWithState(
        step, f"{run} {kind}, {ts} timestamp, {value} double, best double, stop boolean", "best double, since long", "append", "NoTimeout")
