"""Sinks: checkpoints by role, run folders, append logs, NDJSON, detections as JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def run_folder(spark: SparkSession, path: str, exist_ok: bool = False) -> str:
    """The path itself where it is free or may be shared, else with the next number after it."""
    fs, p = _fs(spark, path)
    if exist_ok or not fs.exists(p):
        return path
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    taken = [re.fullmatch(rf"{re.escape(stem)}(\d+)", s.getPath().getName()) for s in fs.listStatus(p.getParent())]
    return f"{path.rstrip('/')}{max([1, *(int(m[1]) for m in taken if m)]) + 1}"


def save_options(options: DataFrame, folder: str, name: str, evolve: bool = False) -> None:
    """Options as JSON, overwritten; nothing in a search."""
    if not evolve:
        options.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def save_checkpoint(state: DataFrame, folder: str, epoch: int, best: bool, period: int = -1) -> list[str]:
    """Writes a checkpoint's rows as last, and as best and by epoch where due; returns the names written."""
    names = ["last", *["best"] * best, *[f"epoch={epoch}"] * (period > 0 and epoch % period == 0)]
    for n in names:
        state.write.mode("overwrite").parquet(f"{folder}/{n}")
    return names


def stripped(spark: SparkSession, folder: str, out: str, columns: list[str]) -> DataFrame:
    """A checkpoint without these columns, at a new path."""
    spark.read.parquet(folder).drop(*columns).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def ndjson(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def detections_json(df: DataFrame, path: str) -> None:
    """One object for each detection: image_id, category_id, bbox (x, y, width, height), score."""
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    df.select(F.col("frame_id").alias("image_id"), F.col("cls").alias("category_id"), box.alias("bbox"), F.round("conf", 5).alias("score")).write.mode("overwrite").json(path)


def population_map(population: DataFrame, generation: int, names: list[str]) -> DataFrame:
    """One row: a map from ``gen{g}number{i}`` to the individual's genes by name."""
    genes = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("genes"))
    entry = F.struct(F.concat(F.lit(f"gen{generation}number"), F.col("idx").cast("string")).alias("key"), genes.alias("value"))
    return population.agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))).alias("population"))


def save_population(population: DataFrame, path: str, generation: int, names: list[str]) -> bool:
    """Overwrites the dump; nothing before generation 1."""
    if generation < 1:
        return False
    population_map(population, generation, names).coalesce(1).write.mode("overwrite").json(path)
    return True


def best_text(names: list[str], genes: list[float], fitness: float) -> str:
    return f"fitness {fitness:.4g}: " + ", ".join(f"{n}={g:.4g}" for n, g in zip(names, genes, strict=True))
