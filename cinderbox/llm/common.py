"""Shared pieces of the corpus operators: words, table access, checkpoints, components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these (fixed value of the contracts).
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without a pass over their array; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_CLASS))).cast("long")


def let(value: Column, body) -> Column:
    """Bind a value once inside one expression: ``body`` sees it as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A session that names none gets a local one where Spark itself is local (a
    laptop); on a cluster it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[[^,]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="cinderbox-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = f"file://{path}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Where the paths of work tables are noted, inside ``kept_apart``.
_NOTED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    noted = _NOTED.get()
    if noted is not None:
        noted.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_apart(spark: SparkSession, build) -> tuple[DataFrame, list[str]]:
    """What ``build()`` returns, and the paths of the work tables that it wrote; they are deleted if it fails."""
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        return build(), paths
    except BaseException:
        sweep(spark, paths)
        raise
    finally:
        _NOTED.reset(token)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete work tables; for when every result that reads them is itself written. Empties the list."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)
    release(spark)


def discard(*tables: DataFrame) -> None:
    """Delete written work tables that nothing reads any more."""
    for df in tables:
        sweep(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


#: Rows of a few numbers each that may go to every task (some 50 MB in memory).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``rows``; else Spark's shuffled joins take it."""
    return F.broadcast(df) if df.count() <= rows else df


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what runs inside: a batch of long texts is held whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does when the driver collects garbage.

    Twice, as the plan of the last step is let go only while the first collection runs.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "sorted") -> DataFrame:
    """Rank and running sums over all rows in a global order, without a task that sees all rows.

    Rows are dealt into ranges of the order, numbered and summed inside each
    range; the sums of the ranges before are then added. Adds ``__rank`` (from
    1) and the named sums (this row included). Ties fall into one range, in an
    order that is fixed once the sorted rows are written.
    """
    kept = [c for c in df.columns if c != "__rank" and c not in sums]
    df = df.withColumns({f"__v_{k}": c for k, c in sums.items()}).withColumn("__v_rank", F.lit(1).cast("long"))
    names = [*sums, "rank"]
    df = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    df = materialise(df, name).withColumn("__pid", F.shiftright("__m", 33))
    by_range = df.groupBy("__pid").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in names])
    # one row per range, so the number of tasks that wrote them bounds both this window and the broadcast
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    base = by_range.select(F.col("__pid").alias("__p"), *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in names])
    inside = Window.partitionBy("__pid").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__c_{k}": F.sum(f"__v_{k}").over(inside) for k in names})
    df = df.join(F.broadcast(base), df["__pid"] == base["__p"])
    out = {("__rank" if k == "rank" else k): F.col(f"__b_{k}") + F.col(f"__c_{k}") for k in names}
    return df.select(*kept, *[c.alias(k) for k, c in out.items()])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: one row (node, root) per node, root the smallest node.

    Contraction: every node points at its smallest neighbour, pointers are jumped
    to their end, the edge list is rewritten between the roots and shrinks at
    least by half. All steps are joins and grouped minima, so nothing is
    collected; each round is written to the shared folder. Nodes of any
    orderable type; null ends and loops are ignored.
    """
    spark = edges.sparkSession
    es = materialise(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges")
    mapping = None
    while True:
        if es.isEmpty():
            break
        both = es.union(es.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("root"))
        parent = materialise(parent, "parents")
        while True:  # root of root until nothing moves; chains only go down, so this ends
            up = parent.select(F.col("node").alias("r"), F.col("root").alias("rr"))
            jumped = materialise(parent.join(up, parent.root == up.r).select("node", F.col("rr").alias("root"),
                                                                             (F.col("rr") != F.col("root")).alias("moved")), "jumped")
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("node", "root")
            if not moved:
                break
        if mapping is None:
            mapping = parent
        else:
            up = parent.select(F.col("node").alias("r"), F.col("root").alias("rr"))
            mapping = materialise(
                mapping.join(up, mapping.root == up.r, "left").select("node", F.coalesce("rr", "root").alias("root")), "mapping")
        pa, pb = (parent.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
        es = materialise(
            es.join(pa, "a").join(pb, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if mapping is None:
        return es.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return mapping
