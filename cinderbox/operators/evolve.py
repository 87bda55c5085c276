"""Genetic search over hyper-parameters: tournaments, elites, crossover, mutation.

A population is a DataFrame (idx, genes array<double>). All random numbers are
hashes of (seed, generation, index, purpose), so a search repeats itself, and
rows are values: a child never shares genes with its parent, and what is
reported is the individual that earned its score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbox.functions.expr import clamp, hash_int, hash_uniform, spliced
from cinderbox.operators.sample import between
from cinderbox.operators.selection import elite, first_best, tournaments

# Name, whether the search changes it, lower and upper limit; and the sizes of the search.
GENES = (
    ("lr0", False, 1e-5, 1e-1), ("lrf", False, 0.01, 1.0), ("momentum", False, 0.6, 0.98), ("weight_decay", False, 0.0, 0.001),
    ("warmup_epochs", False, 0.0, 5.0), ("warmup_momentum", False, 0.0, 0.95), ("warmup_bias_lr", False, 0.0, 0.2), ("box", False, 0.02, 0.2),
    ("cls", False, 0.2, 4.0), ("cls_pw", False, 0.5, 2.0), ("obj", False, 0.2, 4.0), ("obj_pw", False, 0.5, 2.0), ("iou_t", False, 0.1, 0.7),
    ("anchor_t", False, 2.0, 8.0), ("anchors", False, 2.0, 10.0), ("fl_gamma", False, 0.0, 2.0), ("hsv_h", True, 0.0, 0.1), ("hsv_s", True, 0.0, 0.9),
    ("hsv_v", True, 0.0, 0.9), ("degrees", True, 0.0, 45.0), ("translate", True, 0.0, 0.9), ("scale", True, 0.0, 0.9), ("shear", True, 0.0, 10.0),
    ("perspective", True, 0.0, 0.001), ("flipud", True, 0.0, 1.0), ("fliplr", True, 0.0, 1.0), ("mosaic", True, 0.0, 1.0), ("mixup", True, 0.0, 1.0),
    ("copy_paste", True, 0.0, 1.0),
)
POPULATION = 50
ELITE = (2, 5)
TOURNAMENT = (2, 10)
CROSSOVER = (0.5, 1.0)
MUTATION = (0.01, 0.5)
SHIFT = 0.1


def gene_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *g) for i, g in enumerate(GENES)]
    return spark.createDataFrame(rows, "pos int, name string, evolve boolean, lo double, hi double")


def elite_size(generation: int, generations: int) -> int:
    return ELITE[0] + int((ELITE[1] - ELITE[0]) * (generation / generations))


def tournament_size(generation: int, generations: int, population: int = POPULATION) -> int:
    return max(TOURNAMENT[0], int(min(TOURNAMENT[1], population) - generation / (generations / 10)))


def rate(bounds: tuple[float, float], generation: int, generations: int) -> float:
    """The upper bound less the share of generations done, inside the bounds."""
    return max(bounds[0], min(bounds[1], bounds[1] - generation / generations))


def initial(spark: SparkSession, lo: list[float], hi: list[float], seeds: list[list[float]] = (), seed: int = 0, population: int = POPULATION) -> DataFrame:
    """Seeds, the last read first, then individuals uniform in their ranges; seeds beyond the population's size are left out."""
    known = [(i, [float(x) for x in g]) for i, g in enumerate(list(seeds)[::-1][:population])]
    fill = spark.range(len(known), population).select(F.col("id").cast("int").alias("idx"), F.array(*[
        between(hash_uniform(F.lit(seed), F.lit("start"), F.col("id"), F.lit(j)), a, b) for j, (a, b) in enumerate(zip(lo, hi, strict=True))]).alias("genes"))
    return spark.createDataFrame(known, "idx int, genes array<double>").unionByName(fill) if known else fill


def crossed(a: Column, b: Column, generation: int, generations: int, key: Column, seed: int, length: int) -> Column:
    """Genes of one child: a's head and b's tail, or a's alone."""
    cut = hash_int(1, length - 1, F.lit(seed), F.lit(generation), key, F.lit("cut")).cast("int")
    return F.when(hash_uniform(F.lit(seed), F.lit(generation), key, F.lit("cross")) < rate(CROSSOVER, generation, generations), spliced(a, b, cut)).otherwise(a)


def mutated(genes: Column, lo: list[float], hi: list[float], chance: float, key: Column, generation: int, seed: int) -> Column:
    """Each gene moved, with this chance, by up to SHIFT either way, and held inside its range."""
    lows, highs = (F.array(*[F.lit(float(x)) for x in v]) for v in (lo, hi))

    def gene(x: Column, j: Column) -> Column:
        u = hash_uniform(F.lit(seed), F.lit(generation), key, j, F.lit("move"))
        moved = clamp(x + between(u, -SHIFT, SHIFT), F.get(lows, j), F.get(highs, j))
        return F.when(hash_uniform(F.lit(seed), F.lit(generation), key, j, F.lit("whether")) < chance, moved).otherwise(x)

    return F.transform(genes, gene)


def next_generation(scored: DataFrame, lo: list[float], hi: list[float], generation: int, generations: int, seed: int = 0, population: int = POPULATION) -> DataFrame:
    """Children of a scored population (idx, genes, fitness)."""
    spark = scored.sparkSession
    k = elite_size(generation, generations)
    won = tournaments(scored, "idx", "fitness", population - k, tournament_size(generation, generations, population), seed * 1000003 + generation)
    won = won.select(F.col("t").alias("place"), "idx")
    # elites follow the winners; ties may bring more than k, of which only those within the population become parents
    best = elite(scored, "fitness", k).select("idx")
    from pyspark.sql import Window

    best = best.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("idx")) - 1 + population - k).alias("place"), "idx")
    parents = won.unionByName(best).where(F.col("place") < population).join(scored.select("idx", "genes"), "idx").select("place", "genes")
    child = spark.range(population).select(F.col("id").cast("int").alias("idx"))
    for name in ("a", "b"):
        child = child.withColumn(name, hash_int(0, population - 1, F.lit(seed), F.lit(generation), F.col("idx"), F.lit(name)))
    child = child.join(parents.select(F.col("place").alias("a"), F.col("genes").alias("ga")), "a").join(parents.select(F.col("place").alias("b"), F.col("genes").alias("gb")), "b")
    genes = crossed(F.col("ga"), F.col("gb"), generation, generations, F.col("idx"), seed, len(lo))
    return child.select("idx", mutated(genes, lo, hi, rate(MUTATION, generation, generations), F.col("idx"), generation, seed).alias("genes"))


def search(spark: SparkSession, evaluate: Callable[[DataFrame], DataFrame], generations: int, seeds: list[list[float]] = (), seed: int = 0,
           population: int = POPULATION, lo: list[float] | None = None, hi: list[float] | None = None,
           on_generation: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, tuple[list[float], float]]:
    """Runs the search; returns the last scored population and the best (genes, fitness) of all generations.

    ``evaluate`` adds ``fitness`` to a population. A population is a few dozen
    rows, so each generation's scores are fetched and start the next plan: the
    lineage stays short and nothing depends on an executor's memory.
    """
    if generations < 1:
        raise ValueError("a search needs a generation")
    lo = [g[2] for g in GENES if g[1]] if lo is None else lo
    hi = [g[3] for g in GENES if g[1]] if hi is None else hi
    current, best = initial(spark, lo, hi, seeds, seed, population), ([], float("-inf"))
    for g in range(generations):
        rows = [(r.idx, list(r.genes), float(r.fitness)) for r in evaluate(current).select("idx", "genes", "fitness").collect()]
        scored = spark.createDataFrame(rows, "idx int, genes array<double>, fitness double")
        top = first_best(scored, "fitness", "idx").first()
        if top is not None and top.fitness > best[1]:
            best = (list(top.genes), top.fitness)
        if on_generation:
            on_generation(g, scored)
        current = next_generation(scored, lo, hi, g, generations, seed, population)
    return scored, best
