"""Mixing sources to target weights [native]: Pareto order sampling of whole documents.

Sources in code point order (null last) weigh 3, 1, 2, repeating, and share
150 % of all words; a source's target stops at twice its words and the excess
is shared again by weight. With rate r = target / source words, every document
gets floor(r) certain copies. One copy more goes to a sample with unequal
inclusion probabilities, in proportion to size: p = min(1, c size), with c such
that the expected words of the sample are the rest of the target. A document
with p = 1 gets its copy for certain. The others are ranked by Pareto's
variable, random odds u/(1-u) over inclusion odds p/(1-p), and taken in that
order. The size of the sample is fixed in words, the unit of the targets, not in
documents: a document that no longer fits ends the first pass, a second pass
takes those after it, in the same order, that fit what is still missing, and one
more document, whose size is nearest to what is missing then, is taken if that
brings the source nearer to its target.

The random number is a hash of the document's id, so reruns agree.

Defined cases: null text has size 0; a null source is a source of its own; an
empty table gives an empty result; a source without words has target 0 and its
documents are taken once (0 words); documents without words in other sources
get the certain copies only; repeated rows are documents of their own; ids that
tie are ordered by size; very long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, running_sums, small, table, word_count

#: Weights of the sources in order, repeating, the share of all words, and the most copies (the contract's values).
WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3  # 150 % as halves
MOST = 2


def uniform(key: Column) -> Column:
    """A number inside (0, 1) that depends on the key alone: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """One row per source: __source, source_size, target, and the words of all sources before it.

    Sources are a large table too, in principle, so order and running sums are
    taken over ranges. A source is at its cap when its cap per weight is not
    above the level that the uncapped sources after it would get; caps per weight
    ascend, so the capped ones are a prefix.
    """
    per = sizes.groupBy(F.col(source).alias("__source")).agg(F.sum("size").alias("source_size"))
    named = running_sums(per, [F.col("__source").asc_nulls_last()], {"__start": F.col("source_size")}, "sources")
    k = ((F.col("__rank") - 1) % len(WEIGHTS)).cast("int")
    named = named.withColumn("__weight", F.element_at(F.array(*[F.lit(x).cast("long") for x in WEIGHTS]), k + 1))
    named = named.withColumn("__start", F.col("__start") - F.col("source_size"))
    per_weight = F.col("source_size") * (F.lit(6) / F.col("__weight")).cast("long")  # in proportion to cap / weight, as a whole number
    ranked = running_sums(named, [per_weight.asc(), F.col("__source").asc_nulls_last()],
                          {"__sat": F.col("source_size"), "__w": F.col("__weight")}, "levels")
    total, total_w = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    level = ((F.lit(SHARE_HALVES * total) - 2 * MOST * (F.col("__sat") - F.col("source_size"))).cast("double")
             / (2 * (F.lit(total_w) - F.col("__w") + F.col("__weight"))).cast("double"))
    x = ranked.withColumn("__level", level).withColumn(
        "__capped", (MOST * F.col("source_size")).cast("double") / F.col("__weight").cast("double") <= F.col("__level"))
    x = materialise(x, "targets")
    first = x.where(~F.col("__capped")).agg(F.min(F.struct("__rank", "__level")).alias("f")).first().f
    capped = (MOST * F.col("source_size")).cast("double")
    target = capped if first is None else F.when(F.col("__capped") & (F.col("__rank") < first[0]), capped).otherwise(
        F.col("__weight").cast("double") * F.lit(first[1]))
    return materialise(x.select("__source", "source_size", "__start", target.alias("target")), "targets")


def inclusion(sizes: DataFrame, rests: DataFrame, source: str = "source") -> DataFrame:
    """One row per source of ``rests`` (__source, __rest): the size from which documents are certain (null: none) and c.

    In descending order of size a document is certain when c, fitted to it and
    the smaller ones, would give it a probability of 1 or more: the certain ones
    are the first. Documents of one size are one row of the table that is ordered.
    """
    x = sizes.where("size > 0").groupBy(F.col(source).alias("__s"), "size").agg(F.count(F.lit(1)).alias("__n"))
    x = x.withColumn("__words", F.col("__n") * F.col("size")).withColumn("__squares", F.col("__words") * F.col("size"))
    x = running_sums(x, [F.col("__s").asc_nulls_last(), F.col("size").desc()], {"__w": F.col("__words"), "__q": F.col("__squares")}, "bysize")
    x = materialise(x, "ordered")
    ends = materialise(x.groupBy(F.col("__s").alias("__e")).agg(
        F.max("__q").alias("__qs"), (F.max("__w") - F.sum("__words")).alias("__before")), "ends")
    x = x.join(ends, F.col("__s").eqNullSafe(F.col("__e"))).join(rests, F.col("__s").eqNullSafe(F.col("__source")))
    # words of larger ones, squares of this size and the smaller ones
    larger = F.col("__w") - F.col("__words") - F.col("__before")
    tail = F.col("__qs") - F.col("__q") + F.col("__squares")
    certain = (F.col("__rest") - larger.cast("double")) * F.col("size").cast("double") >= tail.cast("double")
    x = x.withColumn("__certain", certain)
    x = x.groupBy("__s").agg(F.min(F.when(F.col("__certain"), F.col("size"))).alias("__from"), F.first("__rest").alias("__rest"),
                             F.coalesce(F.sum(F.when(F.col("__certain"), F.col("__words"))), F.lit(0)).alias("__sure"),
                             F.sum(F.when(~F.col("__certain"), F.col("__squares"))).alias("__left"))
    return materialise(x.select("__s", "__from", ((F.col("__rest") - F.col("__sure").cast("double")) / F.col("__left").cast("double")).alias("__c"),
                                F.col("__sure")), "inclusion")


def _sampled(sizes: DataFrame, source: str) -> DataFrame:
    """``sizes`` (doc_id, source, size, more) with source_size, target, copies and taken."""
    some = F.col("source_size") > 0
    whole = F.when(some, F.least(F.lit(float(MOST)), F.floor(F.col("target") / F.col("source_size")).cast("double"))).otherwise(F.lit(0.0))
    targets = source_targets(sizes, source).withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    targets = materialise(targets, "rests")
    x = sizes.join(targets, sizes[source].eqNullSafe(targets["__source"]))
    # one row a source, written: the joins with a hot source's rows then know that this side is small
    chances = inclusion(sizes, targets.select("__source", "__rest"), source)
    x = x.join(chances, F.col("__source").eqNullSafe(F.col("__s")), "left")
    sure = F.coalesce((F.col("size") >= F.col("__from")) & (F.col("__rest") > 0), F.lit(False))
    x = x.withColumn("__sure", F.coalesce("__sure", F.lit(0))).withColumn("__certain", sure)
    p = F.least(F.lit(1.0), F.coalesce(F.col("__c"), F.lit(0.0)) * F.col("size").cast("double"))
    odds = lambda p: p / (1 - p)
    u = uniform(F.col("doc_id"))
    # certain ones are not ranked against the rest, and those without a chance come last
    x = x.withColumn("__chance", p).withColumn("__open", ~F.col("__certain") & (F.col("__chance") > 0))
    x = x.withColumn("__q", F.when(F.col("__open") & (F.col("__chance") < 1), odds(u) / odds(F.col("__chance"))).when(F.col("__open"), F.lit(0.0)).otherwise(odds(u)))
    # what is missing when the certain ones are taken
    x = x.withColumn("__need", F.col("__rest") - F.col("__sure").cast("double"))
    tie = [F.col("__q").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc()]
    x = running_sums(x, [F.col(source).asc_nulls_last(), F.col("__open").desc(), *tie], {"__cum": F.col("size")}, "ranked")
    # words of the sources before, and this one's documents come first if they have a chance
    x = x.withColumn("__cum", F.col("__cum") - F.col("__start")).withColumn("__in", F.col("__open") & (F.col("__cum") <= F.col("__need")))
    x = materialise(x, "sampled")

    def missing(taken: DataFrame, need: str, cum: str, out: str) -> DataFrame:
        got = F.coalesce(F.max(F.when(F.col("__in"), F.col(cum))), F.lit(0))
        return materialise(taken.groupBy(F.col("__source").alias("__g")).agg((F.first(need) - got).alias(out)), "gaps")

    gaps = missing(x, "__need", "__cum", "__gap")
    second = x.where(F.col("__open") & ~F.col("__in")).join(gaps, F.col("__source").eqNullSafe(F.col("__g"))).where(F.col("size") <= F.col("__gap"))
    second = running_sums(second.select("__source", "__gap", F.col("__rank").alias("__first"), "size", "__q"),
                          [F.col("__source").asc_nulls_last(), F.col("__first").asc()], {"__sum": F.col("size")}, "second")
    second = materialise(second, "fitting")
    starts = materialise(second.groupBy(F.col("__source").alias("__o")).agg(F.min(F.col("__sum") - F.col("size")).alias("__begin")), "starts")
    second = second.join(starts, F.col("__source").eqNullSafe(F.col("__o"))).withColumn("__sum", F.col("__sum") - F.col("__begin"))
    second = materialise(second.withColumn("__in", F.col("__sum") <= F.col("__gap")), "second")
    gaps = materialise(gaps.join(missing(second, "__gap", "__sum", "__gap2").withColumnRenamed("__g", "__g2"), F.col("__g").eqNullSafe(F.col("__g2")), "left")
                       .select("__g", F.coalesce("__gap2", "__gap").alias("__gap")), "gaps")
    taken = materialise(second.where("__in").select(F.col("__first").alias("__again")), "again")
    x = x.join(taken, x["__rank"] == taken["__again"], "left").withColumn("__in", F.col("__in") | F.col("__again").isNotNull())
    left = x.where(F.col("__open") & ~F.col("__in")).join(gaps, F.col("__source").eqNullSafe(F.col("__g")))
    extra = left.where(F.col("size") < 2 * F.col("__gap")).groupBy("__g").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("__gap")).alias("d"), F.col("__rank").alias("r")))["r"].alias("__extra")).select("__extra")
    extra = materialise(extra, "extra")
    x = x.join(extra, x["__rank"] == extra["__extra"], "left")
    once = F.col("__certain") | F.col("__in") | F.col("__extra").isNotNull() | ~some
    copies = F.col("__whole").cast("long") + once.cast("long")
    return x.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*sizes.columns, "source_size", "target", "copies", "taken")


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    sizes = materialise(docs.select("doc_id", F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    return _sampled(sizes, "source")


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the plan takes it, same columns.

    Decisions are joined back by id and a hash of the row, as text is too large
    to carry through the ranking. Rows that agree in both are the same document
    repeated, and share the copies that they got together; only they are numbered.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("__key")), "sizes")
    plan = _sampled(sizes, "source").groupBy(F.col("__key").alias("__k")).agg(F.sum("copies").alias("__c"), F.count(F.lit(1)).alias("__n"))
    plan = materialise(plan.where("__c > 0"), "plan")
    again = plan.where("__n > 1")

    def repeated(x: DataFrame, times: Column) -> DataFrame:
        x = x.withColumn("__times", times).where("__times > 0")
        return x.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)

    keyed = docs.withColumn("__key", key)
    out = repeated(keyed.join(plan.where("__n = 1"), F.col("__key") == F.col("__k")), F.col("__c"))
    if again.isEmpty():
        return out
    nth = F.row_number().over(Window.partitionBy("__k").orderBy("doc_id"))
    shared = F.floor(F.col("__c") / F.col("__n")) + (nth <= F.col("__c") % F.col("__n")).cast("long")
    return out.unionByName(repeated(keyed.join(small(again), F.col("__key") == F.col("__k")), shared))


def op6_mix_sources(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
l AS (SELECT *, row_number() OVER o AS rk, sum(ss) OVER o - ss AS sat, sum(w) OVER () - sum(w) OVER o + w AS wleft, sum(ss) OVER () AS total
      FROM w WINDOW o AS (ORDER BY ss * (6 // w), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, (3 * total - 4 * sat)::DOUBLE / (2 * wleft)::DOUBLE AS level FROM l),
k AS (SELECT *, (2 * ss)::DOUBLE / w::DOUBLE <= level AS capped FROM c),
f AS (SELECT min(rk) AS rk, arg_min(level, rk) AS level FROM k WHERE NOT capped),
t AS (SELECT source, ss, CASE WHEN capped AND (f.rk IS NULL OR k.rk < f.rk) THEN (2 * ss)::DOUBLE ELSE w::DOUBLE * f.level END AS target FROM k, f),
r AS (SELECT *, target - whole * ss AS rest FROM (SELECT *, CASE WHEN ss > 0 THEN least(2.0, floor(target / ss)) ELSE 0.0 END::DOUBLE AS whole FROM t)),
b AS (SELECT source, size, count(*) * size AS words, count(*) * size * size AS squares FROM d WHERE size > 0 GROUP BY source, size),
i AS (SELECT b.source, size, words, squares, rest,
             (rest - coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) * size::DOUBLE
               >= (sum(squares) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS certain
      FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source WINDOW o AS (PARTITION BY b.source ORDER BY size DESC)),
ch AS (SELECT source, min(CASE WHEN certain THEN size END) AS since, coalesce(sum(CASE WHEN certain THEN words END), 0)::DOUBLE AS sure,
              (any_value(rest) - coalesce(sum(CASE WHEN certain THEN words END), 0)::DOUBLE) / (sum(CASE WHEN NOT certain THEN squares END))::DOUBLE AS c
       FROM i GROUP BY source),
g AS (SELECT rid, doc_id, d.source, size, ss, target, whole, rest - coalesce(sure, 0) AS need, coalesce(size >= since AND rest > 0, false) AS certain,
             least(1.0::DOUBLE, coalesce(c, 0.0::DOUBLE) * size::DOUBLE) AS p,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN ch ON d.source IS NOT DISTINCT FROM ch.source),
q AS (SELECT *, NOT certain AND p > 0 AS open,
             CASE WHEN NOT certain AND p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) WHEN NOT certain AND p > 0 THEN 0 ELSE u / (1 - u) END AS q FROM g),
cu AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST, open DESC, q, doc_id NULLS FIRST, size, rid) AS rk,
              open AND sum(size) OVER (PARTITION BY source ORDER BY open DESC, q, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) <= need AS one FROM q),
g1 AS (SELECT source, any_value(need) - coalesce(sum(CASE WHEN one THEN size END), 0) AS gap FROM cu GROUP BY source),
s2 AS (SELECT rk, cu.source, size, gap, sum(size) OVER (PARTITION BY cu.source ORDER BY rk ROWS UNBOUNDED PRECEDING) <= gap AS two
       FROM cu JOIN g1 ON cu.source IS NOT DISTINCT FROM g1.source WHERE open AND NOT one AND size <= gap),
g2 AS (SELECT g1.source, gap - coalesce(got, 0) AS gap FROM g1 LEFT JOIN (SELECT source, sum(CASE WHEN two THEN size END) AS got FROM s2 GROUP BY source) z
       ON g1.source IS NOT DISTINCT FROM z.source),
lf AS (SELECT cu.*, one OR coalesce(two, false) AS chosen FROM cu LEFT JOIN (SELECT rk, two FROM s2) y ON cu.rk = y.rk),
ex AS (SELECT lf.source, arg_min(rk, (abs(size - gap), rk)) AS rk FROM lf JOIN g2 ON lf.source IS NOT DISTINCT FROM g2.source
       WHERE open AND NOT chosen AND size < 2 * gap GROUP BY lf.source),
o AS (SELECT doc_id, size, ss, target, whole::BIGINT + (certain OR chosen OR ex.rk IS NOT NULL OR ss = 0)::BIGINT AS copies FROM lf LEFT JOIN ex ON lf.rk = ex.rk)
SELECT doc_id, size, ss AS source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM o
"""
