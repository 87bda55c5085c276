"""Quality rules [native]: rule failures by host, shrunken failure rates, host verdicts joined back.

Base statistics come from each whole text; a document fails the base rules when
it has too few words or too many words inside repeated three-word windows, and
the symbol rule when it has many symbols for its characters. Failures of any
rule are summed by host (the ``source`` column), and each host's rate is shrunk
towards a beta prior fitted to all hosts by moments. The verdicts on hosts:

* ``rejected``, a shrunken rate above ``max_host_rate``: all its documents go.
* ``watched``, a shrunken rate more than WATCHED of the prior's standard
  deviations above its mean: documents that fail the symbol rule go too.
* ``trusted``, the others: only documents that fail the base rules go.

So a document that passes every rule goes with a rejected host only, and the
bar of a watched host follows the hosts themselves.

Defined cases: null and empty texts have no words and fail; null hosts form one
host; repeated rows count as often as they occur; an empty table gives an empty
result; very long texts are read whole, with statistics in n log n; other columns
stay as they are, and those named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, materialise, table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols for each 100 characters of words from which the symbol rule fails.
MAX_SYMBOL_PERCENT = 5
#: A host is rejected when its shrunken failure rate is above this.
MAX_HOST_RATE = 0.8
#: A host is watched when its shrunken rate is above the prior's mean by more than this many of its standard deviations.
WATCHED = 0.5
#: Symbols that count as noise (fixed value of the contract).
SYMBOLS = "#*$%&|<>"
#: Bits of a packed window that hold its position; the rest hold its hash.
POS_BITS = 26


def _covered(positions: Column) -> Column:
    """Words under three-word windows that start at these ascending positions."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        positions, zero,
        lambda acc, i: F.struct((acc.n + i + 3 - F.greatest(i, acc.end)).alias("n"), (i + 3).alias("end")),
        lambda acc: acc.n)


def _repeat_exact(w: Column) -> Column:
    """Slow form, taken only where two different windows share a packed hash."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    gram = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    ranked = F.sort_array(F.transform(starts, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
    dup = let(ranked, lambda s: F.filter(s, lambda x, k: (x.g == F.get(s, k - 1).g) | (x.g == F.get(s, k + 1).g)))
    return _covered(F.array_sort(F.transform(dup, lambda x: x.i)))


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are hashed and packed with their position into one number, sorted,
    and compared with their neighbours: n log n for any length of text. A pair
    of neighbours with equal hash and different words sends the text to the
    exact form.
    """
    packed = lambda w: F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POS_BITS).bitwiseOR(i.cast("long"))))
    pos = lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")
    same_hash = lambda x, y: F.shiftright(x, POS_BITS) == F.shiftright(y, POS_BITS)

    def same_words(w: Column, x: Column, y: Column) -> Column:
        i, j = pos(x), pos(y)
        return ((F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2)))

    def fast(w: Column) -> Column:
        def of(s: Column) -> Column:
            hit = F.filter(s, lambda x, k: F.coalesce(same_hash(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same_hash(x, F.get(s, k + 1)), F.lit(False)))
            def checked(d: Column) -> Column:
                mixed = F.exists(F.transform(d, lambda x, k: F.coalesce(same_hash(x, F.get(d, k - 1)) & ~same_words(w, x, F.get(d, k - 1)), F.lit(False))), lambda b: b)
                return F.when(F.size(d) == 0, F.lit(0)).when(mixed, F.lit(-1)).otherwise(_covered(F.array_sort(F.transform(d, pos))))
            return let(hit, checked)
        return let(packed(w), of)

    return let(w, lambda w: F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) >= 1 << POS_BITS, _repeat_exact(w)).otherwise(
        let(fast(w), lambda n: F.when(n < 0, _repeat_exact(w)).otherwise(n)))).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """Base statistics of a text, by name. ``n_words`` and ``n_repeat_words`` share one split."""
    t = F.coalesce(text, F.lit(""))
    lines = lambda: F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return {
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and symbols_failed."""
    both = let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    df = docs.withColumn("__w", both).withColumns(statistics(F.col(text)))
    df = df.withColumn("n_words", F.col("__w.n")).withColumn("n_repeat_words", F.col("__w.r")).drop("__w")
    return df.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "symbols_failed": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")})


def host_rates(base: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: __host, host_docs, host_fails, host_rate (shrunken), host_verdict.

    Beta prior by moments over the hosts' rates: mean m and variance v give
    strength k = m(1-m)/v - 1, at least 1 and at most 1000 (few hosts, or hosts
    that are all alike); the shrunken rate is (fails + k m) / (n + k), and the
    prior's variance m(1-m) / (k + 1). The table of hosts is written once, so
    its size is known to whatever joins it.
    """
    failed = F.col("base_failed") | F.col("symbols_failed")
    hosts = materialise(base.groupBy(F.col(host).alias("__host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(failed.cast("long")).alias("host_fails")), "hosts")
    rate = F.col("host_fails") / F.col("host_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    k = max(1.0, min(1000.0, m * (1 - m) / max(v, 1e-12) - 1))
    bar = m + WATCHED * math.sqrt(m * (1 - m) / (k + 1))
    shrunken = (F.col("host_fails") + F.lit(k * m)) / (F.col("host_docs") + F.lit(k))
    return hosts.withColumn("host_rate", shrunken).withColumn(
        "host_verdict", F.when(F.col("host_rate") > max_host_rate, "rejected").when(F.col("host_rate") > bar, "watched").otherwise("trusted"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE,
                  keep_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with base statistics, host_rate, host_verdict and kept.

    The statistics are written once to the shared folder, as the host totals and
    the result both read them. The table of hosts is sent to all tasks when its
    files are below ``spark.sql.autoBroadcastJoinThreshold``, and else shuffled,
    where the skew join splits a hot host.
    """
    base = base_rules(docs, text)
    base = materialise(base if keep_text else base.drop(text), "quality")
    rates = host_rates(base.select(host, "base_failed", "symbols_failed"), host, max_host_rate)
    rates = rates.select(F.col("__host").alias("__h"), F.col("host_rate").alias("__rate"), F.col("host_verdict").alias("__verdict"))
    joined = base.join(rates, F.col(host).eqNullSafe(F.col("__h")), "left").withColumns({"host_rate": F.col("__rate"), "host_verdict": F.col("__verdict")})
    gone = F.col("base_failed") | (F.col("host_verdict") == "rejected") | (F.col("host_verdict") == "watched") & F.col("symbols_failed")
    return joined.withColumn("kept", ~gone).drop("__h", "__rate", "__verdict")


def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
ln AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM d),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) JOIN ln USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, 100 * n_symbols > 5 * word_chars AS symbols_failed FROM base),
h AS (SELECT source, count(*) AS n, sum((base_failed OR symbols_failed)::INT)::DOUBLE AS fails FROM f GROUP BY source),
p AS (SELECT avg(fails / n) AS m, var_pop(fails / n) AS v FROM h),
k AS (SELECT m, greatest(1.0, least(1000.0, m * (1 - m) / greatest(v, 1e-12) - 1)) AS k FROM p),
r AS (SELECT source, (fails + k * m) / (n + k) AS rate, m + 0.5 * sqrt(m * (1 - m) / (k + 1)) AS bar FROM h, k),
o AS (SELECT source, CASE WHEN rate > 0.8 THEN 'rejected' WHEN rate > bar THEN 'watched' ELSE 'trusted' END AS host_verdict FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR host_verdict = 'rejected' OR (host_verdict = 'watched' AND symbols_failed)) AS kept, host_verdict
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source
"""
