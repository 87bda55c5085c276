"""Line dedup [native]: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept per group.

Lines are normalised to their words (lower case, runs of letters, marks and digits;
each character of a script without spaces is a word). Equal lines of any
length are one line. Two different lines of MIN_WORDS words or more link when
one edit - a word put in, taken out or replaced - turns one into the other, which
is an edit similarity, 1 - edits / longer length, of at least 0.8 for the shortest
and 0.98 for 50 words. Of each connected group the first occurrence by
(doc_id, position) stays, and its other occurrences leave their documents,
wherever they are.

The SimHash is made for pigeonholes: each word belongs, by its hash, to one of
BLOCKS groups, and a block of the SimHash holds the majority bits of its own
group's words. An edit touches the groups of the word that goes and of the word
that comes, so lines that link agree in BLOCKS - 2 whole blocks and in the
numbers of words behind them. Joining on each choice of that many blocks loses
no link, whatever the length: recall is 1 by construction, and the tests compare
with edit distance alone over all pairs.

Lines that share a choice of blocks with few others are compared pair by pair,
on their words. Where many share one, and where a choice of blocks holds no words
at all, pairs would grow with the square of their number; those lines are
grouped by what is left when one word is taken out, or a gap is left, at each
place: lines link exactly if they agree in one of these, so a group of any size
takes work in proportion to its words. Groups are linked to their least
line, and the components of all links are the result.

With ``further``, as the query has it, all lines link whose edits number a fifth of the
longer line's words at most, an edit similarity of 0.8; only lines of ten words or
more have two edits to spare. After the links of one edit, lines meet by pairs of
neighbouring words at places that the edits allow (``pair_prefix`` and ``places_fit``, which lose no
link), and edit distance decides. Lines that are joined already are not compared again. Where many lines that are not alike
share a pair of words, pairs of sketches of 256 bits grow with the square of their
number, and the distance of two long lines takes time in the square of their words.

Defined cases: lines without letters or digits always stay; lines of fewer words
go only as equals of others; null texts stay null and empty ones empty; a
document all of whose lines leave stays as a row with empty text; rows that agree
in doc_id and text are one document and lose the same lines; null ids come
first; lines of any length take part whole, in time linear in their words; other
columns pass by, except those named like a result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, let, materialise, release, small, table

MIN_WORDS = 5
#: Lines whose edits number one in so many words of the longer are similar.
PER_EDIT = 5
#: Characters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Groups of words, bits of each one's SimHash, and blocks in which lines that link agree.
BLOCKS, BITS = 5, 12
AGREE = BLOCKS - 2
#: Lines that share a choice of blocks are compared pair by pair up to so many.
FEW = 8
#: Lines of fewer words are counted in lanes of BITS bits.
LANE_WORDS = 1 << (BITS - 2)
#: Sets of words in 256 bits, of lines that may have two edits.
SKETCH = ("b0", "b1", "b2", "b3")
#: Bits of a key that tell a pair's place in its line; places beyond are not told.
PLACES = 12
#: Characters that stand for words by their hashes, from U+10000 on.
LETTERS = 1 << 20


def words_of(line: Column) -> Column:
    """A line's normal form: its words in order."""
    # all of the scripts are above U+0E00, which is cheaper to ask
    apart = F.when((F.octet_length(line) > F.length(line)) & line.rlike(r"[\x{E00}-\x{10FFFF}]"),
                   F.regexp_replace(line, rf"(?<={UNSPACED})|(?={UNSPACED})", " ")).otherwise(line)
    return F.array_remove(F.split(F.lower(apart), r"[^\p{L}\p{M}\p{N}]+"), "")


def _row(docs: DataFrame, text: str) -> Column:
    """Names a document: a hash of its id and text."""
    return F.xxhash64(F.col("doc_id"), F.col(text))


def _lanes(bit: int, lanes: int = BLOCKS) -> int:
    """A number with this bit in each lane."""
    return sum(1 << (BITS * g + bit) for g in range(lanes))


#: What names a line: 128 bits of its normal form, and its number of words.
KEYS = ("k1", "k2", "n")
PLACE = ("doc_id", "row", "pos")


def _named(lines: DataFrame) -> DataFrame:
    """Rows (copy, doc_id, row, pos, w) with k1, k2 and n; apart from what follows, which would else hash a line for each word."""
    return lines.select("copy", *PLACE, F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), F.col("w")).alias("k2"), F.size("w").alias("n"), "w")


def _sketched() -> list[Column]:
    """Sums for SKETCH over hashes ``h`` of words."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    return [F.bit_or(F.when(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(3)) == j, one).otherwise(F.lit(0).cast("long"))).alias(b) for j, b in enumerate(SKETCH)]


def _hashed(lines: DataFrame, further: bool = False) -> DataFrame:
    """Rows (copy, doc_id, row, pos, w) with words as (doc_id, row, pos, k1, k2, n, sim, counts), and SKETCH if ``further``.

    Lane g of sum b counts the ones in bit b over the hashes of group g's words,
    lane g of ``counts`` the words; lines that are too short or too long for
    lanes have neither. ``copy`` tells documents apart that agree in id and text.
    """
    counted = (F.col("n") >= MIN_WORDS) & (F.col("n") < LANE_WORDS)
    x = _named(lines).select("copy", *PLACE, *KEYS, F.explode_outer(F.when(counted, F.col("w"))).alias("w"))
    x = x.withColumn("h", F.when(F.col("w").isNotNull(), F.xxhash64("w"))).drop("w")
    group = F.pmod(F.col("h"), F.lit(BLOCKS))
    unit = F.lit(1 << BITS * (BLOCKS - 1)).cast("long")
    for g in range(BLOCKS - 2, -1, -1):
        unit = F.when(group == g, F.lit(1 << BITS * g).cast("long")).otherwise(unit)
    x = x.withColumn("unit", F.when(F.col("h").isNotNull(), unit))
    # bits above those that tell the group
    ones = [F.sum((F.shiftrightunsigned("h", 8 + b).bitwiseAND(F.lit(1))) * F.col("unit")).alias(f"s{b}") for b in range(BITS)]
    # n by its maximum, as Spark would take a filter on a key to the lines and find their words twice
    x = x.groupBy("copy", *PLACE, "k1", "k2").agg(
        F.max("n").alias("n"), F.sum("unit").alias("counts"), *ones, *(_sketched() if further else [])).where("n > 0")
    # in every lane at once: a count above half of the lane's words carries into the lane's last bit but one
    half = F.shiftrightunsigned("counts", 1).bitwiseAND(F.lit(sum(_lanes(b) for b in range(BITS - 1))))
    carry = F.lit(sum(_lanes(b) for b in range(BITS - 2))) - half
    sim = F.lit(0).cast("long")
    for b in range(BITS):
        sim = sim.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"s{b}") + carry, BITS - 2).bitwiseAND(F.lit(_lanes(0))), b))
    return x.select(*PLACE, *KEYS, sim.alias("sim"), "counts", *(SKETCH if further else []))


def _hashed_long(lines: DataFrame, further: bool = False) -> DataFrame:
    """The same for lines of any length, a sum for each bit; counts are modulo their lanes."""
    x = _named(lines).select("copy", *PLACE, *KEYS, F.explode("w").alias("w"))
    x = x.withColumn("h", F.xxhash64("w")).withColumn("g", F.pmod(F.col("h"), F.lit(BLOCKS))).drop("w")
    bit = lambda b: F.shiftrightunsigned("h", 8 + b).bitwiseAND(F.lit(1))
    x = x.groupBy("copy", *PLACE, "k1", "k2").agg(
        F.max("n").alias("n"), *[F.sum((F.col("g") == g).cast("long")).alias(f"c{g}") for g in range(BLOCKS)],
        *[F.sum(F.when(F.col("g") == g, bit(b)).otherwise(0)).alias(f"s{g}_{b}") for g in range(BLOCKS) for b in range(BITS)],
        *(_sketched() if further else []))
    sim, counts = F.lit(0).cast("long"), F.lit(0).cast("long")
    for g in range(BLOCKS):
        counts = counts.bitwiseOR(F.shiftleft(F.col(f"c{g}").bitwiseAND(F.lit((1 << BITS) - 1)), BITS * g))
        for b in range(BITS):
            sim = sim.bitwiseOR(F.shiftleft((2 * F.col(f"s{g}_{b}") > F.col(f"c{g}")).cast("long"), BITS * g + b))
    return x.select(*PLACE, *KEYS, sim.alias("sim"), counts.alias("counts"), *(SKETCH if further else []))


def occurrences(docs: DataFrame, text: str = "text", further: bool = False) -> DataFrame:
    """One row for each line with words: doc_id, row, pos, the 128-bit key (k1, k2) of its normal form, n words, sim, counts; SKETCH if ``further``.

    Lines that are too long for lanes are few; they are read again, by the
    names of their documents.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("copy"), "doc_id", _row(docs, text).alias("row"), F.col(text).alias("t"))
    place = ["copy", "doc_id", "row"]
    x = docs.select(*place, F.posexplode_outer(F.split("t", "\n")).alias("pos", "line")).select(*place, "pos", words_of(F.col("line")).alias("w"))
    x = materialise(_hashed(x, further), "lines")
    long = materialise(x.where(F.col("n") >= LANE_WORDS).select(F.col("row").alias("r"), F.col("pos").alias("p")).distinct(), "long")
    if long.isEmpty():
        return x
    rows = small(materialise(long.select("r").distinct(), "rows"))
    y = docs.join(rows, F.col("row") == F.col("r"), "left_semi").select(*place, F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    y = y.join(small(long), (F.col("row") == F.col("r")) & (F.col("pos") == F.col("p")), "left_semi")
    y = _hashed_long(y.select(*place, "pos", words_of(F.col("line")).alias("w")), further)
    return x.where(F.col("n") < LANE_WORDS).unionByName(materialise(y, "lines"))


def _masks() -> list[int]:
    """Bits of every choice of AGREE blocks."""
    block = [sum(1 << (BITS * g + b) for b in range(BITS)) for g in range(BLOCKS)]
    return [sum(c) for c in combinations(block, AGREE)]


def _keyed(lines: DataFrame) -> DataFrame:
    """Rows (sid) with a key for each choice of blocks, null where no word is behind it.

    The table is narrow and few tasks would read it; it is dealt out first, as
    each row becomes many.
    """
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid")
    part = lambda c, m: F.col(c).bitwiseAND(F.lit(m))
    key = lambda i, m: F.when(part("counts", m) != 0, F.xxhash64(F.lit(i), part("sim", m), part("counts", m)))
    return lines.select("sid", F.explode(F.array(*[key(i, m) for i, m in enumerate(_masks())])).alias("key"))


def bucketed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of lines (sid, n, sim, counts) that few share a choice of blocks with, and the lines (sid) of which many do."""
    keyed = _keyed(lines)
    met = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("a"), F.max("sid").alias("b")).where("c > 1")
    met = materialise(met, "met")
    more = materialise(keyed.join(small(materialise(met.where("c > 2").select(F.col("key").alias("k"), "c"), "more")), F.col("key") == F.col("k")).select("key", "sid", "c"), "members")
    few = more.where(F.col("c") <= FEW)
    p, q = (few.select("key", F.col("sid").alias(s)) for s in "ab")
    pairs = met.where("c = 2").select("a", "b").unionByName(p.join(q, "key").where("a < b").select("a", "b")).distinct()
    # an edit changes the number of words by one at most
    a, b = (lines.select(F.col("sid").alias(s), F.col("n").alias(f"{s}_n")) for s in "ab")
    pairs = pairs.join(a, "a").join(b, "b").where(F.abs(F.col("a_n") - F.col("b_n")) <= 1).select("a", "b")
    empty = [F.col("counts").bitwiseAND(F.lit(m)) == 0 for m in _masks()]
    open_ = lines.where(F.greatest(*empty)).select("sid").union(more.where(F.col("c") > FEW).select("sid")).distinct()
    return materialise(pairs, "pairs"), materialise(open_, "open")


def _words(ids: DataFrame, seen: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows (sid, w) of the words of these lines, from the first documents that hold them."""
    wanted = small(materialise(seen.join(small(ids), "sid").select("sid", F.col("first.row").alias("r"), F.col("first.pos").alias("p")), "wanted"))
    rows = small(materialise(wanted.select("r").distinct(), "rows"))
    x = docs.select(_row(docs, text).alias("row"), F.col(text).alias("t")).join(rows, F.col("row") == F.col("r"), "left_semi")
    x = x.select("row", F.posexplode(F.split("t", "\n")).alias("pos", "line")).join(wanted, (F.col("row") == F.col("r")) & (F.col("pos") == F.col("p")))
    # rows that agree in id and text hold the line several times
    return materialise(x.select("sid", "line").groupBy("sid").agg(F.first("line").alias("line")).select("sid", words_of(F.col("line")).alias("w")), "words")


def one_edit(a: Column, b: Column) -> Column:
    """Whether a word put in, taken out or replaced makes these words those, on the words themselves."""
    def replaced(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) == 1

    def put_in(a: Column, b: Column) -> Column:
        # slice counts from 1, and place 0 says that they never differ
        differ = F.zip_with(a, F.slice(b, 1, F.size(a)), lambda x, y: x != y)
        return let(F.array_position(differ, True).cast("int"), lambda k: F.when(k == 0, True).otherwise(
            F.slice(a, F.greatest(k, F.lit(1)), F.size(a)) == F.slice(b, F.greatest(k, F.lit(1)) + 1, F.size(b))))

    longer = F.size(b) - F.size(a)
    return F.when(longer == 0, replaced(a, b)).when(longer == 1, put_in(a, b)).when(longer == -1, put_in(b, a)).otherwise(False)


def _compared(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that link."""
    l, r = (words.select(F.col("sid").alias(x), F.col("w").alias(f"{x}_w")) for x in "ab")
    return materialise(pairs.join(l, "a").join(r, "b").where(one_edit(F.col("a_w"), F.col("b_w"))).select("a", "b"), "links")


def _grouped(words: DataFrame) -> DataFrame:
    """Links (a, b) that join all lines of ``words`` that are one edit apart, without comparing pairs.

    What stands before and after each place is named by exclusive ors of hashes of
    words and their distances from the line's begin and end. Lines of which one
    word is replaced agree when that is taken out; a line that lacks a word agrees, with a
    gap there, with the one that has it when it is taken out there.
    """
    x = words.select("sid", F.size("w").alias("n"), F.posexplode("w").alias("at", "w"))
    x = x.select("sid", "n", "at", F.xxhash64(F.lit(0), F.col("at"), F.col("w")).alias("ahead"), F.xxhash64(F.lit(1), F.col("n") - F.col("at"), F.col("w")).alias("behind"))
    so_far = Window.partitionBy("sid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"head": F.bit_xor("ahead").over(so_far), "tail": F.bit_xor("behind").over(so_far), "all": F.bit_xor("behind").over(Window.partitionBy("sid"))})
    before, after = F.col("head").bitwiseXOR(F.col("ahead")), F.col("all").bitwiseXOR(F.col("tail"))
    since = after.bitwiseXOR(F.col("behind"))

    def names(size: Column, at: Column, before: Column, after: Column) -> Column:
        return F.struct(F.xxhash64(size, at, before, after).alias("x"), F.xxhash64(F.lit(1), size, at, before, after).alias("y"))

    end = F.when(F.col("at") == F.col("n") - 1, names(F.col("n"), F.col("n"), F.col("head"), F.lit(0).cast("long")))
    kinds = F.array(names(F.col("n") - 1, F.col("at"), before, after), names(F.col("n"), F.col("at"), before, since), end)
    x = x.select("sid", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("sid", "k.x", "k.y")
    hubs = x.groupBy("x", "y").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z").select("x", "y", "a")
    links = x.join(small(materialise(hubs, "hubs")), ["x", "y"]).where("sid <> a")
    return materialise(links.select("a", F.col("sid").alias("b")).distinct(), "links")


def pair_prefix(w: Column) -> Column:
    """The first pairs of neighbouring words in one order of all pairs, with their places, as many as lines that are similar need to share one.

    A word that goes or is replaced undoes two of a line's pairs, one that comes undoes one.
    Of n words with d put in more than taken out, edits number (n + d) // 5 at most and
    undo 2 * ((n + d) // 5) - d pairs at most: 2 * (n // 5), or one more if n is 4 above a multiple of 5.
    The least (pair, place) that no edit undoes has only undone ones before it, in both
    lines, so it is among the first of both, and the places are those that the edits
    match. Long words, which are rarer, come first. Of a number the last PLACES bits are the place.
    """
    def pair(x: Column, i: Column) -> Column:
        y = F.get(w, i + 1)
        first = F.lit(63).cast("long") - F.least(F.lit(63), F.octet_length(x) + F.octet_length(y))
        name = F.xxhash64(x, y).bitwiseAND(F.lit(((1 << 57) - 1) >> PLACES << PLACES))
        at = F.least(i, F.lit((1 << PLACES) - 1)).cast("long")
        # the last word has no next one; without nulls Spark sorts plain numbers
        return F.coalesce(F.shiftleft(first, 57).bitwiseOR(name).bitwiseOR(at), F.lit(0).cast("long"))

    n = F.size(w)
    pairs = F.slice(F.transform(w, pair), 1, n - 1)
    return F.slice(F.sort_array(pairs), 1, 2 * F.floor(n / PER_EDIT).cast("int") + F.when(n % PER_EDIT == PER_EDIT - 1, 2).otherwise(1))


def similar(a: Column, b: Column) -> Column:
    """Whether edits, of words, number a fifth of the longer line's words at most: an edit similarity of 0.8."""
    most = F.floor(F.greatest(F.size(a), F.size(b)) / PER_EDIT).cast("int")
    # each word that the other line lacks takes an edit
    near = (F.abs(F.size(a) - F.size(b)) <= most) & (F.size(F.array_except(a, b)) <= most) & (F.size(F.array_except(b, a)) <= most)
    # a character for each word: by its hash, where these are different, else its first place in ``a``, or 0; places skip the surrogates
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(LETTERS)) + 0x10000
    place = lambda x: let(F.array_position(a, x) + 1, lambda p: F.when(p >= 0xD800, p + 0x800).otherwise(p))
    apart = let(F.array_distinct(F.concat(a, b)), lambda u: F.size(u) == F.size(F.array_distinct(F.transform(u, hashed))))

    def within(letter) -> Column:
        letters = lambda w: F.decode(F.unhex(F.array_join(F.transform(w, lambda x: F.lpad(F.hex(letter(x)), 8, "0")), "")), "UTF-32")
        return F.call_function("levenshtein", letters(a), letters(b), most) >= 0

    return F.when(near, F.when(apart, within(hashed)).otherwise(within(place))).otherwise(False)


def _id(k1: Column, n: Column) -> Column:
    """Names a line while its pairs are dealt out: 52 bits of k1 and its number of words, 4095 for more."""
    return F.shiftleft(k1, 12).bitwiseOR(F.least(n, F.lit(4095)).cast("long"))


def _lengths_fit(a: Column, b: Column) -> Column:
    """Whether lines of so many words can be similar: each word too many takes an edit."""
    return F.abs(a - b) <= F.floor(F.greatest(a, b) / PER_EDIT)


def places_fit(a: str, b: str) -> Column:
    """Whether lines of ``m`` words with a pair of words at a place from ``p0`` to ``p1`` can be similar by it.

    Words too many before the pair and words too many behind it take an edit each.
    Lines whose numbers or places are not told in PLACES bits pass.
    """
    m, p0, p1 = ((F.col(f"{a}_{c}"), F.col(f"{b}_{c}")) for c in ("m", "p0", "p1"))
    apart = lambda x0, x1, y0, y1: F.greatest(F.lit(0), y0 - x1, x0 - y1)
    before = apart(p0[0], p1[0], p0[1], p1[1])
    behind = apart(m[0] - p1[0], m[0] - p0[0], m[1] - p1[1], m[1] - p0[1])
    longer = F.greatest(*m)
    return _lengths_fit(*m) & ((longer >= (1 << PLACES) - 1) | (before + behind <= F.floor(longer / PER_EDIT)))


def _sharing(docs: DataFrame, text: str) -> DataFrame:
    """Rows (key, id, p0, p1) of lines that share a pair of ``pair_prefix`` with another, and may be like it by its places if only two do.

    Pairs are dealt out once: what only one line holds goes where it arrives, and
    what several hold is looked up in the same shuffle. Lines are read from the
    documents, as their words would take as much room as the texts.
    """
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).select(words_of(F.col("line")).alias("w"))
    lines = lines.select(_id(F.xxhash64("w"), F.size("w")).alias("id"), F.when(F.size("w") >= 2 * PER_EDIT - 2, pair_prefix(F.col("w"))).alias("keys"))
    # outer, as Spark would take its filter on the keys to the lines and find them twice
    dealt = lines.select("id", F.explode_outer("keys").alias("at")).where("at IS NOT NULL")
    key = F.shiftrightunsigned("at", PLACES)
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key.alias("key")).withColumn("key", key)
    low = lambda c, bits: F.col(c).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    place, behind = low("at", PLACES), low("id", 12) - low("at", PLACES)
    met = dealt.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("c"),
                                   (F.max(place) - F.min(place) + F.max(behind) - F.min(behind)).alias("apart")).where("lo <> hi")
    longer = F.greatest(low("lo", 12), low("hi", 12))
    fit = _lengths_fit(low("lo", 12), low("hi", 12)) & ((longer >= (1 << PLACES) - 1) | (F.col("apart") <= F.floor(longer / PER_EDIT)))
    met = met.where((F.col("c") > 2) | fit).select(F.col("key").alias("k"))
    x = dealt.join(met.hint("shuffle_hash"), F.col("key") == F.col("k"))
    return materialise(x.groupBy("key", "id").agg(F.min(place).alias("p0"), F.max(place).alias("p1")), "sharing")


def _further(links: DataFrame, seen: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links (a, b) of lines of two edits or more that no links so far join; see ``similar``.

    Lines that share a pair of ``pair_prefix`` with others are compared with the
    least of those first. Where many share one, most are like it; all pairs of the
    rest, those that are not yet joined, follow. Words are fetched for pairs that
    differ in no more of 256 bits of their words than edits allow.
    """
    spark = docs.sparkSession
    sharing = _sharing(docs, text)
    release(spark)
    names = seen.where(F.col("n") >= 2 * PER_EDIT - 2).select(_id(F.col("k1"), F.col("n")).alias("id"), "sid", F.col("n").alias("m"))
    shared = materialise(sharing.join(names, "id").select("key", "sid", "m", "p0", "p1"), "shared")
    discard(sharing)
    least = [F.min_by(c, "sid").alias(f"hub_{c}") for c in ("m", "p0", "p1")]
    hubs = shared.groupBy("key").agg(F.min("sid").alias("hub"), *least, F.count(F.lit(1)).alias("c"))
    x = shared.join(hubs, "key").where("sid <> hub").withColumnsRenamed({c: f"own_{c}" for c in ("m", "p0", "p1")})
    first = materialise(x.where(places_fit("own", "hub")).select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct(), "first")
    members = materialise(x.where("c > 2").select("key", "sid", F.col("own_p0").alias("p0"), F.col("own_p1").alias("p1")), "members")
    discard(shared)
    sketches = seen.where(F.col("n") >= 2 * PER_EDIT - 2).select("sid", F.col("n").alias("m"), *SKETCH)

    def rooted(links: DataFrame) -> DataFrame:
        roots = components(links).select(F.col("node").alias("of"), "root")
        return sketches.join(small(materialise(roots, "roots")), F.col("sid") == F.col("of"), "left").drop("of").withColumn("root", F.coalesce("root", "sid"))

    def side(x: DataFrame, s: str, *more: str) -> DataFrame:
        return x.select(*[F.col(c).alias(f"{s}_{c}") for c in ("sid", "m", "root", *SKETCH, *more)])

    def linked(pairs: DataFrame) -> DataFrame:
        most = F.floor(F.greatest("a_m", "b_m") / PER_EDIT)
        lacks = lambda s, t: sum(F.bit_count(F.col(f"{s}_{b}").bitwiseAND(F.bitwise_not(F.col(f"{t}_{b}")))) for b in SKETCH)
        pairs = pairs.where((F.col("a_root") != F.col("b_root")) & _lengths_fit(F.col("a_m"), F.col("b_m")) & (lacks("a", "b") <= most) & (lacks("b", "a") <= most))
        pairs = materialise(pairs.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct(), "near")
        release(spark)
        ids = materialise(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "ids")
        words = _words(ids, seen, docs, text)
        # few rows, each of much work
        pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        l, r = (words.select(F.col("sid").alias(x), F.col("w").alias(f"{x}_w")) for x in "ab")
        return materialise(pairs.join(l, "a").join(r, "b").where(similar(F.col("a_w"), F.col("b_w"))).select("a", "b"), "links")

    lines = materialise(rooted(links), "lines")
    links = links.unionByName(linked(first.join(side(lines, "a"), F.col("a") == F.col("a_sid")).join(side(lines, "b"), F.col("b") == F.col("b_sid"))))
    discard(lines, first)
    lines = materialise(rooted(links), "lines")
    x = members.join(lines.select("sid", "root"), "sid")
    # keys whose lines are all joined need no more
    several = materialise(x.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "several")
    x = materialise(members.join(small(several), "key", "left_semi").join(lines, "sid"), "alike")
    discard(members)
    # both sides in one shuffle
    a, b = side(x, "a", "key", "p0", "p1"), side(x, "b", "key", "p0", "p1")
    pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_sid") < F.col("b_sid")) & (F.col("a_root") != F.col("b_root")) & places_fit("a", "b"))
    links = links.unionByName(linked(pairs))
    discard(x, lines)
    return links


def groups(occ: DataFrame, docs: DataFrame, text: str = "text", further: bool = False) -> DataFrame:
    """For each line that occurs again or has a link: k1, k2 and the (row, pos) that its group keeps."""
    first = F.min(F.struct(*PLACE)).alias("first")
    seen = occ.groupBy(*KEYS).agg(first, F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("sim", "counts", *(SKETCH if further else []))])
    # written, so that its numbers stay
    seen = materialise(seen.withColumn("sid", F.monotonically_increasing_id()), "seen")
    pairs, open_ = bucketed(seen.where(F.col("n") >= MIN_WORDS).select("sid", "n", "sim", "counts"))
    release(docs.sparkSession)
    ids = materialise(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(open_).distinct(), "ids")
    words = _words(ids, seen, docs, text)
    links = _compared(pairs, words).unionByName(_grouped(words.join(small(open_), "sid", "left_semi")))
    if further:
        links = _further(links, seen, docs, text)
    roots = components(links).select(F.col("node").alias("sid"), "root")
    release(docs.sparkSession)
    known = materialise(seen.join(small(roots), "sid", "left").where("times > 1 OR root IS NOT NULL").select("k1", "k2", "first", "root"), "known")
    kept = small(materialise(known.where("root IS NOT NULL").groupBy(F.col("root").alias("of")).agg(F.min("first").alias("group_first")), "kept"))
    return known.join(kept, F.col("root") == F.col("of"), "left").select("k1", "k2", F.coalesce("group_first", "first").alias("keep")).select(
        "k1", "k2", F.col("keep.row").alias("keep_row"), F.col("keep.pos").alias("keep_pos"))


def dedup_lines(docs: DataFrame, text: str = "text", further: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of ``text``, and lines_in and lines_out.

    With ``further``, lines of an edit similarity of 0.8 link, else only those of one edit.
    """
    spark = docs.sparkSession
    docs = docs.drop("lines_in", "lines_out")
    occ = occurrences(docs, text, further)
    release(spark)
    found = materialise(groups(occ, docs, text, further), "groups")
    gone = occ.select("row", "pos", "k1", "k2").join(found, ["k1", "k2"]).where("row <> keep_row OR pos <> keep_pos")
    # at most one position for each line of a document
    gone = small(materialise(gone.groupBy(F.col("row").alias("__r")).agg(F.collect_set("pos").alias("__gone")), "gone"))
    release(spark)
    x = docs.withColumn("__row", _row(docs, text)).join(gone, F.col("__row") == F.col("__r"), "left")
    split = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    kept = let(split, lambda parts: F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n_gone = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    return x.withColumns({"lines_in": n, "lines_out": n - n_gone, text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)}).select(
        *docs.columns, "lines_in", "lines_out")


def op8_fuzzy_lines(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), further=True)
    return out.select("doc_id", "lines_in", "lines_out", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
