"""N-gram Jaccard join: a count-vector R-tree bounds overlaps, surviving pairs are verified exactly.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Hashed
into groups, a set becomes a point of group counts, and the overlap of two sets
is at most the sum of their coordinates' minima. A point has about half as many
groups as its set has shingles, so that unlike sets have a low bound whatever
their size; groups are the leading bits of a hash, so two neighbouring groups
together are one of the next coarser point. Two documents link when 100 * overlap >= 80 *
union, which is decided on the sets themselves.

How the index is spread over a cluster without losing a link:

* Equal sets are one class; only classes go on.
* A pair that links must agree in one of the first n - ceil(0.8 n) + 1 shingles
  of either set, in any order that is the same for all sets. Each such shingle
  names a shard, and a set's point goes to the shards of its prefix. The order
  puts frequent groups of shingles last, so what many documents share rarely
  names a shard. The frequent groups are a bounded table and affect speed only.
* Shards with one class end there, and of shards with the same classes one goes
  on. Each class is first compared with one hub, the class that leads most of its
  shards; large groups of near
  copies become one component by a number of comparisons in proportion to it.
* Shards whose classes still lie in different components are indexed, without
  the classes that have none of a fitting size beside them: R-trees over their
  points (upper corners of group counts, ranges of set sizes), one for each
  number of groups, yield for each point the others that its bound admits, best
  first. These pairs are verified in turns - each point's best, its best few, all
  - and what has become one component meanwhile is not compared again. Large
  shards are cut into blocks, and each pair of blocks is a task of its own.

All counts cover all rows, nothing is capped or sampled; what the result needs
are the components, so pairs inside one component need no comparison.

Defined cases: null and empty texts, and texts without words, have an empty set
and link with nothing; texts of fewer than five words are one shingle; repeated
rows are equal sets; a null doc_id is never the smallest unless all are null;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, components, materialise, release, small, table

WORDS, PERCENT = 5, 80
#: The least and the most bits of a group's number.
BITS = (6, 14)
#: Groups of shingles that are counted to find frequent ones, and the counts in one task from which a group is frequent.
COUNTED, FREQUENT = 1 << 22, 16
#: Frequent groups that the order knows, at most: it decides which shards are used, never which links are found.
KNOWN = 1 << 18
#: Parts of a frequent shard; points in a block of a shard; points in a leaf of the tree; members compared with a copy of their hub.
SALTS, BLOCK, LEAF, MEMBERS = 32, 1024, 32, 200
#: Candidates of a point in a shard that are verified in each turn, best first; the last takes all.
TURNS = (1, 8, 1 << 62)
#: Rows of shards in a unit of them.
UNIT = 2000
#: Sets whose keys, or pairs, a task has sent already (each is sent once, until so many are held).
SENT = 1 << 20
#: Texts, and points, in a batch that goes to a Python worker.
TEXTS, POINTS = 500, 2000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    total = h[:n - WORDS + 1] * _MULTIPLIERS[0]
    for k in range(1, WORDS):
        total = total + h[k:n - WORDS + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mixed(total))


def name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return a, b


def point(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in each group: the bits of a group's number and the bytes of a count, then the counts."""
    bits = min(BITS[1], max(BITS[0], len(s).bit_length() - 1))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    width = 1 if counts.max(initial=0) < 256 else 4
    return bytes([bits, width]) + counts.astype(f"<u{width}").tobytes()


def counts_of(p: bytes) -> np.ndarray:
    return np.frombuffer(p, f"<u{p[1]}", offset=2)


def coarser(points: np.ndarray) -> np.ndarray:
    """Points in half as many groups, as 32-bit numbers."""
    return points[..., ::2].astype(np.uint32) + points[..., 1::2]


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the coordinates' minima of points, row by row; both have the same groups."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def bound(a: bytes, b: bytes) -> int:
    """The bound of two points, in the groups of the coarser one."""
    x, y = counts_of(a), counts_of(b)
    while len(x) != len(y):
        x, y = (coarser(v) if len(v) > min(len(x), len(y)) else v for v in (x, y))
    return int(bounds(x, y))


def needed(a, b):
    """The least overlap of sets of these sizes that link: 100 x >= 80 (a + b - x)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that name a set's shards, and which of them are frequent."""
    size = len(s) - -(-PERCENT * len(s) // 100) + 1
    group = (s >> np.uint64(42)).astype(np.int64)
    at = np.searchsorted(frequent, group)
    rank = np.where(frequent.take(np.minimum(at, len(frequent) - 1)) == group, counts.take(np.minimum(at, len(frequent) - 1)), 0) if len(frequent) else np.zeros(len(s), np.int64)
    chosen = np.lexsort((s, rank))[:size] if rank.any() else np.arange(size)
    return s[chosen], rank[chosen] > 0


def _points(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text hash, size, name, point) and for each frequent group of a task."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "n", "s1", "s2", "point"]
        counted, seen = np.zeros(COUNTED, np.uint32), 0
        for b in batches:
            ids, row, texts = b.columns
            out = []
            for t in texts:
                s = shingles(t.as_py())
                np.add.at(counted, (s >> np.uint64(42)).astype(np.int64), 1)
                seen += len(s)
                out.append((len(s), *name(s), point(s) if len(s) else None))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([ids, row, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)
        often = np.flatnonzero(counted >= FREQUENT + 4 * seen // COUNTED)
        none = pa.nulls(len(often), pa.int64())
        # a negative size marks a group and its count
        yield pa.RecordBatch.from_arrays([none, none, pa.array(-counted[often].astype(np.int64)), pa.array(often), none, pa.nulls(len(often), pa.binary())], names=names)

    return docs.mapInArrow(of, "doc_id bigint, row bigint, n bigint, s1 bigint, s2 bigint, point binary")


def _keys(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Rows (key, salt, s1) of the prefix of each set; frequent keys are dealt out by salt."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))  # at most KNOWN pairs

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        done: set[tuple[int, int]] = set()
        for b in batches:
            keys, hot, owner, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                key, is_hot, s1 = np.concatenate(keys).view(np.int64), np.concatenate(hot), np.concatenate(owner)
                return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.where(is_hot, s1 % SALTS, -1).astype(np.int32)), pa.array(s1)], names=["key", "salt", "s1"])

            for t in b.column(0):
                s = shingles(t.as_py())
                if not len(s) or (named := name(s)) in done:
                    continue
                if len(done) >= SENT:
                    done.clear()
                done.add(named)
                k, h = prefix(s, frequent, counts)
                keys.append(k)
                hot.append(h)
                owner.append(np.full(len(k), named[0]))
                held += len(k)
                if held > 100_000:
                    yield flush()
                    keys, hot, owner, held = [], [], [], 0
            if held:
                yield flush()

    return docs.select("text").mapInArrow(of, "key bigint, salt int, s1 bigint")


def _shared(keys: DataFrame) -> DataFrame:
    """Of rows sorted by (key, salt, s1) those of shards with two classes or more, or frequent, with the shard's first class."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, salt, s1, hub, whether the hub's row is out
        for b in batches:
            k, a, s = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(k):
                continue
            new = np.ones(len(k), bool)  # begins a shard
            new[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1])
            same = np.zeros(len(k), bool)  # repeats the row before
            same[1:] = ~new[1:] & (s[1:] == s[:-1])
            if last and k[0] == last[0] and a[0] == last[1]:
                new[0], same[0] = False, s[0] == last[2]
                hub0, out0 = last[3], last[4]
            else:
                hub0, out0 = s[0], False
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            hub = np.where(start < 0, hub0, s[np.maximum(start, 0)])
            member = ~new & ~same
            # a cold shard's hub is sent with its second class, a frequent one's at once
            first_member = np.flatnonzero(member)
            group = start[first_member]
            lead = np.ones(len(first_member), bool)
            lead[1:] = group[1:] != group[:-1]
            lead &= (a[first_member] < 0) & ~((group < 0) & out0)
            extra = np.concatenate([first_member[lead], np.flatnonzero(new & (a >= 0))])
            rows = np.concatenate([k[member], k[extra]]), np.concatenate([s[member], hub[extra]]), np.concatenate([hub[member], hub[extra]]), np.concatenate([a[member], a[extra]])
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:3], rows[3] >= 0)], names=["key", "s1", "hub", "hot"])
            tail = start[-1]
            out = bool(a[-1] >= 0 or member[max(tail, 0):].any() or tail < 0 and out0)
            last = (k[-1], a[-1], s[-1], hub[-1], out)

    return keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "s1").mapInArrow(of, "key bigint, s1 bigint, hub bigint, hot boolean")


def _told_apart(shared: DataFrame) -> DataFrame:
    """Shards with the same classes hold the same pairs, as all shingles of a shared passage do: one of each kind stays.

    Kinds are told by 128 bits and a count, whatever the order of the classes.
    """
    bits = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("s1")))
    kinds = shared.groupBy("key").agg(bits(1).alias("x"), bits(2).alias("y"), F.count(F.lit(1)).alias("c"))
    kept = small(materialise(kinds.groupBy("x", "y", "c").agg(F.min("key").alias("key")).select("key"), "kinds"))
    return materialise(shared.join(kept, "key", "left_semi"), "shared")


def admitted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose points may overlap enough: unlike texts end here, whatever their length."""
    ids = small(materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids"))
    found = materialise(classes.join(ids, F.col("sid") == F.col("id"), "left_semi").select("sid", "n", "point"), "asked")
    p, q = (found.select(F.col("sid").alias(x), F.col("n").alias(f"{x}_n"), F.col("point").alias(f"{x}_point")) for x in "ab")
    fits = (100 * F.least("a_n", "b_n")) >= PERCENT * F.greatest("a_n", "b_n")
    rows = pairs.join(p, "a").join(q, "b").where(fits).select("a", "b", "a_n", "b_n", "a_point", "b_point")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            least = needed(n, m).tolist()
            fit = [bound(x.as_py(), y.as_py()) >= k for x, y, k in zip(batch.column(4), batch.column(5), least, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return rows.mapInArrow(of, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes those that link, decided on their sets.

    ``b`` leads: its text is sent once for each MEMBERS of its partners, theirs
    once for each pair, and the tasks read them leader first. Only texts that
    pairs ask for are moved: the requests go to the documents' tasks when they
    are few, and else meet them in a shuffled join.
    """
    parts = materialise(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")), "parts")
    members = pairs.join(parts, "b").select("b", F.pmod(F.hash("a"), "parts").alias("part"), F.lit(1).alias("role"), F.col("a").alias("sid"))
    leaders = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("b").alias("sid"))
    requests = members.unionByName(leaders).join(classes.select("sid", F.col("doc_id").alias("d"), F.col("row").alias("r")), "sid")
    requests = small(materialise(requests, "requests"))
    rows = docs.join(requests, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select("b", "part", "role", "sid", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            found = []
            for b, part, role, sid, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                s = shingles(text.as_py())
                if role == 0:
                    leader, own = (b, part), s
                elif leader == (b, part) and len(np.intersect1d(own, s, assume_unique=True)) >= needed(len(own), len(s)):
                    found.append((sid, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "role", "sid")
    return rows.mapInArrow(of, "a bigint, b bigint")


class RTree:
    """Points of group counts, packed by size and by their heaviest coordinate, under upper corners and size ranges."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        n = len(points)
        starts = np.arange(0, n, LEAF)
        self.levels = []
        upper = np.maximum.reduceat(self.points, starts)
        low, high = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
        self.levels.append((upper, low, high))
        while len(upper) > LEAF:
            at = np.arange(0, len(upper), LEAF)
            upper, low, high = np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((upper, low, high))

    def near(self, p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which points a set of this point and size may link with, and the bounds."""
        nodes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[k]
            nodes = nodes[(nodes < len(upper))]
            fits = (high[nodes] * 100 >= PERCENT * size) & (low[nodes] * PERCENT <= 100 * size)
            nodes = nodes[fits]
            # the least a member of the node must share, against the most it can
            nodes = nodes[bounds(upper[nodes], p) >= needed(size, low[nodes])]
            if k:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = at[at < len(self.points)]
        most = bounds(self.points[at], p)
        keep = most >= needed(size, self.sizes[at])
        return self.order[at[keep]], most[keep]


class Shard:
    """Classes of a shard, or of two of its blocks, with R-trees of the points of each number of groups."""

    def __init__(self, sid: np.ndarray, root: np.ndarray, side: np.ndarray, sizes: np.ndarray, points: list[bytes]):
        self.sid, self.root, self.side, self.sizes = sid, root, side, sizes
        self.crossing = side.min() != side.max()
        bits = np.fromiter((p[0] for p in points), np.int64, len(points))
        self.levels = {}
        for b in np.unique(bits):
            at = np.flatnonzero(bits == b)
            counts = np.stack([counts_of(points[k]) for k in at])
            self.levels[int(b)] = at, counts, RTree(counts, sizes[at])

    def candidates(self, best: int) -> list[tuple[int, int]]:
        """Of the pairs that the bound admits, of different components, the best of each point.

        A point meets those with as many groups and those with half as many; one
        with twice as many meets it. Sets that link differ less in size than that.
        """
        out = []
        for b, (own, counts, tree) in self.levels.items():
            below = self.levels.get(b - 1)
            half = coarser(counts) if below else counts
            for k, i in enumerate(own):
                near, most = tree.near(counts[k], int(self.sizes[i]))
                near = own[near]
                if below:
                    more, most_of = below[2].near(half[k], int(self.sizes[i]))
                    near, most = np.concatenate([near, below[0][more]]), np.concatenate([most, most_of])
                keep = self.root[near] != self.root[i]
                if self.crossing:
                    keep &= self.side[near] != self.side[i]
                near, most = near[keep], most[keep]
                a = int(self.sid[i])
                out += [(min(a, j), max(a, j)) for j in self.sid[near[np.lexsort((self.sid[near], -most))][:best]].tolist()]
        return out


def close_pairs(which: np.ndarray, sid: np.ndarray, root: np.ndarray, n: np.ndarray, points: list[bytes], best: int) -> set[tuple[int, int]]:
    """The same for many shards of at most a leaf of points, whose rows lie together.

    Such a shard is one leaf of a tree: pairs at each distance are tried at once, by their numbers of groups.
    """
    if not len(which):
        return set()
    bits = np.fromiter((p[0] for p in points), np.int64, len(points))
    place = np.zeros(len(points), np.int64)
    levels: dict[int, np.ndarray] = {}
    for b in np.unique(bits):
        at = np.flatnonzero(bits == b)
        place[at] = np.arange(len(at))
        levels[int(b)] = np.stack([counts_of(points[k]) for k in at])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(1, LEAF):
        together = which[:-d] == which[d:]
        if not together.any():
            break
        least, most = np.minimum(n[:-d], n[d:]), np.maximum(n[:-d], n[d:])
        a = np.flatnonzero(together & (root[:-d] != root[d:]) & (100 * least >= PERCENT * most))
        # the one with more groups first
        x, y = np.where(bits[a] >= bits[a + d], a, a + d), np.where(bits[a] >= bits[a + d], a + d, a)
        for b in np.unique(bits[x]):
            for c in (b, b - 1):
                at = np.flatnonzero((bits[x] == b) & (bits[y] == c))
                for k in range(0, len(at), 4096):
                    p, q = x[at[k:k + 4096]], y[at[k:k + 4096]]
                    finer = levels[int(b)][place[p]]
                    shared = bounds(finer if b == c else coarser(finer), levels[int(c)][place[q]])
                    fit = shared >= needed(n[p], n[q])
                    found.append((p[fit], q[fit], shared[fit]))
    if not found:
        return set()
    p, q, most = (np.concatenate(x) for x in zip(*found, strict=True))
    p, q, most = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([most, most])
    order = np.lexsort((sid[q], -most, p))
    p, q = p[order], q[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], p[1:] != p[:-1])), np.arange(len(p)), 0))
    keep = np.arange(len(p)) - first < best
    a, b = sid[p[keep]], sid[q[keep]]
    return set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))


def _candidates(residual: DataFrame, classes: DataFrame, best: int) -> DataFrame:
    """Pairs (a, b) from the shards in ``residual`` (lead, unit, key, i, j, side, sid, root, n)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        points: dict[int, bytes] = {}
        done: set[tuple[int, int]] = set()

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, i, j, side, sid, root, n = cols[3:]
            out: set[tuple[int, int]] = set()
            differs = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            edge = np.flatnonzero(np.concatenate(([True], differs, [True])))
            count = np.repeat(np.diff(edge), np.diff(edge))
            leaf = np.flatnonzero(count <= LEAF)
            which = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            out |= close_pairs(which[leaf], sid[leaf], root[leaf], n[leaf], [points[k] for k in sid[leaf].tolist()], best)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi - lo > LEAF:
                    own = [points[k] for k in sid[lo:hi].tolist()]
                    out.update(Shard(sid[lo:hi], root[lo:hi], side[lo:hi], n[lo:hi], own).candidates(best))
            if len(done) > SENT:
                done.clear()
            rows = list(out - done)
            done.update(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            if not len(b):
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:10]]
            # a unit that reaches into the next batch waits for it; in each, the points come first
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            end = int(cut[-1]) + 1 if len(cut) else 0
            sent = cols[2] == 0
            points.update(zip(cols[7][sent].tolist(), b.column(10).filter(pa.array(sent)).to_pylist(), strict=True))
            held = [[*h, c] for h, c in zip(held, cols, strict=True)] if held else [[c] for c in cols]
            if end:
                whole = [np.concatenate(h) for h in held]
                end = len(whole[0]) - (len(cols[0]) - end)
                ready = whole[2][:end] == 1
                yield found([c[:end][ready] for c in whole])
                held = [[c[end:]] for c in whole]
                rest = set(held[7][0].tolist())
                points = {k: v for k, v in points.items() if k in rest}
        if held:
            whole = [np.concatenate(h) for h in held]
            yield found([c[whole[2] == 1] for c in whole])

    names = ["lead", "unit", "role", "key", "i", "j", "side", "sid", "root", "n", "point"]
    members = residual.select("lead", "unit", F.lit(1).alias("role"), *names[3:10], F.lit(None).cast("binary").alias("point"))
    sent = residual.select("lead", "unit", "sid").distinct().join(classes.select("sid", "n", "point"), "sid").select(
        "lead", "unit", F.lit(0).alias("role"), F.lit(0).cast("long").alias("key"), *[F.lit(0).cast("int").alias(c) for c in ("i", "j", "side")],
        "sid", F.lit(0).cast("long").alias("root"), "n", "point")
    rows = members.unionByName(sent).select(*names).repartition("lead", "unit").sortWithinPartitions("lead", "unit", "role", "key", "i", "j", "sid")
    return rows.mapInArrow(of, "a bigint, b bigint")


def _residual(shared: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Shards with classes in different components, without those that have none of a fitting size beside them, cut into pairs of blocks."""
    x = shared.select("key", "sid", "n")
    x = x.join(roots, x.sid == roots.node, "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root")) if roots is not None else x.withColumn("root", F.col("sid"))
    # sizes that may link lie in the same or the next class; counts of a shard's classes are combined before the shuffle
    x = x.withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(100.01 / PERCENT))).cast("int"))
    each = x.groupBy("key", "class").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    each = each.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    fit = each.groupBy("key", "class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("key", "class")
    x = materialise(x.join(fit, ["key", "class"], "left_semi"), "sized")
    open_ = x.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"), F.min("sid").alias("lead"))
    open_ = open_.where("lo <> hi").select(F.col("key").alias("k"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"), "lead", "c")
    open_ = materialise(open_, "open")
    units = open_.groupBy(F.col("lead").alias("l")).agg(F.ceil(F.sum(F.col("c") * F.col("blocks")) / UNIT).cast("int").alias("units"))
    x = x.join(open_.join(units, F.col("lead") == F.col("l")).drop("l", "c"), x.key == F.col("k"))
    x = x.withColumn("block", F.pmod(F.hash("sid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a block meets itself with one side, another block with two
    x = x.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                 F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "sid", "root", "n", "lead", "units")
    return x.withColumn("unit", F.pmod(F.hash("key", "i", "j"), "units")).drop("units")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, row (a hash of the text), n_shingles, component_id, class_id, root.

    ``class_id`` is the same for equal sets and ``root`` for a component's rows (both null for empty sets);
    ``component_id`` is the component's smallest doc_id, which is no name of its own where ids are null or repeated.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    with batch_rows(spark, TEXTS):
        found = materialise(_points(docs), "points")
    groups = found.where("n < 0").groupBy("s1").agg((-F.sum("n")).alias("c")).orderBy(F.desc("c"), "s1").limit(KNOWN).orderBy("s1").toPandas()
    frequent, counts = groups["s1"].to_numpy(np.int64), groups["c"].to_numpy(np.int64)
    rows = found.where("n >= 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("point").alias("point"), least.alias("m"))
    classes = materialise(classes.select("s1", "s2", "n", "point", F.col("m.doc_id").alias("doc_id"), F.col("m.row").alias("row"),
                                         F.monotonically_increasing_id().alias("sid")), "classes")

    shared = _told_apart(materialise(_shared(_keys(docs, frequent, counts)), "shared"))
    release(spark)
    by_name = classes.select(F.col("s1").alias("c1"), "sid", "n")
    named = lambda df, c, out: df.join(by_name, F.col(c) == F.col("c1")).withColumnRenamed("sid", out).drop("c1")
    # the hub that leads most of a class's shards, and the least hub of each frequent shard for the others
    led = named(named(shared.where("s1 <> hub").groupBy("s1", "hub").agg(F.count(F.lit(1)).alias("c")), "s1", "a").drop("n"), "hub", "b")
    led = led.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    hubs = shared.where("hot").select("key", "hub").distinct()
    least_hub = hubs.groupBy("key").agg(F.min("hub").alias("least"))
    across = hubs.join(least_hub, "key").where("hub <> least").select("hub", "least").distinct()
    across = named(named(across, "hub", "a").drop("n"), "least", "b").select("a", "b")
    tested = materialise(led.unionByName(across).where("a <> b").distinct(), "pairs")
    with batch_rows(spark, POINTS):
        pairs = materialise(admitted(tested, classes), "pairs")
    shared = materialise(named(shared.select("key", "s1"), "s1", "sid").select("key", "sid", "n"), "shards")
    release(spark)

    with batch_rows(spark, TEXTS):
        links = materialise(verified(pairs, classes, docs), "links")
    release(spark)
    roots = components(links)
    tested = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for best in TURNS:
        residual = materialise(_residual(shared, classes, roots), "residual")
        if residual.isEmpty():
            break
        with batch_rows(spark, POINTS):
            found_now = materialise(_candidates(residual, classes, best), "met")
        new = materialise(found_now.distinct().join(tested, ["a", "b"], "left_anti"), "candidates")
        release(spark)
        if new.isEmpty():
            continue
        tested = tested.unionByName(new)
        with batch_rows(spark, TEXTS):
            more = materialise(verified(new, classes, docs), "links")
        links = links.unionByName(more)
        roots = components(links)
        release(spark)

    known = classes.select("s1", "s2", "sid", "doc_id").join(roots, F.col("sid") == F.col("node"), "left").select(
        "s1", "s2", "sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    best = known.groupBy("root").agg(F.min("doc_id").alias("component"))
    known = known.join(best, "root").select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "sid", "root", "component")
    out = rows.join(known, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"),
                      F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.col("sid").alias("class_id"), "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; documents with empty sets stay.

    Of rows that agree in id and text the one with the least hash of all columns stays; rows with empty sets stay
    however often they are repeated.
    """
    found = materialise(near_duplicates(docs), "components")
    rows = found.groupBy("doc_id", "row").agg(F.max("n_shingles").alias("n"), F.max("root").alias("root"), F.count(F.lit(1)).alias("c"))
    chosen = rows.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "row", "c")).alias("m"))
    chosen = chosen.select("m.*").unionByName(rows.where("n = 0").select("doc_id", "row", F.lit(1).cast("long").alias("c")))
    chosen = materialise(chosen.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"), "c"), "chosen")

    def kept(some: DataFrame) -> DataFrame:
        return docs.withColumn("__row", F.xxhash64("text")).join(
            some.drop("c"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left_semi")

    again = chosen.where("c > 1")
    if again.isEmpty():
        return kept(chosen).drop("__row")
    one = kept(again).groupBy("doc_id", "__row").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("m")).select("m.*")
    return kept(chosen.where("c = 1")).drop("__row").unionByName(one)


def op3_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")

