"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece is a match of the tokenizer's pattern. Over its byte positions lies a
segment tree whose leaves hold the rank of the pair that starts there, packed
with the position, so the root is the leftmost pair of least rank. A merge
removes the right neighbour from a linked list and sets three leaves; each is a
walk to the root, so a piece of n bytes takes O(n log n) whatever its length.

Pieces repeat, so each Python worker keeps the ids of pieces it has met, in a
table of bounded size. The vocabulary file is a parameter; the driver reads it
and sends its content, about a megabyte, to the workers.

Defined cases: null and empty texts have no tokens; lone surrogates cannot occur
in a Spark string; texts of any length are encoded whole; repeated rows give
equal results; other columns pass by, except those named like a result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pieces that a worker remembers, twice: at the bound it starts a new table and keeps the one before.
MEMORY = 150_000
#: Longer pieces are encoded each time that they occur.
REMEMBERED_LENGTH = 64
#: Spare bits of a packed rank hold the position.
_POS = 40
_AT = (1 << _POS) - 1
_NONE = 1 << 62


class Vocabulary:
    """Ranks of byte strings, the pattern that cuts pieces, and both directions of the code."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.parts = [b""] * (max(ranks.values(), default=-1) + 1)
        for part, rank in ranks.items():
            self.parts[rank] = part
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @classmethod
    def parse(cls, content: bytes, pattern: str) -> Vocabulary:
        """From lines of a base64 byte string and its rank."""
        rows = (line.split() for line in content.splitlines() if line)
        return cls({base64.b64decode(part): int(rank) for part, rank in rows}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 1))  # of the part that starts at a position
        before = list(range(-1, n - 1))
        # the tree: leaves from ``size`` on hold rank << _POS | start, every node the least below it
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i:i + 2])
            if rank is not None:
                tree[size + i] = rank << _POS | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        while (least := tree[1]) != _NONE:
            start = least & _AT
            gone = ends[start]
            ends[start] = after = ends[gone]
            if after < n:
                before[after] = start
                rank = get(piece[start:ends[after]])
                changed = [(gone, _NONE), (start, _NONE if rank is None else rank << _POS | start)]
            else:
                changed = [(gone, _NONE), (start, _NONE)]
            if start:
                left = before[start]
                rank = get(piece[left:after])
                changed.append((left, _NONE if rank is None else rank << _POS | left))
            for at, key in changed:
                i = size + at
                if tree[i] == key:
                    continue
                tree[i] = key
                while i > 1:
                    a, i = tree[i ^ 1], i >> 1
                    if a < key:
                        key = a
                    if tree[i] == key:  # nothing changes above
                        break
                    tree[i] = key
        out, start = [], 0
        while start < n:
            out.append(ranks[piece[start:ends[start]]])
            start = ends[start]
        return out

    def _met(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or tuple(self.merge(piece.encode()))
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self.seen) >= MEMORY:
                self.older, self.seen = self.seen, {}
            self.seen[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, met, out = self.seen.get, self._met, []
        for piece in self.pieces(text):
            out += get(piece) or met(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))


#: Vocabularies that this worker process has parsed.
_HELD: dict[str, Vocabulary] = {}


def _held(digest: str, content, pattern: str) -> Vocabulary:
    if digest not in _HELD:
        _HELD[digest] = Vocabulary.parse(content.value, pattern)
    return _HELD[digest]


def _shared(spark: SparkSession, path: str, pattern: str):
    """The vocabulary's bytes for all workers (a file of fixed size, about a megabyte) and their digest."""
    with open(path, "rb") as f:
        content = f.read()
    return spark.sparkContext.broadcast(content), hashlib.sha256(content + pattern.encode()).hexdigest()


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the ids of ``text``, as an array."""
    content, digest = _shared(df.sparkSession, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        v = _held(digest, content, pattern)
        return texts.map(lambda t: v.encode(t or ""), na_action=None)

    return df.withColumn(out, ids(F.coalesce(text, F.lit(""))))


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for."""
    content, digest = _shared(df.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def back(rows):
        v = _held(digest, content, pattern)
        return rows.map(lambda x: v.decode([] if x is None else list(x)), na_action=None)

    return df.withColumn(out, back(F.col(ids)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The other columns of ``df`` with n_tokens, ids_sha256 and decoded_sha256, without sending ids to the JVM."""
    content, digest = _shared(df.sparkSession, path, pattern)
    kept = [c for c in df.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes if c in kept] + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _held(digest, content, pattern)
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            for t in batch.column(len(kept)):
                ids = v.encode(t.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                back_sha.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
                names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(*kept, text).mapInArrow(digests, schema)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *public_vocabulary())
