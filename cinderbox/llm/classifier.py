"""Quality classifier: supervised subword embeddings trained by stochastic gradient descent.

A document is the mean of its words' vectors; a word's vector is the mean of the
learned vectors of the hashed word itself and of its hashed character n-grams
inside word marks. A word that equals the one before it adds one marker word, whose
vector is learned like any other's: hashed words cannot tell that an unknown word
is repeated, and without it held-out accuracy at sf0.1 is 0.966 instead of 0.997.
A softmax layer on top gives the classes. Everything is numpy and seeded. Words are
hashed by CRC-32, so vectors do not depend on the process.

The model is fitted on the driver on a bounded sample of labelled rows
(``SAMPLE`` documents, the least hashes of their ids, whole texts of at most
``SAMPLE_CHARS`` characters together, chosen by their lengths before a text is
fetched); its size does not depend on the data and it goes to the workers as a
broadcast. Scoring reads every whole text once.

Defined cases: null and empty texts score the model's prior (the bias alone);
texts of any length count whole; repeated rows score alike; rows without a label
or with a null id or label are never learned from, and of rows that share an id
the one of least text hash is; with no labels at all, or labels of one class,
every score is that class's share (0.5 with none); other columns pass by, except
one named score.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4)
#: Labelled documents that the model is fitted on, at most, half from each class.
SAMPLE = 6000
#: Characters of text in that sample, at most (documents are left out whole).
SAMPLE_CHARS = 40_000_000
EPOCHS = 6
RATE = 0.5
SEED = 7
THRESHOLD = 0.7
#: Words and characters of words that a worker remembers; beyond either it forgets all and starts again.
MEMORY, MEMORY_CHARS = 400_000, 20_000_000
#: Characters of text that are scored together.
CHUNK = 2 << 20
#: Stands, as one more word, for each word that equals the one before it (no word holds white space).
AGAIN = " again"
#: An odd multiplier for the hashes of n-grams.
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, word after word, and where each word's begin.

    N-grams lie inside word marks and count as often as they occur. All words
    are hashed in one pass over their code points.
    """
    marked = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), sizes)
    buckets = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.int64, len(words))]
    owner = [np.arange(len(words))]
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + codes[k:len(codes) - n + 1 + k]) * _MULTIPLIER
        inside = of[:len(h)] == of[n - 1:]
        buckets.append((h[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owner.append(of[:len(h)][inside])
    owner, buckets = np.concatenate(owner), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dim
    weights: np.ndarray  # dim x classes
    bias: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Vectors of words: means over their buckets."""
        if not words:
            return np.empty((0, DIM))
        buckets, starts = features(words)
        sizes = np.diff(starts, append=len(buckets))
        return np.add.reduceat(self.vectors[buckets], starts) / sizes[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, islice(words, 1, None)))


def counted(text: str | None) -> dict[str, int]:
    """Words of a text, and repeats, with their counts."""
    words = (text or "").split()
    out = dict(Counter(words))
    if again := repeats(words):
        out[AGAIN] = again
    return out


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """A model of class 1 against class 0."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
    weights, share = np.zeros((DIM, 2)), float(np.mean(labels)) if labels else 0.5
    bias = np.log(np.clip([1 - share, share], 1e-6, 1))
    if len(set(labels)) < 2:
        return Model(vectors * 0, weights, bias)
    # each document once: its buckets and the weight of each in the mean
    memory: dict[str, np.ndarray] = {}
    docs = []
    for t in texts:
        words = counted(t)
        total = sum(words.values())
        if new := [w for w in words if w not in memory]:
            buckets, starts = features(new)
            memory.update(zip(new, np.split(buckets, starts[1:]), strict=True))
        if words:
            own = [memory[w] for w in words]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            part = np.repeat(np.fromiter(words.values(), float, len(own)) / (total * sizes), sizes)
            flat, back = np.unique(np.concatenate(own), return_inverse=True)
            docs.append((flat, np.bincount(back, part)))
        else:
            docs.append((np.empty(0, np.int64), np.empty(0)))
    steps, done = epochs * len(docs), 0
    y = np.array(labels)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, part = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            h = part @ vectors[ids]
            g = softmax(h @ weights + bias)
            g[y[i]] -= 1
            dh = weights @ g
            weights -= lr * np.outer(h, g)
            bias -= lr * 0.1 * g
            # part sums to 1 over many buckets; its scale would leave the vectors nearly still
            vectors[ids] -= lr * np.outer(part / part.max(), dh) * 0.5
    return Model(vectors, weights, bias)


class Scorer:
    """Scores texts, remembering the vectors of words."""

    def __init__(self, model: Model):
        self.model = model
        self.again = model.words([AGAIN])[0]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.held = np.empty((0, DIM))
        self.chars = 0

    def learn(self, texts: list[list[str]]) -> None:
        new: set[str] = set().union(*texts) - self.at.keys()
        size = sum(map(len, new))
        if self.at and (len(self.at) + len(new) > MEMORY or self.chars + size > MEMORY_CHARS):
            self.forget()
            new = set().union(*texts)
            size = sum(map(len, new))
        if new:
            words = sorted(new)
            self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
            self.held = np.concatenate([self.held, self.model.words(words)])
            self.chars += size

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """Scores of texts, in chunks whose new words are learned together."""
        out: list[float] = []
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append((t or "").split())
            size += len(t or "")
            if size >= CHUNK:
                out += self._scores(held)
                held, size = [], 0
        return out + self._scores(held)

    def _scores(self, texts: list[list[str]]) -> list[float]:
        if not texts:
            return []
        self.learn(texts)
        h = np.zeros((len(texts), DIM))
        row = self.at.__getitem__
        for k, words in enumerate(texts):
            if words:
                again = repeats(words)
                total = self.held.take(np.fromiter(map(row, words), np.int64, len(words)), 0).sum(axis=0)
                h[k] = (total + again * self.again) / (len(words) + again)
        return softmax(h @ self.model.weights + self.model.bias)[:, 1].tolist()


#: The scorer of the model that this worker process used last, by a name.
_HELD: dict[str, Scorer] = {}


def _scorer(number: str, sent) -> Scorer:
    if number not in _HELD:
        _HELD.clear()
        _HELD[number] = Scorer(sent.value)
    return _HELD[number]


def in_fold(doc_id, fold: int = 2):
    """Whether CRC-32 of the id as text leaves this remainder by 4; false for null ids."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` labelled (text, label) rows outside the held-out fold, in a fixed order.

    The ids are chosen first from the labels alone (a top-k by hash within each
    class), so only the sample's texts are moved.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = [(r.doc_id, r.label) for k in (0, 1) for r in known.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample // 2).collect()]
    if not chosen:
        return []
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, label int"))  # at most ``sample`` rows
    texts = docs.where(~in_fold(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.min(F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))).alias("m")
    sizes = texts.join(ids, "doc_id").groupBy("doc_id").agg(size, F.first("label").alias("label")).select("doc_id", "m.h", "m.n", "label").collect()
    fitting, chars = {}, 0
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        if chars + r.n <= SAMPLE_CHARS:
            chars += r.n
            fitting[r.doc_id] = (r.h, r.label)
    if not fitting:
        return []
    wanted = F.broadcast(spark.createDataFrame([(i, h) for i, (h, _) in fitting.items()], "doc_id bigint, h bigint"))
    rows = texts.withColumn("h", F.xxhash64("text")).join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text")
    found = {r.doc_id: r.text for r in rows.toLocalIterator()}
    return [(found[i], label) for i, (_, label) in fitting.items()]


def score_column(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers, whatever the data
    number = uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in (text, "score")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in kept), "score double"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(number, sent)
        for b in batches:
            scores = scorer.scores(x.as_py() for x in b.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(scores, pa.float64())], names=[*kept, "score"])

    return docs.select(*kept, text).mapInArrow(scored, schema)


def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = training_rows(docs, table(spark, sf_dir, "labels"))
    model = fit([t for t, _ in rows], [y for _, y in rows])
    return score_column(docs, model).select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
