"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters, lower-cased. Features of a document are the presence of words, of their stems (the first
STEMS bytes, so that endings never seen in training do not hide a word), of pairs of neighbours and of pairs with one
word between, hashed to 2**BITS. FTRL-proximal (McMahan and others, "Ad click prediction", 2013) keeps
a rate for each coordinate and, by its L1 term, exact zeros for all but a few; only the coordinates with a weight
are broadcast, at most as many as the bounded sample has features.

Fitted on about ``sample_docs`` labelled documents and ``sample_bytes`` of text at most, half of them toxic where there are as many, in an order by hash, so that every
run agrees; the intercept is then moved to the share of toxic labels outside the sample.
Cases: null and empty texts get the score of the intercept; repeated features count once, so long texts are not
toxic by length; repeated rows each get a row; null ids are carried; without labels the score is 0 for all; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of
from .labelled import labelled_sample, ordered, share, sigmoid
from .textscan import LETTER, LOWER, STEP, Texts, U, Words, gram_hash, hash_words, mix, pieces, runs, texts, whole

BITS = 22
STEMS = (4, 6)


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each occurrence, not yet distinct."""
    low = LOWER[t.data]
    w = runs(Texts(low, t.offsets), LETTER[t.data])
    h = hash_words(low, w)
    rows = w.rows()
    pair, skip = whole(w, 2), whole(w, 3)
    shift = U(64 - BITS)
    two = gram_hash(h, 2)[pair]
    far = mix(h[:-2] * STEP + mix(h[2:]) + U(3))[skip] if len(h) > 2 else np.zeros(0, U)
    index, owner = [h, two, far], [rows, rows[:-1][pair] if len(rows) else rows, rows[:-2][skip] if len(rows) > 2 else rows[:0]]
    for n in STEMS:
        longer = w.ends - w.starts > n
        starts = w.starts[longer]
        index.append(mix(hash_words(low, Words(starts, starts + n, w.first)) + U(n) * STEP))
        owner.append(rows[longer])
    return np.concatenate(owner), (np.concatenate(index) >> shift).astype(np.uint32)


class Ftrl:
    """The learner. alpha, beta: rates; l1, l2: regularisation. The intercept is not regularised."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.z0 = self.n0 = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.z0 / ((self.beta + np.sqrt(self.n0)) / self.alpha)

    def learn(self, at: np.ndarray, y: float) -> None:
        """One example: its distinct features and its label."""
        w, b = self.weights(at), self.bias
        g = float(sigmoid(np.array(w.sum() + b))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g
        self.z0 += g - (np.sqrt(self.n0 + g * g) - np.sqrt(self.n0)) / self.alpha * b
        self.n0 += g * g


class Model:
    """The features that have a weight, those weights, and the intercept."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.weights, self.bias = at.astype(np.uint32), weights, bias

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weights
        return out

    def scorer(self):
        mark = np.zeros(1 << BITS, bool)
        mark[self.at] = True
        table = self.table()

        def score(t: Texts) -> np.ndarray:
            out = np.full(len(t.offsets) - 1, self.bias)
            for a, to, part in pieces(t):
                rows, index = features(part)
                hit = mark[index]
                own = np.unique((rows[hit].astype(np.int64) << BITS) | index[hit])
                out[a:to] += np.bincount(own >> BITS, table[own & ((1 << BITS) - 1)], to - a)
            return sigmoid(out)

        return score


def train(sample: DataFrame, passes: int = 4, prior: float | None = None) -> Model:
    """From ``(doc_id, text, y)``, a bounded sample; only its packed features come to the driver.

    ``prior`` is the share of label 1 outside the sample: the intercept of a balanced sample is moved to it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, to, part in pieces(texts(b.column(1))):
                rows, index = features(part)
                own = np.unique((rows.astype(np.int64) << BITS) | index)
                cuts = np.searchsorted(own >> BITS, np.arange(to - a + 1))
                index = (own & ((1 << BITS) - 1)).astype(np.uint32)
                packed = [index[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, to - a).cast(pa.string()), b.column(2).slice(a, to - a), pa.array(packed, pa.binary())], names=["doc_id", "y", "f"])

    got = ordered(sample.select("doc_id", "text", "y").mapInArrow(pack, "doc_id string, y double, f binary").toArrow())
    if not got.num_rows:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -35.0)
    learner = Ftrl()
    examples = [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column("f")]
    ys = got.column("y").to_pylist()
    for _ in range(passes):
        for at, y in zip(examples, ys, strict=True):
            learner.learn(at, y)
    at = np.flatnonzero(np.abs(learner.z) > learner.l1)
    had, bias = sum(ys) / len(ys), learner.bias
    if prior is not None and 0 < prior < 1 and 0 < had < 1:
        bias += math.log(prior / (1 - prior)) - math.log(had / (1 - had))
    return Model(at, learner.weights(at), bias)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(texts(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return left.mapInArrow(run, f"doc_id {left.schema['doc_id'].dataType.simpleString()}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str, sample_docs: int = 4000) -> DataFrame:
    """The query: learns labels outside the held-out fold (remainder 2 of 4), scores all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = fold_of(F.col("doc_id"), 4) != 2
    model = train(labelled_sample(docs, labels, "toxic", sample_docs, learnt, balanced=True), prior=share(labels, "toxic", learnt))
    out = score(docs, model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
