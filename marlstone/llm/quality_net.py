"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing (Kanerva and others, 2000): each token has a fixed sparse index vector, a few signed places drawn by
its hash; a token's context vector is the sum of the index vectors of its neighbours over the whole corpus. Tokens
are runs of one kind of sign (letters, digits, others). All are counted first, over the whole corpus: the most frequent
ones, ``VOCABULARY`` at most, have a row of their own, told by a 64-bit hash; the rest share RARE rows by hash. So the
table follows the vocabulary up to a fixed size, 18 MB of float32, that may be broadcast.
Each task sums its own documents; the partial tables, in blocks of rows, are added up in two levels, so that a group holds
about the root of the number of tasks. All sums are of whole numbers, so they do not depend on the order.
A document is the mean of its tokens' unit vectors, beside the mean of their index vectors, which tells frequent signs
apart; the lengths of both means and the share of tokens alike to the one before tell monotonous texts.

The network (one hidden layer, numpy, Adam) is fitted on about ``sample_docs`` labelled documents at most; a temperature, fitted
on a held-back fifth, calibrates its probabilities.

Cases: null and empty texts get the zero vector; texts of one token have no neighbour; very long texts are pooled in
blocks; repeated rows count in the corpus and each get a row; null ids are carried; without labels the score is 1;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, written
from .labelled import labelled_sample, ordered, sigmoid
from .textscan import Texts, U, class_runs, hash_words, mix, pieces, texts

VOCABULARY, RARE = 1 << 16, 1 << 12
DIM, NONZERO, SPAN = 64, 2, 2
#: Rows of the table that travel together.
BLOCK = 64
_TOP = 18


class Vocabulary:
    """Row of each token: frequent ones by their place among the sorted hashes, others in one of the RARE rows after."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(U))
        self.first = np.searchsorted(self.hashes >> U(64 - _TOP), np.arange((1 << _TOP) + 1, dtype=U))
        self.most = int(np.diff(self.first).max(initial=0))
        self.size = len(self.hashes) + RARE

    def rows(self, h: np.ndarray) -> np.ndarray:
        out = len(self.hashes) + (h >> U(20)).astype(np.int64) % RARE
        top = (h >> U(64 - _TOP)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        for _ in range(self.most):
            own = np.flatnonzero(at < end)
            own = own[self.hashes[at[own]] == h[own]]
            out[own] = at[own]
            at = at + 1
        return out

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of the index vector of each row: a function of the token's hash, or of the number of a rare row."""
        seeds = np.r_[self.hashes, np.arange(RARE, dtype=U)]
        h = mix(mix(seeds)[:, None] * U(NONZERO) + np.arange(NONZERO, dtype=U) + U(0x51ED270B))
        return (h % U(DIM)).astype(np.int64), np.where(h >> U(63), 1, -1).astype(np.int32)


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row of each token, and its hash."""
    w = class_runs(t)
    return w.rows(), hash_words(t.data, w)


def vocabulary(docs: DataFrame, text: str = "text", most: int = VOCABULARY) -> tuple[Vocabulary, int]:
    """The frequent tokens, counted over all documents, and the number of tasks that counted.

    Counts are cut at a bound below which too many tokens are, found from a histogram of them; nothing is sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for b in batches:
            for _, _, part in pieces(texts(b.column(0)), 1 << 20):
                own, many = np.unique(tokens(part)[1], return_counts=True)
                both = np.concatenate([kept, own])
                kept, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, many]), len(kept)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(kept.view(np.int64)), pa.nulls(1, pa.int64())]), pa.array(np.r_[counts, 1])], names=["h", "n"])

    part = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "h bigint, n bigint")
    counts = written(part.groupBy("h").agg(F.sum("n").alias("n")), "token-counts")
    tasks = counts.filter("h is null").select("n").first()
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    histogram = sorted(((r["step"], r["m"]) for r in counts.filter("h is not null").groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect()), reverse=True)
    room, least = most, None
    for at, m in histogram:
        if m > room:
            break
        room, least = room - m, at
    if least is None:
        return Vocabulary(np.zeros(0, U)), tasks[0] if tasks else 0
    got = counts.filter(F.col("h").isNotNull() & (step >= least)).select("h").toArrow()
    return Vocabulary(got.column("h").to_numpy().view(U)), tasks[0]


def context_sums(docs: DataFrame, known: Vocabulary, tasks: int = 1, text: str = "text") -> np.ndarray:
    """The table of context vectors, summed over all documents: a row for each row of ``known``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    salts = max(1, math.isqrt(tasks // 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        places, signs = known.index_vectors()
        table = np.zeros(-(-known.size // BLOCK) * BLOCK * DIM, np.int32)
        for b in batches:
            for _, _, part in pieces(texts(b.column(0)), 1 << 18):
                rows, h = tokens(part)
                at = known.rows(h)
                for gap in range(1, SPAN + 1):
                    same = rows[:-gap] == rows[gap:] if len(rows) > gap else np.zeros(0, bool)
                    if not same.any():
                        continue
                    left, right = at[:-gap][same], at[gap:][same]
                    for one, other in ((left, right), (right, left)):
                        base = one * DIM
                        for k in range(NONZERO):
                            np.add.at(table, base + places[other, k], signs[other, k])
        table = table.reshape(-1, BLOCK * DIM)
        own = np.flatnonzero(table.any(axis=1))
        salt = TaskContext.get().partitionId() % salts
        for a in range(0, len(own), 256):
            some = own[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), salt), pa.int64()), pa.array([table[i].astype("<i4").tobytes() for i in some], pa.binary())], names=["block", "salt", "v"])

    def adding(width: str):
        def add(group: pa.Table) -> pa.Table:
            total = np.zeros(BLOCK * DIM, "<i8")
            for x in group.column("v"):
                total += np.frombuffer(x.as_buffer(), width)
            return pa.table({"block": group.column("block").slice(0, 1), "salt": group.column("salt").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

        return add

    kind = "block bigint, salt bigint, v binary"
    part = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, kind).groupBy("block", "salt").applyInArrow(adding("<i4"), kind)
    if salts > 1:
        part = part.groupBy("block").applyInArrow(adding("<i8"), kind)
    got = part.toArrow()
    out = np.zeros((-(-known.size // BLOCK), BLOCK * DIM))
    for block, v in zip(got.column("block").to_pylist(), got.column("v"), strict=True):
        out[block] = np.frombuffer(v.as_buffer(), "<i8")
    return out.reshape(-1, DIM)[: known.size]


class Vectors:
    """The unit context vectors, sent; beside each the index vector, made anew by each worker."""

    def __init__(self, known: Vocabulary, sums: np.ndarray):
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        self.known, self.unit, self.both = known, (sums / np.maximum(norm, 1e-12)).astype(np.float32), None

    def __getstate__(self) -> dict:
        return {"known": self.known, "unit": self.unit, "both": None}

    def table(self) -> np.ndarray:
        if self.both is None:
            places, signs = self.known.index_vectors()
            own = np.zeros_like(self.unit)
            for k in range(NONZERO):
                np.add.at(own, (np.arange(len(own)), places[:, k]), signs[:, k])
            self.both = np.concatenate([self.unit, own], axis=1)
        return self.both


def word_vectors(docs: DataFrame, text: str = "text", most: int = VOCABULARY) -> Vectors:
    """Vocabulary, then context vectors, each from one pass over all documents."""
    known, tasks = vocabulary(docs, text, most)
    return Vectors(known, context_sums(docs, known, tasks, text))


#: Numbers a document beside its mean vector.
MORE = 4


def pooled(t: Texts, of: Vectors) -> np.ndarray:
    """Of each row: mean vector, log of the number of tokens, lengths of the two halves of the mean, share of repeats."""
    rows, h = tokens(t)
    at, vectors = of.known.rows(h), of.table()
    n, d = len(t.offsets) - 1, vectors.shape[1]
    out = np.zeros((n, d + MORE), np.float32)
    for x in range(0, len(at), 1 << 14):
        r = rows[x : x + (1 << 14)]
        cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[cuts], :d] += np.add.reduceat(vectors[at[x : x + (1 << 14)]], cuts, axis=0)
    many = np.bincount(rows, minlength=n)
    out[:, :d] /= np.maximum(many, 1)[:, None]
    again = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    out[:, d] = np.log1p(many)
    out[:, d + 1] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, d + 2] = np.linalg.norm(out[:, DIM:d], axis=1)
    out[:, d + 3] = np.bincount(rows[1:][again], minlength=n) / np.maximum(many, 1)
    return out


class Network:
    """Standardised input, one hidden layer of tanh units, a logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, seed: int = 5):
        self.ready = len(y) > 0 and y.min() != y.max()
        self.constant = float(y.mean()) if len(y) else 1.0
        if not self.ready:
            return
        x = x.astype(np.float64)
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        cut = max(1, len(y) - len(y) // 5)
        if not 0 < y[:cut].mean() < 1:
            cut = len(y)
        draw = np.random.default_rng(seed)
        p = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for _ in range(rounds // 10):
            for at in np.array_split(draw.permutation(cut), max(1, cut // 256)):
                step += 1
                a = np.tanh(x[at] @ p[0] + p[1])
                g = (sigmoid(a @ p[2] + p[3]) - y[at]) / len(at)
                back = np.outer(g, p[2]) * (1 - a * a)
                grads = [x[at].T @ back + 1e-3 * p[0], back.sum(axis=0), a.T @ g + 1e-3 * p[2], np.array([g.sum()])]
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        held = slice(cut, None) if len(y) - cut >= 50 else slice(None)
        z, t = self._logit(x[held]), y[held]
        losses = {k: -np.mean(np.log(np.where(t > 0, sigmoid(z / k), 1 - sigmoid(z / k)) + 1e-12)) for k in np.geomspace(0.25, 8, 41)}
        self.temperature = float(min(losses, key=lambda k: (losses[k], k)))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.constant)
        return sigmoid(self._logit(np.clip((x - self.mean) / self.sd, -8, 8)) / self.temperature)


def train(sample: DataFrame, vectors: Vectors) -> Network:
    """From ``(doc_id, text, y)``, a bounded sample; one pooled vector a document comes to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, to, part in pieces(texts(b.column(1)), 1 << 18):
                x = pooled(part, shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, to - a).cast(pa.string()), b.column(2).slice(a, to - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    got = ordered(sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id string, y double, x binary").toArrow())
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIM + MORE)
    return Network(x, np.array(got.column("y").to_pylist(), float))


def score(docs: DataFrame, vectors: Vectors, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for b in batches:
            for a, to, part in pieces(texts(b.column(1)), 1 << 18):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, to - a), pa.array(network.probability(pooled(part, vectors)), pa.float64())], names=["doc_id", "score"])

    return left.mapInArrow(run, f"doc_id {left.schema['doc_id'].dataType.simpleString()}, score double")


def op9_quality_net(spark: SparkSession, sf_dir: str, sample_docs: int = 8000) -> DataFrame:
    """The query: word vectors from all texts, labels outside the held-out fold (remainder 0 of 5), all documents scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors = word_vectors(docs)
    network = train(labelled_sample(docs, labels, "quality", sample_docs, fold_of(F.col("doc_id"), 5) != 0), vectors)
    out = score(docs, vectors, network)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
