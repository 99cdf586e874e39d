"""Quality rules: counted rules, and a logistic regression over hashed word and character n-grams.

Features of a document are the shares of its hashed words, word pairs and character trigrams (bytes), each block summing to
one; the score is linear in them, so a batch is scored by one look-up for each occurrence and a sum a row. Fitted on
about ``sample_docs`` labelled rows by gradient descent with a rate for each coordinate, then calibrated on a held-back fifth (Platt), and
compared with a fixed threshold.

Cases: null and empty texts have all counts 0 and fail the base rules; repeated lines and windows are counted within
a text only; very long texts are counted whole; repeated rows each get a row; null ids are carried; without labels
the verdict is to keep; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import labelled_sample, ordered, sigmoid
from .textscan import SPACE, STEP, Texts, U, Words, gram_hash, hash_words, mix, pieces, texts, whole, words

WORD_BITS, CHAR_BITS, CHAR_N = 17, 15, 3
SCALE = np.float32(20.0)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def counts(t: Texts, w: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    rows = len(t.offsets) - 1
    data = t.data
    total = lambda mask: np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][t.offsets])
    out = {"n_words": np.diff(w.first)}
    out["word_chars"] = total(((data & 0xC0) != 0x80) & ~SPACE[data])
    out["n_symbols"] = total(SYMBOLS[data])
    dup = np.zeros(rows, np.int64)
    breaks = total(data == 10)
    for i in np.flatnonzero(breaks):
        lines = [x for x in data[t.offsets[i] : t.offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    ok = whole(w, 5)
    at = np.flatnonzero(ok)
    owner = w.rows()
    five = mix(gram_hash(h, 5)[at] + owner[at].astype(U) * STEP)
    order = np.argsort(five)
    s = five[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    turn = np.zeros(len(h) + 1, np.int64)
    begin = at[order[twice]]
    np.add.at(turn, begin, 1)
    np.add.at(turn, begin + 5, -1)
    inside = np.cumsum(turn[:-1]) > 0
    out["n_repeat_words"] = np.bincount(owner[inside], minlength=rows)
    return out


def occurrences(t: Texts, w: Words, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the word and the character block: (row, feature) of each occurrence."""
    rows = w.rows()
    pair = whole(w, 2)
    shift = U(64 - WORD_BITS)
    word = np.concatenate([h >> shift, gram_hash(h, 2)[pair] >> shift]).astype(np.int64)
    word_rows = np.concatenate([rows, rows[: len(pair)][pair]])
    row = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))
    code = t.data.astype(np.uint32)
    if len(code) < CHAR_N:
        return [(word_rows, word), (row[:0], np.zeros(0, np.int64))]
    gram = code[: len(code) - CHAR_N + 1].copy()
    for k in range(1, CHAR_N):
        gram = (gram << np.uint32(8)) | code[k : len(gram) + k]
    inside = row[: len(gram)] == row[CHAR_N - 1 :]
    slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64) + (1 << WORD_BITS)
    return [(word_rows, word), (row[: len(gram)][inside], slot[inside])]


class Model:
    """Weights of the features, intercept, and the two numbers of the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def score(self, t: Texts, w: Words, h: np.ndarray) -> np.ndarray:
        n = len(t.offsets) - 1
        out = np.full(n, self.bias)
        for rows, at in occurrences(t, w, h):
            many = np.bincount(rows, minlength=n)
            out += SCALE * np.bincount(rows, self.weights[at], n) / np.maximum(many, 1)
        return sigmoid(self.slope * out + self.shift)


def fit(at: list[np.ndarray], value: list[np.ndarray], y: np.ndarray, rounds: int = 60, l2: float = 1e-6) -> Model:
    """Logistic regression on sparse rows; the last fifth of them calibrates."""
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    n = len(y)
    if not n or y.min() == y.max():
        return Model(np.zeros(size), 10.0 if not n or y.max() > 0 else -10.0, 1.0, 0.0)
    cut = max(1, n - n // 5)
    flat, val = np.concatenate(at), np.concatenate(value)
    row = np.repeat(np.arange(n), [len(x) for x in at])
    used, flat = np.unique(flat, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    gw, gb = np.full(len(used), 1e-8), 1e-8
    learn = row < cut
    for _ in range(rounds):
        p = sigmoid(np.bincount(row[learn], val[learn] * w[flat[learn]], cut) + b)
        g = (p - y[:cut]) / cut
        grad = np.bincount(flat[learn], val[learn] * g[row[learn]], len(used)) + l2 * w
        gw += grad * grad
        gb += g.sum() ** 2
        w -= 0.5 * grad / np.sqrt(gw)
        b -= 0.5 * g.sum() / np.sqrt(gb)
    out = np.bincount(row, val * w[flat], n) + b
    z, t = (out[cut:], y[cut:]) if n - cut >= 50 and 0 < y[cut:].mean() < 1 else (out, y)
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton steps, with a little weight on slope 1 and shift 0
        p = sigmoid(slope * z + shift)
        v = p * (1 - p)
        grad = np.array([((p - t) * z).sum() + 0.5 * (slope - 1), (p - t).sum() + 0.5 * shift])
        hess = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 0.5]])
        step = np.linalg.solve(hess, grad)
        slope, shift = max(slope - step[0], 0.05), shift - step[1]
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, b, slope, shift)


def train(sample: DataFrame) -> Model:
    """From ``(doc_id, text, y)``, a bounded sample; only packed feature shares come to the driver."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << WORD_BITS) + (1 << CHAR_BITS)
        for b in batches:
            for a, to, part in pieces(texts(b.column(1)), 1 << 18):
                w = words(part)
                h = hash_words(part.data, w)
                ats: list[list[bytes]] = [[] for _ in range(to - a)]
                vals: list[list[bytes]] = [[] for _ in range(to - a)]
                for rows, at in occurrences(part, w, h):
                    own, many = np.unique(rows * size + at, return_counts=True)
                    r = own // size
                    share = SCALE * many / np.bincount(rows, minlength=to - a)[r]
                    cuts = np.searchsorted(r, np.arange(to - a + 1))
                    for i in range(to - a):
                        x, y = cuts[i], cuts[i + 1]
                        ats[i].append((own[x:y] % size).astype(np.uint32).tobytes())
                        vals[i].append(share[x:y].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, to - a).cast(pa.string()), b.column(2).slice(a, to - a), pa.array([b"".join(x) for x in ats], pa.binary()), pa.array([b"".join(x) for x in vals], pa.binary())],
                    names=["doc_id", "y", "f", "v"],
                )

    got = ordered(sample.select("doc_id", "text", "y").mapInArrow(pack, "doc_id string, y double, f binary, v binary").toArrow())
    at = [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column("f")]
    return fit(at, [np.frombuffer(x.as_buffer(), np.float32) for x in got.column("v")], np.array(got.column("y").to_pylist(), float))


def judge(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least_words: int = 10, most_repeat_percent: int = 20, threshold: float = 0.3) -> DataFrame:
    """A row for each row of ``docs``: doc_id, the counts, base_failed, score (probability of good quality), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, to, part in pieces(texts(b.column(1))):
                w = words(part)
                h = hash_words(part.data, w)
                c = counts(part, w, h)
                failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeat_percent * c["n_words"])
                score = shared.value.score(part, w, h)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, to - a), *(pa.array(c[k], pa.int64()) for k in names), pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= threshold))],
                    names=["doc_id", *names, "base_failed", "score", "kept"],
                )

    kind = left.schema["doc_id"].dataType.simpleString()
    return left.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} bigint' for k in names)}, base_failed boolean, score double, kept boolean")


def op5_quality_rules(spark: SparkSession, sf_dir: str, sample_docs: int = 3000) -> DataFrame:
    """The query: learns from labelled rows, judges all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, train(labelled_sample(docs, labels, "quality", sample_docs, sample_bytes=16 << 20)))
