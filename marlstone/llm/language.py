"""Language identification by string kernels.

Blended-spectrum presence kernel: k(x, y) counts the byte n-grams of 1 to ``max_n`` that occur in both, over the root
of the product of the texts' own counts. Nystrom: with landmarks L, features are K(x, L) K(L, L)^(-1/2); one-versus-
rest kernel ridge regression on these gives, for each language, weights over landmarks. Presence is kept as 0/1 rows over
hashed n-grams, so kernel values against all landmarks are one matrix product a batch; as the score is linear in
them, landmark rows and weights are multiplied beforehand, and a batch is scored by one product with a matrix of
n-grams by languages.

Fitted on a bounded sample (``sample_docs`` labelled documents, as many a language and one at least, by hash);
everything is deterministic. Letters are lower-cased (ASCII and Latin-1), all else but letters counts as space.

``keep_identified`` acts on the verdict. It rejects a text in no language (``und``), a text whose language is not asked
for, and a text that no classifier claims: each of the one-versus-rest regressions aims at 1 for its own language and
at -1 for the rest, so a text in a language that was not learnt, or in none, has values near the intercepts, below
``claim`` for all. Texts of fewer than ``least_grams`` distinct n-grams (some 20 letters) are too short for that, they stay.

Cases: null text or text without a letter: ``und``, score 0; one-letter and very long texts are scored whole; repeated
rows each get a row; null ids are carried; if no labelled row exists, all are ``und`` and ``keep_identified`` rejects
nothing, as nothing can be identified; with one language every text with a letter is in it; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of
from .textscan import LETTER, LOWER, Texts, pieces, slices, texts

UND = "und"
MAX_N = 4
BITS = 14
_FOLD = np.where(LETTER, LOWER, np.uint8(32)).astype(np.uint8)


def folded(t: Texts) -> np.ndarray:
    """Bytes in lower case, non-letters as space."""
    b = _FOLD[t.data]
    if len(b) > 1:
        upper = (t.data[:-1] == 0xC3) & (t.data[1:] >= 0x80) & (t.data[1:] <= 0x9E) & (t.data[1:] != 0x97)
        b[1:][upper] += 32
    return b


def presence(t: Texts) -> np.ndarray:
    """0/1 rows: which hashed n-grams of 1 to MAX_N bytes a row has. A space is put before and after each row."""
    rows = len(t.offsets) - 1
    out = np.zeros((rows, 1 << BITS), np.uint8)
    flat = out.reshape(-1)
    lengths = np.diff(t.offsets)
    data = np.full(len(t.data) + rows + 1, 32, np.uint8)
    row = np.repeat(np.arange(rows), lengths)
    data[np.arange(len(t.data)) + row + 1] = folded(t)
    owner = np.zeros(len(data), np.int64)
    owner[1:] = np.repeat(np.arange(rows), lengths + 1)
    code = data.astype(np.uint32)
    gram = code.copy()
    base = owner << BITS
    for n in range(1, MAX_N + 1):
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | code[n - 1 :]
        slot = ((gram * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        # A gram belongs to the row of its last sign if its second sign does too: the first may be the space before.
        last = base[n - 1 :]
        if n > 2:
            inside = base[1 : len(gram) + 1] == last
            last, slot = last[inside], slot[inside]
        flat[last + slot] = 1
    return out


def has_letter(t: Texts) -> np.ndarray:
    """Does each row have a letter? ASCII by bytes; rows with none but other characters one by one."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    sums = np.r_[0, np.cumsum(ascii_letter[t.data])]
    out = sums[t.offsets[1:]] > sums[t.offsets[:-1]]
    high = np.r_[0, np.cumsum(t.data >= 128)]
    for i in np.flatnonzero(~out & (high[t.offsets[1:]] > high[t.offsets[:-1]])):
        out[i] = any(c.isalpha() for c in t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """Languages, a matrix of hashed n-grams by languages, intercepts and the sharpness of the scores."""

    def __init__(self, x: np.ndarray, labels: list[str], landmarks: int = 400, ridge: float = 1e-3):
        self.langs = sorted(set(labels))
        n = len(labels)
        if not n:
            return
        x = x.astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        y = np.array([[1.0 if a == b else -1.0 for b in self.langs] for a in labels])
        share = np.array([labels.count(a) for a in self.langs], float)
        weight = np.array([n / (len(self.langs) * share[self.langs.index(a)]) for a in labels])
        mark = x[np.linspace(0, n - 1, min(landmarks, n)).astype(int)]
        values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.c_[(x @ mark.T).astype(np.float64) @ root, np.ones(n)]
        gram = (phi * weight[:, None]).T @ phi + ridge * n * np.eye(phi.shape[1]) * np.r_[np.ones(phi.shape[1] - 1), 0.0]
        w = np.linalg.solve(gram, (phi * weight[:, None]).T @ y)
        self.bias = w[-1].astype(np.float32)
        self.matrix = (mark.T @ (root @ w[:-1]).astype(np.float32)).astype(np.float32)
        self.sharp = 4.0

    def judge(self, t: Texts) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the language, its probability, the value of its classifier and the number of n-grams present."""
        langs: list[str] = []
        scores, claims, grams = [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
        for _, _, part in pieces(t, 1 << 19):
            n = len(part.offsets) - 1
            for a in range(0, n, 256):
                some = part.offsets[a : a + 257]
                sub = Texts(part.data[some[0] : some[-1]], some - some[0])
                letter = has_letter(sub)
                if not self.langs:
                    langs += [UND] * len(letter)
                    for column in (scores, claims, grams):
                        column.append(np.zeros(len(letter)))
                    continue
                x = presence(sub).astype(np.float32)
                many = x.sum(axis=1)
                f = (x @ self.matrix) / np.sqrt(np.maximum(many, 1))[:, None] + self.bias
                e = np.exp(self.sharp * (f - f.max(axis=1, keepdims=True)).astype(np.float64))
                best = f.argmax(axis=1)
                langs += [self.langs[j] if ok else UND for j, ok in zip(best, letter, strict=True)]
                scores.append(np.where(letter, 1.0 / e.sum(axis=1), 0.0))
                claims.append(f.max(axis=1).astype(np.float64))
                grams.append(many.astype(np.float64))
        return langs, np.concatenate(scores), np.concatenate(claims), np.concatenate(grams)

    def score(self, t: Texts) -> tuple[list[str], np.ndarray]:
        """The language of each row and its probability."""
        return self.judge(t)[:2]


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 1200, landmarks: int = 400) -> Model:
    """Fits on a bounded sample; only packed presence rows (2 KB a document) come to the driver."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    picked = bounded_sample(rows, F.col("doc_id"), "lang", sample_docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = texts(b.column(1))
            for at, to, part in pieces(t):
                bits = np.packbits(presence(part), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at).cast(pa.string()), b.column(2).slice(at, to - at), pa.array([r.tobytes() for r in bits], pa.binary())], names=["id", "lang", "bits"])

    once = picked.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.text", "x.lang")  # an id may have any number of rows
    got = once.mapInArrow(features, "id string, lang string, bits binary").toArrow()
    order = sorted(zip(got.column("id").to_pylist(), got.column("lang").to_pylist(), got.column("bits").to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1], r[2]))
    order.sort(key=lambda r: hash_key(r[0] or ""))
    x = np.unpackbits(np.frombuffer(b"".join(r[2] for r in order), np.uint8).reshape(len(order), -1), axis=1) if order else np.zeros((0, 1 << BITS), np.uint8)
    return Model(x, [r[1] for r in order], landmarks)


def hash_key(s: str) -> int:
    """Order that mixes languages, the same in every run."""
    return zlib.crc32(b"order:" + s.encode())


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang_pred, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.score(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return left.mapInArrow(run, f"doc_id {left.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", languages: set[str] | None = None, claim: float = -0.2, least_grams: int = 64) -> DataFrame:
    """``docs`` without the rows that are rejected: in no language, in none of ``languages`` (all learnt ones if not
    given), or claimed by no classifier. Columns and their order stay. A model without languages rejects nothing."""
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = set(model.langs if languages is None else languages)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs, _, claims, grams = shared.value.judge(texts(b.column(place)))
            known = np.fromiter((x in wanted for x in langs), bool, len(langs))
            yield b.filter(pa.array(known & ((claims >= claim) | (grams < least_grams))))

    return docs.mapInArrow(run, docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: fits on documents outside the held-out fold (remainder 2 of 4), predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(fold_of(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
