"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The patterns give the base spans. Besides, two order-1 Markov models over characters, one trained on random strings,
one on ordinary identifiers, give a log-likelihood ratio a transition. A stretch of a run of token signs is a secret of
kind ``random`` if its ratios, less a fixed threshold each, add up to ``EVIDENCE`` or more: so neither a path before a
secret nor a sign after = thins it out, and the models alone decide: no digit, no letter and no length of a run is
asked for, but that a stretch has ``LEAST`` signs (a single rare word of five letters can be as unlikely as a key). The
stretch is widened to the next ``/`` or ``=`` or the end of the run. Spans that touch a base span are left out.

Labelled samples: random strings of the usual alphabets from a seeded generator (label secret), and identifiers made
of the words of a bounded sample of documents, joined in the usual ways, half of them also in capitals (label
ordinary); ``train`` takes any others.

Cases: null counts as empty text and has no span; very long texts are scanned whole; positions are code points;
repeated rows each give a row; a null id is carried; other columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample
from .textscan import slices

#: Kinds in order, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
_ASSIGN = re.compile(BASE[0][1])
_ACCESS = re.compile(BASE[1][1])
#: A run of hex signs counts from 16 on; runs are maximal either way.
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Nats above the threshold that a stretch needs, and signs.
EVIDENCE, LEAST = 12.0, 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in _HEX.finditer(text)]
    found.sort()
    return [(s, e, k) for s, _, e, k in found]


class Markov:
    """Order-1 character model over the token alphabet, add-one smoothed; log-likelihood ratio of two such."""

    def __init__(self, secret: Iterable[str], ordinary: Iterable[str]):
        self.ratio = self._fit(secret) - self._fit(ordinary)
        #: By code, the last one for signs that are none of a token's.
        self.padded = np.pad(self.ratio, (0, 1))

    @staticmethod
    def _fit(strings: Iterable[str]) -> np.ndarray:
        n = len(ALPHABET)
        counts = np.ones((n, n))
        for s in strings:
            c = _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8) & 127]
            ok = (c[:-1] >= 0) & (c[1:] >= 0)
            np.add.at(counts, (c[:-1][ok], c[1:][ok]), 1)
        return np.log(counts / counts.sum(axis=1, keepdims=True))

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio a transition; above zero: likelier random."""
        c = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratio[c[:-1], c[1:]].mean())


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Labelled secret: uniform strings over hex, base-36, base-62 and URL-safe alphabets, and over letters."""
    draw = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = (digits + "abcdef", digits + lower, digits + upper, ALPHABET[:62], ALPHABET[:62] + "-_", ALPHABET[:62] + "+/", upper, lower, upper + lower)
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(20, 48))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = 8) -> list[str]:
    """Labelled ordinary: words joined as in code, paths and slugs, some with a year, a number or a version."""
    draw = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value", "name", "index", "count"]
    out = []
    for i in range(n):
        parts = [w.lower() for w in draw.choices(words, k=draw.randint(2, 6))]
        style = i % 6
        if style == 0:
            s = "_".join(parts)
        elif style == 1:
            s = "-".join(parts)
        elif style == 2:
            s = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 3:
            s = "/".join(parts)
        elif style == 4:
            s = "_".join(p.upper() for p in parts)
        else:
            s = "".join(parts)
        if i % 3 == 0:
            s += draw.choice(("", "_", "-", "/")) + str(draw.choice((draw.randint(0, 99), draw.randint(1990, 2030), draw.randint(0, 10**6))))
        out.append(s)
    return out


def train(docs: DataFrame, text: str = "text", sample_docs: int = 400, strings: int = 20000) -> Markov:
    """The two models. Ordinary words come from about ``sample_docs`` documents, picked by hash of the text; of each
    the first 200 words that consist of letters."""
    one = docs.select(F.col(text).cast("string").alias("t"), F.lit(0).alias("stratum")).filter("t is not null")
    rows = bounded_sample(one, F.col("t"), "stratum", sample_docs)
    lists = rows.select(F.sort_array(F.slice(F.array_distinct(F.regexp_extract_all("t", F.lit("(?<![A-Za-z])([A-Za-z]{2,20})(?![A-Za-z])"), F.lit(1))), 1, 200)).alias("w")).distinct()  # a text may have any number of copies
    words = sorted({w for r in lists.toLocalIterator() for w in r["w"]})
    known = identifiers(words, strings)
    return Markov(random_strings(strings), known + [s.upper() for s in known[::2]])


def stretches(text: str, model: Markov, threshold: float) -> list[tuple[int, int]]:
    """Stretches of token runs whose ratios above the threshold add up to EVIDENCE, widened to / or = or the run's end.

    A transition that speaks for a secret counts once a stretch: said again it is no further evidence (``xxxx``)."""
    raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    c = _CODE[raw]
    inside = c >= 0
    both = inside[:-1] & inside[1:]
    gain = np.where(both, model.padded[c[:-1], c[1:]] - threshold, 0.0)
    edge = np.flatnonzero(np.diff(np.r_[False, both, False]))
    starts, ends = edge[::2], edge[1::2]  # transitions of each run
    if not len(starts):
        return []
    up = np.r_[0.0, np.cumsum(np.maximum(gain, 0))]
    out = []
    for k in np.flatnonzero(up[ends] - up[starts] >= EVIDENCE - 1e-6):
        a, b = int(starts[k]), int(ends[k])
        total, best, first, last = 0.0, 0.0, a, a
        found, seen = [], set()
        for i, g in enumerate([*gain[a:b].tolist(), -math.inf], a):
            step = text[i : i + 2]
            if g > 0 and step in seen:
                continue
            seen.add(step)
            total += g
            if total > best:
                best, last = total, i
            if total <= 0 or best - total >= EVIDENCE:
                if best >= EVIDENCE and last + 2 - first >= LEAST:
                    found.append((first, last + 2))
                total, best, first, seen = 0.0, 0.0, i + 1, set()
        for s, e in found:
            while s > a and text[s - 1] not in "/=":
                s -= 1
            while e < b + 1 and text[e] not in "/=":
                e += 1
            if out and s <= out[-1][1]:
                s, e = out[-1][0], max(e, out.pop()[1])
            out.append((s, e))
    return out


def outside(found: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of ``found``, disjoint and in order, that no span of ``base``, in order of start, covers."""
    covered: list[list[int]] = []
    for s, e, _ in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    out, i = [], 0
    for a, b in found:
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        j, at = i, a
        while j < len(covered) and covered[j][0] < b:
            if covered[j][0] > at:
                out.append((at, covered[j][0]))
            at, j = max(at, covered[j][1]), j + 1
        if at < b:
            out.append((at, b))
        i = max(i, j - 1)
    return out


def all_spans(text: str, model: Markov, threshold: float) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base and model spans together, each by start. Of a stretch that meets base spans the parts outside them are spans of the model."""
    base = base_spans(text)
    more = [(a, b, "random") for a, b in outside(stretches(text, model, threshold), base)]
    return base, sorted(base + more, key=lambda x: x[0]) if more else base


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: Markov, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts by kind, base_sha256, spans as kind:start:end, comma-joined."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = left.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = {k: [] for k in ("assign", "access", "hex", "random")}
            digests, listed = [], []
            for t in b.column(1):
                base, spans = all_spans(t.as_py() or "", shared.value, threshold)
                kinds = [k for _, _, k in spans]
                for k, v in counts.items():
                    v.append(kinds.count(k))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return left.mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Markov, text: str = "text", length: str | None = "n_chars", mask: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """``docs`` with each stretch of overlapping or touching spans replaced by ``mask``; ``length``, if present, is set anew where
    the text changed. All columns, their order and all rows stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    count = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new, lengths = [], b.column(count).to_pylist() if count is not None else []
            for i, t in enumerate(b.column(place)):
                t = t.as_py()
                spans = all_spans(t, shared.value, threshold)[1] if t else []
                if spans:
                    out, at, last = [], 0, -1
                    for s, e, _ in spans:
                        if s > last:
                            out += [t[at:s], mask]
                        at = last = max(at, e)
                    t = "".join([*out, t[at:]])
                    if lengths:
                        lengths[i] = len(t)
                new.append(t)
            columns = list(b.columns)
            columns[place] = pa.array(new, b.schema.field(place).type)
            if lengths:
                columns[count] = pa.array(lengths, b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole text of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(docs))
