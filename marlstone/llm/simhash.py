"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

A fingerprint is split into ``blocks`` runs of bits. Two that differ in at most d bits agree on at least
``blocks - d`` runs, so they share one of the keys that choose so many runs; documents meet on those keys only.

Work is done on distinct fingerprints, so groups of exact copies cost one row. A key shared by at most ``pairwise``
fingerprints is joined with itself and each pair is verified. A more frequent key (a large group of near copies) is
not paired: two fingerprints differ in at most 2 bits exactly if flipping at most one bit of each can make them equal,
so each sends the codes at distance 0 and 1 (only bits outside the key can differ) and links to the least fingerprint
that sends the same code. That is linear in the group, exact, and loses no link between components.

Cases: null and empty text have fingerprint zero and are linked like any other; a text of fewer words than a shingle
is one shingle; repeated rows and repeated ids each get a row; a null id takes part but never names a component
unless all ids are null; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written
from .components import components
from .textscan import LOWER, Texts, U, pieces, runs, texts, words

SEED = 42
_ONES = U(0x0101010101010101)


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of ``h``; zero for none. Counts eight bits at a time in byte lanes."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    cuts = np.arange(0, n, 255)
    for shift in range(8):
        lanes = np.add.reduceat((h >> U(shift)) & _ONES, cuts)  # at most 255 a lane
        counts[shift::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def text_shingles(t: Texts, shingle: int) -> Iterator[np.ndarray]:
    """Of each row XXH64 of each run of ``shingle`` words, lower-cased and joined by one space; none without words."""
    digest = xxhash.xxh64_intdigest
    for _, _, part in pieces(t):
        low = LOWER[part.data]
        w = words(Texts(low, part.offsets))
        for d in range(len(part.offsets) - 1):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if a == b:
                yield np.empty(0, U)
                continue
            raw = low[w.starts[a] : w.ends[b - 1]].tobytes()
            begins, ends = w.starts[a:b] - w.starts[a], w.ends[a:b] - w.starts[a]
            if (begins[1:] - ends[:-1] != 1).any() or b"\n" in raw or b"\t" in raw or raw.translate(None, b"\x0b\x0c\r") != raw:
                raw = b" ".join(raw.split())
                ends = np.cumsum(ends - begins + 1) - 1
                begins = ends - (w.ends[a:b] - w.starts[a:b])
            k = min(shingle, b - a)
            h = np.empty(b - a - k + 1, U)
            for at in range(0, len(h), 1 << 16):
                s, e = begins[at : at + (1 << 16)][: len(h) - at].tolist(), ends[at + k - 1 : at + k - 1 + (1 << 16)].tolist()
                h[at : at + len(s)] = [digest(raw[i:j], SEED) for i, j in zip(s, e, strict=True)]
            yield h


def text_fingerprints(t: Texts, shingle: int) -> list[int]:
    """Fingerprint of each row."""
    return [fingerprint(h) for h in text_shingles(t, shingle)]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array(text_fingerprints(texts(b.column(1)), shingle), U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, fp bigint")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks, signed, of the bits that each key keeps: every choice of ``blocks - distance`` runs of bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    run = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    masks = [sum(c) for c in itertools.combinations(run, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _flips(fp: Column, mask: Column) -> Column:
    """The code itself and each code with one bit outside the mask flipped."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    free = F.filter(bits, lambda b: b.bitwiseAND(mask) == 0)
    return F.concat(F.array(fp), F.transform(free, lambda b: fp.bitwiseXOR(b)))


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, pairwise: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that differ in at most ``distance`` bits, enough of
    them to connect whatever such pairs connect. ``distance`` is 2: the codes of frequent keys are made for it."""
    if distance != 2:
        raise ValueError("only links at 2 bits are supported")
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, distance)])
    keyed = fps.select("fp", F.posexplode(masks).alias("k", "mask")).withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["k", "v"])
    few, many = met.filter(F.col("n") <= pairwise), met.filter(F.col("n") > pairwise)
    other = few.select("k", "v", F.col("fp").alias("a"))
    pairs = (
        few.select("k", "v", F.col("fp").alias("b")).join(other, ["k", "v"])
        .filter((F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    )
    coded = many.select("k", "v", "fp", F.explode(_flips(F.col("fp"), F.col("mask"))).alias("code"))
    least = coded.groupBy("k", "v", "code").agg(F.min("fp").alias("b"), F.max("fp").alias("c")).filter("b <> c")
    star = coded.join(least.drop("c"), ["k", "v", "code"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(star)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``; component_id is the least id reachable."""
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), distance))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group, that of the least id; columns and their order stay.

    Of several rows with the least id one stays. A group in which every id is null keeps one row; null sorts last.
    """
    keyed = with_key(docs, doc_id, text)
    with scratch(docs.sparkSession):
        rows = written(fingerprints(keyed, "_key", text, shingle).select("doc_id.id", "doc_id.h1", "doc_id.h2", "fp"), "fingerprints")
        return keep_least(docs, keyed, rows, lambda fps: components(links(fps, distance)))


def with_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` and ``_key``: a row is told by id and text, so nothing depends on how a scan numbers rows."""
    return docs.withColumn("_key", F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit("2"), F.col(text)).alias("h2")))


def keep_least(docs: DataFrame, keyed: DataFrame, rows: DataFrame, rooted_by: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each component ``(node, root)`` that ``rooted_by`` finds among the distinct ``fp`` of ``rows(id, h1, h2, fp)``, the row of the least id."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("first")
    fps = written(rows.groupBy("fp").agg(first), "distinct-fingerprints")
    roots = rooted_by(fps.select("fp"))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    stay = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = written(stay.select(F.struct("first.id", "first.h1", "first.h2").alias("_stay")), "representatives", keep=True)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = rows.groupBy(F.struct("id", "h1", "h2").alias("_again")).count().filter("count > 1").drop("count")
    again = written(stay.join(again, F.col("_stay").eqNullSafe(F.col("_again"))).select("_again"), "repeated", keep=True)
    kept = keyed.join(stay, F.col("_key").eqNullSafe(F.col("_stay")), "left_semi")
    if again.isEmpty():
        return kept.select(*columns)
    once = kept.join(again, F.col("_key").eqNullSafe(F.col("_again")), "left_anti").select(*columns)
    return once.union(kept.join(again, F.col("_key").eqNullSafe(F.col("_again")), "left_semi").dropDuplicates(["_key"]).select(*columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: fingerprints as 16 lower-case hex digits, and components."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
