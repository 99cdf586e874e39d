"""Benchmark decontamination: which documents contain a test item.

An item is the set of its five-word shingles; a document contains it if it holds at least ``threshold`` of them. An
item of fewer words is one shingle, its whole sequence of words.
Short items in long documents have a tiny resemblance, so the search is for containment: items are partitioned by size
(powers of two of their shingle count), and each gets a bottom-k MinHash sketch, its k shingles of least hash. With
u the largest size of the partition, k is u - ceil(threshold * u) + 1: a document that holds enough of the item lacks
fewer than k of its shingles, so it holds one of the sketch. Documents are searched by the sketches alone, which loses
nothing at any size; only a document that holds a sketch shingle of some item has all its shingles looked up, and the
text of those decides.

The items are the query set. They are worked in blocks of bounded size (``block_bytes`` of item text), each broadcast
to one map-only pass over the documents: no shuffle, no join, a task's memory independent of the corpus. Blocks are read
and packed one at a time, but their broadcasts stay until the query has run, and each costs a pass: time grows with the
number of blocks, so the plan is meant for test sets of up to some hundred MB.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Cases: null and empty texts contain nothing, and items without
words are in nothing; repeated rows on either side each give their rows; null ids are carried; very long texts are
scanned in blocks; empty tables give no rows; other columns are carried by ``drop_contaminated`` and ignored by
``contained_items``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_bytes
from .textscan import LOWER, Texts, U, Words, gram_hash, hash_words, pieces, slices, texts, words

SHINGLE = 5
_BITS = 20


def sketch_size(n: int, threshold: float) -> int:
    """k for an item of n shingles, by the upper bound of its size partition."""
    upper = (1 << n.bit_length()) - 1
    return min(n, upper - math.ceil(threshold * upper) + 1)


class _Look:
    """A set of hashes with a bitmap before the search."""

    def __init__(self, hashes: set[int]):
        self.hashes = np.array(sorted(hashes), U)
        self.mark = np.zeros(1 << _BITS, bool)
        self.mark[self.hashes >> U(64 - _BITS)] = True

    def within(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` whose hash is in the set."""
        at = np.flatnonzero(self.mark[h >> U(64 - _BITS)])
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)] == h[at]] if len(self.hashes) else at[:0]


class Items:
    """A block of items: sketches by words a shingle, all shingle hashes, and shingle text to the items that have it."""

    def __init__(self, ids: pa.Array, column: pa.Array, threshold: float):
        self.ids, self.threshold = ids, threshold
        t = texts(column)
        low = LOWER[t.data]
        w = words(Texts(low, t.offsets))
        each = hash_words(low, w)
        grams = {n: gram_hash(each, n) for n in range(1, SHINGLE + 1)}
        self.shingles: dict[bytes, list[int]] = {}
        self.sketch: dict[bytes, set[int]] = {}
        self.sizes: list[int] = []
        sketched: dict[int, set[int]] = {}
        every: set[int] = set()
        for i in range(len(ids)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            n = min(SHINGLE, b - a)
            own = {_joined(low, w, p, n): int(grams[n][p]) for p in range(a, b - n + 1)} if n else {}
            self.sizes.append(len(own))
            every.update(own.values())
            for s in own:
                self.shingles.setdefault(s, []).append(i)
            for s in sorted(own, key=lambda s: (own[s], s))[: sketch_size(len(own), threshold)] if own else ():
                self.sketch.setdefault(s, set()).add(i)
                sketched.setdefault(n, set()).add(own[s])
        self.looks = {n: _Look(h) for n, h in sorted(sketched.items())}
        self.every = _Look(every)

    def find(self, t: Texts) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) wherever a row holds enough of an item."""
        for first, _, part in pieces(t) if self.looks else ():
            low = LOWER[part.data]
            w = words(Texts(low, part.offsets))
            each, owner = hash_words(low, w), w.rows()
            grams = {n: gram_hash(each, n) for n in self.looks}
            met: dict[int, set[int]] = {}
            for n, look in self.looks.items():
                at = look.within(grams[n])
                for p in at[owner[at] == owner[at + n - 1]].tolist():
                    if found := self.sketch.get(_joined(low, w, p, n)):
                        met.setdefault(int(owner[p]), set()).update(found)
            for row in sorted(met):
                a, b = int(w.first[row]), int(w.first[row + 1])
                shared: Counter[int] = Counter()
                for n in self.looks:
                    if b - a >= n:
                        held = {_joined(low, w, a + p, n) for p in self.every.within(grams[n][a : b - n + 1]).tolist()}
                        shared.update(i for s in held for i in self.shingles.get(s, ()) if i in met[row])
                for i in sorted(shared):
                    if shared[i] / self.sizes[i] >= self.threshold:
                        yield first + row, i, shared[i]


def _joined(low: np.ndarray, w: Words, at: int, n: int) -> bytes:
    """``n`` words from word ``at`` on, joined by one space."""
    return b" ".join(low[w.starts[at] : w.ends[at + n - 1]].tobytes().split())


def item_blocks(items: DataFrame, item_id: str, text: str, threshold: float, block_bytes: int) -> Iterator[Items]:
    """Blocks of about ``block_bytes`` of item text, dealt by hash, packed one at a time."""
    picked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    blocks = text_bytes(picked) // block_bytes + 1
    dealt = picked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        got = dealt.filter(F.col("block") == b).select("item_id", "text").toArrow()
        if got.num_rows:
            column = got.column("text").combine_chunks()
            yield Items(got.column("item_id").combine_chunks(), column, threshold)


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each document and item that it contains: doc_id, item_id, item_shingles, shared_shingles, containment."""
    spark = docs.sparkSession
    left = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_kind, item_kind = left.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, item_shingles bigint, shared_shingles bigint, containment double"
    out = None
    for block in item_blocks(items, item_id, item_text, threshold, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                hits = list(items.find(texts(b.column(1))))
                if not hits:
                    continue
                rows, at, n = (list(x) for x in zip(*hits, strict=True))
                sizes = [items.sizes[i] for i in at]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), items.ids.take(pa.array(at)),
                     pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x / y for x, y in zip(n, sizes, strict=True)], pa.float64())],
                    names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"],
                )

        got = left.mapInArrow(scan, schema)
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns and their order stay."""
    spark = docs.sparkSession
    place = docs.columns.index(text)
    for block in item_blocks(items, item_id, item_text, threshold, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _, _ in shared.value.find(texts(b.column(place)))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all benchmark items against all documents."""
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(5, len(w)) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS s FROM bn),
ns AS (SELECT DISTINCT n FROM bs),
ds AS (
  SELECT doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS s
  FROM d, ns WHERE len(w) >= n),
z AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, any_value(z.item_shingles) AS item_shingles, count(*) AS shared_shingles,
       count(*) / any_value(z.item_shingles) AS containment
FROM ds JOIN bs USING (n, s) JOIN z ON z.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id HAVING count(*) / any_value(z.item_shingles) >= 0.8
"""
