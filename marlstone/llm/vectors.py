"""Product codes of vectors: each of equal parts of a vector is named by the nearest entry of that part's codebook.

Components become whole numbers, floor(scale * x), so that all sums and distances are exact and any order of work gives
the same codes. Codebooks start as parts of the first vectors and are mended in rounds: parts are assigned to their nearest entry in
Arrow batches, each task sums its parts an entry, one aggregation adds the tasks' sums, and the entries, whose size is
set by parameters (parts x entries x width), come to the driver and go out with the next round.

Nearest entries are found by lower bounds. A part is cut into blocks, first one, then twice as many a level. By the means of the blocks and
the norms of what is left of them, ``sum of n * (mean - mean')^2 + (residual - residual')^2`` over the blocks is at most the
squared distance. The coarsest bound orders entries: the least one's exact distance is a limit, entries whose bound is
above it go, the finer bounds filter those left, and survivors get exact distances, ties to the lower index. Bounds are
lowered by more than their rounding error, so that no nearest entry goes.

Cases: vectors that are null, hold null or non-finite components, or differ in length from the kept one of the least id go; so
do those with a component beyond +-32767, whose squared distances a long may not hold; of a length that parts don't
divide, all go. Ids may repeat (ties are ordered by vector) or be null (last); with fewer vectors than entries, codebooks are that much
smaller; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Largest size of a component that is kept.
LARGEST = 32767.0
#: Vectors worked on at once.
SLICE = 4096


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 8, scale: int = 4096) -> DataFrame:
    """``(vec_id, label, v)``: the vectors kept, in whole numbers."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)), F.lit(False)))
    whole = written(rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v")), "vectors-whole")
    least = whole.orderBy(F.col("vec_id").asc_nulls_last(), F.size("v"), "v").select(F.size("v").alias("n")).first()
    n = least["n"] if least and least["n"] % parts == 0 else 0
    return whole.filter((F.size("v") == n) & (F.size("v") > 0))


class Bounds:
    """Coarse-to-fine lower bounds of squared distances from parts to one codebook, ``entries`` of shape (k, width)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        width = entries.shape[1]
        self.counts = [1]
        while width % (2 * self.counts[-1]) == 0 and width // (2 * self.counts[-1]) > 1:
            self.counts.append(2 * self.counts[-1])
        self.levels = [self.outline(entries, n) for n in self.counts]

    @staticmethod
    def outline(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block means, times the root of the block's length, and residual norms; both (rows, blocks)."""
        cut = x.reshape(len(x), blocks, -1).astype(np.float64)
        n = cut.shape[2]
        mean = cut.mean(axis=2)
        return mean * np.sqrt(n), np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=2))

    @staticmethod
    def _lower(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        bound = ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2).sum(axis=-1)
        size = ((np.abs(a[0]) + np.abs(b[0])) ** 2 + (a[1] + b[1]) ** 2).sum(axis=-1)
        return bound - 1e-9 * size - 1e-6  # roundings are some 1e-15 of size

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of ``x``, and its exact squared distance."""
        of_x = self.outline(x, 1)
        bounds = self._lower((of_x[0][:, None], of_x[1][:, None]), (self.levels[0][0][None], self.levels[0][1][None]))
        guess = bounds.argmin(axis=1)
        limit = ((x - self.entries[guess]) ** 2).sum(axis=1)
        rows, entries = np.nonzero(bounds <= limit[:, None])
        for blocks, level in zip(self.counts[1:], self.levels[1:], strict=True):
            of_x = self.outline(x, blocks)
            near = self._lower((of_x[0][rows], of_x[1][rows]), (level[0][entries], level[1][entries])) <= limit[rows]
            rows, entries = rows[near], entries[near]
        exact = ((x[rows] - self.entries[entries]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])  # each row keeps its nearest entry, in order of index
        best = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == np.repeat(best, np.diff(np.r_[starts, len(rows)])))
        _, first = np.unique(rows[hits], return_index=True)
        return entries[hits[first]], best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Vectors of one length as (rows, parts, width)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _sums(books: list[np.ndarray]):
    """A task's sums and counts a part and entry."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(b) for b in books]
        total, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = _matrix(batch.column(0).slice(at, SLICE), parts)
                for p in range(parts):
                    code, _ = bounds[p].nearest(x[:, p])
                    np.add.at(total[p], code, x[:, p])
                    count[p] += np.bincount(code, minlength=len(count[p]))
        used = [(p, e) for p in range(parts) for e in range(len(count[p])) if count[p][e]]
        if used:
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(count[p][e]) for p, e in used], pa.int64()),
                pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
            ], ["part", "entry", "n", "total"])

    return run


def codebooks(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> list[np.ndarray]:
    """A codebook a part, (entries, width) whole numbers, of ``whole_vectors``; none if there are no vectors."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return []
    start = np.array([r["v"] for r in first], np.int64)
    width = start.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total"))
        for r in added.collect():  # parts x entries rows at most
            books[r["part"]][r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return books


def coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(vec_id, label, code, error)``: an index a part, two hex digits each, and the squared distance left."""
    parts = len(books)
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = _matrix(part.column(2), parts)
                found = [bounds[p].nearest(x[:, p]) for p in range(parts)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(sum(e for _, e in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry.tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: 8 parts, 16 entries, 6 rounds, over all embeddings."""
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = codebooks(vectors)
    return with_label_errors(coded(vectors, books), codebook_digest(books))


def with_label_errors(codes: DataFrame, digest: str) -> DataFrame:
    """``codes`` with the error summed over equal labels, nulls together, and the codebooks' digest."""
    codes = written(codes, "vectors-codes")
    labels = written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "vectors-labels")
    out = codes.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in SQL, a round a stage; every distance is taken."""
    step = """,
assigned{r} AS (
  SELECT x.row, x.part, x.v, arg_min(b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {k} + b.entry) AS entry
  FROM parted x JOIN books{r} b ON b.part = x.part GROUP BY x.row, x.part, x.v)"""
    mend = """,
means{n} AS (
  SELECT part, entry, list(m ORDER BY i) AS v
  FROM (SELECT part, entry, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
        FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM assigned{r}) GROUP BY part, entry, i) GROUP BY part, entry),
books{n} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{r} b LEFT JOIN means{n} m ON m.part = b.part AND m.entry = b.entry)"""
    sql = f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parted AS (
  SELECT row, p AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM whole, range({parts}) t(p)),
books0 AS (SELECT part, row - 1 AS entry, v FROM parted WHERE row <= {entries})"""
    for r in range(rounds):
        sql += step.format(r=r, k=entries) + mend.format(r=r, n=r + 1)
    sql += step.format(r=rounds, k=entries)
    return sql + f""",
measured AS (
  SELECT a.row, a.part, a.entry, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS e
  FROM assigned{rounds} a JOIN books{rounds} b ON b.part = a.part AND b.entry = a.entry),
codes AS (
  SELECT w.vec_id, w.label, string_agg(printf('%02x', m.entry), '' ORDER BY m.part) AS code, CAST(sum(m.e) AS BIGINT) AS error
  FROM measured m JOIN whole w ON w.row = m.row GROUP BY w.row, w.vec_id, w.label),
flat AS (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM books{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) FROM flat) AS codebooks_sha256
FROM codes
"""


OP13_SQL = _op13_sql()
