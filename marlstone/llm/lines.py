"""Lines that many documents share are dropped from all but one; the verdict is a compressed bitmap a document.

A line's key is the line without white space at its ends, A-Z lower-cased. Lines whose key is long enough become
(hash of the key, document, position); texts stay where they are. These rows are dealt to ranges of (hash, document,
position), largest document first, and each range is read in that order as a stream: the first document of a hash keeps
its lines, and all others lose theirs once enough documents came by; rows of those before are held until then. A hash
that ranges share, however frequent, is the first of one of them: the rows of a range's first hash are passed on
undecided, with a witness for each of the first documents of its last one, and settled by a sum over these hashes, two
a range at most. Positions to drop become a bitmap of the lines to keep per document, deflated, and only that meets the text.

A document is told by its id and a hash of its text, so that rows alike in both share a verdict; a document holds a
key by its id alone. Cases: a null or empty text is one empty line; a null id is one document, smaller than all others;
several rows with one id are one document in the count; an empty table gives no rows; other columns are carried along,
those named like a column made here aside.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import shuffle_partitions, written

#: The white space that a key has none of at its ends.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINES = ["h1", "h2", "doc_id", "_doc", "_text", "pos", "n_lines"]


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in {doc_id, text, "doc_id", "text", "_text", "n_lines", "keep", "_id", "_of"}]
    return docs.select(F.col(doc_id).alias("doc_id"), said.alias("text"), *rest).withColumn("_text", F.xxhash64("text"))


def keyed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """``LINES`` for each line whose key has ``min_chars`` code points or more: two hashes of the key, the document, the line's place from 0."""
    rows = _named(docs.select(doc_id, text), doc_id, text).withColumn("line", F.split("text", "\n", -1))
    rows = rows.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("_doc"), "_text", F.size("line").alias("n_lines"), F.posexplode("line").alias("pos", "line"))
    rows = rows.withColumn("key", F.translate(F.btrim(F.col("line"), F.lit(SPACE)), UPPER, LOWER)).filter(F.length("key") >= min_chars)
    return rows.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit("line"), "key")}).select(*LINES)


def _streamed(min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a range in order, the rows to drop (hashes null), those undecided (with hashes), and witnesses (with hashes, position null)."""

    def decided(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(rows.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *rows.columns[2:]], LINES)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, docs, first = None, None, 0, True  # of the run that the last batch ended in
        held: list[pa.RecordBatch] = []
        witnesses: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            new_run = np.ones(len(h1), bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_run[0] = (h1[0], h2[0]) != key
            new_doc = new_run.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            new_doc[0] |= doc[0] != last
            run, seen, starts = np.cumsum(new_run), np.cumsum(new_doc), np.flatnonzero(new_run)
            number = seen - np.concatenate(([-docs], seen[starts] - 1))[run]  # of the document within its run, from 1
            total = np.concatenate(([docs], np.zeros(len(starts), np.int64)))  # documents of a run so far; run 0 is the one before
            np.maximum.at(total, run, number)
            of_first = (run == (1 if key is None else 0)) & first
            losing = ~of_first & (number >= 2)
            open_run = run == run[-1]
            enough = total[run] >= min_docs
            if held and (total[0] >= min_docs or run[-1] != 0):
                if total[0] >= min_docs:
                    yield from map(decided, held)
                held = []
            if (losing & enough).any():
                yield decided(batch.filter(pa.array(losing & enough)))
            if of_first.any():
                yield batch.filter(pa.array(of_first))
            if (waiting := losing & open_run & ~enough).any():
                held.append(batch.filter(pa.array(waiting)))
            if run[-1] != 0:
                witnesses = []
            if (seen_by := open_run & new_doc & (number <= min_docs)).any():
                witnesses.append(batch.filter(pa.array(seen_by)))
            first, key, last, docs = bool(of_first[-1]), (h1[-1], h2[-1]), doc[-1], int(number[-1])
        if key is not None and not first:
            for rows in witnesses:
                yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.nulls(rows.num_rows, pa.int32()), rows.column(6)], LINES)
            yield from held

    return stream


@F.pandas_udf(BinaryType())
def _bitmap(drops: pd.Series, n: pd.Series) -> pd.Series:
    """A bit a line, 1 to keep it, deflated."""

    def one(places: np.ndarray, lines: int) -> bytes:
        keep = np.ones(lines, bool)
        keep[places] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(d, k) for d, k in zip(drops, n, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, _text, n_lines, keep)`` of the documents that lose lines: keep is a bit a line, packed and deflated.

    Keys of ``min_chars`` code points found in ``min_docs`` documents or more lose all lines but those of the largest id. ``min_docs`` is 2 at least.
    """
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("_text"), F.col("pos")]
    rows = written(keyed_lines(docs, doc_id, text, min_chars), "lines-keyed")
    ranges = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    passed = written(ranges.mapInArrow(_streamed(min_docs), rows.schema), "lines-passed")
    open_rows = passed.filter("h1 is not null")
    holders = open_rows.groupBy("h1", "h2", "_doc").agg(F.max("doc_id").alias("doc_id"))
    settled = holders.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).filter(F.col("n") >= min_docs).drop("n")
    # Two hashes a range at most, so the table of those settled is as small as the number of partitions.
    more = open_rows.filter("pos is not null").join(F.broadcast(settled), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = passed.filter("h1 is null").select("doc_id", "_text", "pos", "n_lines").union(more.select("doc_id", "_text", "pos", "n_lines"))
    places = drops.groupBy("doc_id", "_text", "n_lines").agg(F.collect_set("pos").alias("drops"))
    return written(places.select("doc_id", "_text", "n_lines", _bitmap("drops", "n_lines").alias("keep")), "lines-bitmaps")


def kept_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without the lines that ``keep`` drops, its lines, and those dropped."""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    left = [x for x, bit in zip(lines, bits.tolist(), strict=True) if bit]
    return "\n".join(left), len(lines), len(lines) - len(left)


def _joined(docs: DataFrame, bitmaps: DataFrame, doc_id: str, text: str) -> DataFrame:
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "keep")
    named = _named(docs, doc_id, text)
    return named.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left").drop("_id", "_of", "_text")


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents with shared lines dropped from their text; all rows and other columns stay."""
    rows = _joined(docs, keep_bitmaps(docs, doc_id, text, min_chars, min_docs), doc_id, text)
    at = rows.columns.index("text"), rows.columns.index("keep")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [kept_lines(t, k)[0] for t, k in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            columns = list(batch.columns)
            columns[at[0]] = pa.array(left, batch.schema.field(at[0]).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = rows.mapInArrow(apply, rows.schema).drop("keep")
    return out.select(*(F.col("doc_id").alias(doc_id) if c == doc_id else F.col("text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c in {doc_id, text} or c in out.columns))


def digests(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of each document under its bitmap."""
    rows = _joined(docs.select(doc_id, text), bitmaps, doc_id, text).select("doc_id", "text", "keep")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [kept_lines(t, k) for t, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                lines, dropped = (pa.array([f[i] for f in found], pa.int64()) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), lines, dropped, pa.array([hashlib.sha256(f[0].encode()).hexdigest() for f in found], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(digest, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: keys of 20 code points in 3 documents, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, keep_bitmaps(docs))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
judged AS (
  SELECT keyed.*, (shared.k IS NULL OR keyed.doc_id IS NOT DISTINCT FROM shared.top) AS keep FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN keep THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN keep THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
