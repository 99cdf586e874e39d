"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_docs: int, allowed: Column | None = None, doc_id: str = "doc_id", text: str = "text", balanced: bool = False, sample_bytes: int = 32 << 20) -> DataFrame:
    """``(doc_id, text, y)`` of about ``sample_docs`` labelled documents and ``sample_bytes`` of their text at most, picked by a hash of the id.

    With ``balanced``, as many of each label where there are as many; a learner then has to put the prior right.
    ``allowed`` is a condition on labels (which has column ``doc_id``), such as a hold-out rule. Null labels, ids
    and texts don't take part; of several labels of an id the greatest counts. The picked ids, bounded by
    ``sample_docs``, are broadcast to one scan that sums the bytes of each id (all its rows, if it is repeated); ids are then
    taken in turn, each label's by hash, as long as they fit. Texts are taken whole or not at all.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y"), F.lit(0).alias("stratum")).filter("doc_id is not null and y is not null")
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id", "stratum").agg(F.max("y").alias("y"))
    if balanced:
        known = known.withColumn("stratum", F.col("y"))
    picked = bounded_sample(known, F.col("doc_id"), "stratum", sample_docs).select("doc_id", "y")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    found = rows.select("doc_id", F.octet_length("text").cast("long").alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.sum("n").alias("n")).collect()
    kept = within_bytes([(r["doc_id"], r["y"], r["n"]) for r in found], sample_bytes)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, f"doc_id {kind}, y double")), "doc_id")


def within_bytes(found: list[tuple[object, float, int]], most: int) -> list[tuple[object, float]]:
    """Of ``(id, label, bytes)`` those that fit in ``most`` bytes, labels in turn, each label's ids in an order by hash."""
    queues: dict[float, list[tuple[object, float, int]]] = {}
    for x in sorted(found, key=lambda x: (zlib.crc32(b"bytes:" + str(x[0]).encode()), str(x[0]))):
        queues.setdefault(x[1], []).append(x)
    out = []
    for turn in itertools.zip_longest(*(queues[y] for y in sorted(queues))):
        for x in turn:
            if x is not None and x[2] <= most:
                most -= x[2]
                out.append((x[0], x[1]))
    return out


def share(labels: DataFrame, label: str, allowed: Column | None = None) -> float | None:
    """Share of label 1 among all allowed labels; None if there are none."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return (known if allowed is None else known.filter(allowed)).agg(F.avg(F.col(label).cast("double"))).first()[0]


def ordered(table: pa.Table) -> pa.Table:
    """The collected sample in an order that depends on ids only, mixed by hash."""
    ids = [str(x) for x in table.column("doc_id").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(b"order:" + ids[i].encode()), ids[i], str(table.column("y")[i])))
    return table.take(pa.array(order, pa.int64()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
