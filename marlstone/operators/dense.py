"""Dense retrieval and incremental upkeep of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine


class Embedder(Protocol):
    """Texts to vectors, and the number of tokens they took."""

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]: ...


class HashEmbedder:
    """Deterministic stand-in for a model: signed counts of hashed words."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]:
        import zlib

        out, used = [], 0
        for text in texts:
            v = [0.0] * self.dimensions
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
                used += 1
            out.append(v)
        return out, used


def cosine_scores(vectors: DataFrame, queries: DataFrame, digits: int | None = 6, chunk_id: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """``(query_id, chunk_id, score)`` of every vector against a stated set of query vectors.

    The set is the caller's list of queries, a handful whatever the corpus; no hint is given, so it is broadcast only if the
    optimiser finds it below the session's threshold."""
    q = queries.select("query_id", F.col("vector").alias("q"))
    score = cosine(F.col("q"), F.col("v"))
    pairs = vectors.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).alias("v")).crossJoin(q)
    return pairs.select("query_id", "chunk_id", (score if digits is None else F.round(score, digits)).alias("score"))


def refresh_vectors(previous: DataFrame, chunks: DataFrame, embedder: Embedder, model: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Vectors for exactly the given chunks: kept where hash, model and dimensions agree, embedded anew elsewhere.

    ``previous(chunk_id, content_hash, model, dimensions, vector)``, ``chunks(chunk_id, content_hash, text)``.
    Returns the new table and the plan's changes ``(chunk_id, change)`` with change kept, embedded or removed.
    """
    now = chunks.select("chunk_id", "content_hash", "text")
    same = previous.filter((F.col("model") == model) & (F.col("dimensions") == dimensions))
    kept = same.join(now.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
    todo = now.join(kept.select("chunk_id"), "chunk_id", "left_anti")
    fresh = todo.mapInPandas(_embedding(embedder, model, dimensions), previous.schema)
    removed = previous.join(now, "chunk_id", "left_anti").select("chunk_id", F.lit("removed").alias("change"))
    changes = kept.select("chunk_id", F.lit("kept").alias("change")).union(todo.select("chunk_id", F.lit("embedded").alias("change"))).union(removed)
    return kept.select(*previous.columns).unionByName(fresh), changes


def _embedding(embedder: Embedder, model: str, dimensions: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            vectors, _ = embedder.embed(p["text"].fillna("").tolist())
            if len(vectors) != len(p) or any(len(v) != dimensions for v in vectors):
                raise ValueError("the embedder returned another number or size of vectors than asked for")
            yield pd.DataFrame({"chunk_id": p["chunk_id"], "content_hash": p["content_hash"], "model": model, "dimensions": dimensions, "vector": vectors})

    return run
