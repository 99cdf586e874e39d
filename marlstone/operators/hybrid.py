"""Retrieval in one plan for all queries: lexical, hybrid, or hybrid with a reranker's verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fusion, search
from .matching import resolve_mode

Reranker = Callable[[DataFrame], DataFrame]


def hybrid(queries: DataFrame, chunks: DataFrame, dense_hits: DataFrame, relations: DataFrame | None, k: int = 8, candidates: int = 20) -> DataFrame:
    """``(query_id, chunk_id, pos, score, retrieval_source)``: fusion of the first ``candidates`` of each side, anchors before it, one-hop additions after it.

    ``chunks(chunk_id, record_id, chunk_type, text)``; positions within a record follow the chunk id."""
    lex = search.lexical_top_k(chunks, queries, candidates, weighted=False)
    fused = fusion.reciprocal_rank_fusion(lex, dense_hits.filter(F.col("rank") <= candidates), k)
    hits = fusion.inject(fused, fusion.anchors(queries, chunks, fusion.max_anchors(k)))
    if relations is None:
        return hits.select("query_id", "chunk_id", "pos", "score", "retrieval_source")
    order = Window.partitionBy("source").orderBy("relation", "target")
    edges = relations.withColumn("edge_pos", F.row_number().over(order))
    placed = chunks.select("chunk_id", "record_id", F.col("chunk_id").alias("chunk_pos"))
    seeds = hits.join(chunks.select("chunk_id", "record_id"), "chunk_id", "left")
    more = fusion.expand(seeds, edges, placed, max(2, k // 2)).select("query_id", "chunk_id", "pos", "score", F.lit("graph").alias("retrieval_source"))
    return hits.select("query_id", "chunk_id", "pos", "score", "retrieval_source").unionByName(more)


def retrieve(
    queries: DataFrame, chunks: DataFrame, mode: str = "auto", k: int = 6, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, relations: DataFrame | None = None, rerank: Reranker | None = None
) -> DataFrame:
    """``(query_id, chunk_id, pos, score, retrieval_source)``, with reranking also ``support``, of the first k hits of each query.

    Expansion is cut by k again where enough was fused before it; that is meant. ``rerank`` takes hits and gives verdicts."""
    mode = resolve_mode(mode, vectors is not None)
    if mode == "lexical":
        hits = search.lexical_top_k(chunks, queries, k, weighted=False)
        return hits.select("query_id", "chunk_id", F.col("rank").alias("pos"), "score", F.lit("lexical").alias("retrieval_source"))
    if vectors is None or query_vectors is None:
        raise ValueError(f"mode {mode!r} needs vectors of chunks and queries")
    candidates = max(20, 3 * k)
    near = search.dense_top_k(vectors, query_vectors, candidates, None)
    reranked = mode == "hybrid-rerank"
    hits = hybrid(queries, chunks, near, relations, max(k, 10) if reranked else k, candidates)
    if not reranked:
        return hits.filter(F.col("pos") <= k)
    if rerank is None:
        raise ValueError("mode 'hybrid-rerank' needs a reranker")
    seen = hits.filter(F.col("pos") <= fusion.RERANKED)
    out = fusion.apply_rerank(hits, rerank(seen), k)
    return out.select("query_id", "chunk_id", "pos", "score", "retrieval_source", "support")
