"""Inverted index and lexical retrieval.

The index is a long table ``postings(term, chunk_id, tf)``. Retrieval is one plan for any number of queries: query terms
meet postings in an equi-join on the term, document frequencies are aggregated once, and scores are summed per query
and chunk. Query terms are the small side; whether they are broadcast is left to the optimiser, which checks sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens

#: Chunk types that are searched unless others are asked for.
DEFAULT_CHUNK_TYPES = ("core", "requirements")


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(term, chunk_id, tf)``; chunks without a token have no row."""
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """``(query_id, term, qtf)``."""
    words = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def eligible(chunks: DataFrame, include_source_fit: bool = False, chunk_type: str = "chunk_type") -> DataFrame:
    """Chunks that take part. The filter comes before counting, so it changes document frequencies and their total."""
    return chunks if include_source_fit else chunks.filter(F.col(chunk_type).isin(*DEFAULT_CHUNK_TYPES))


def wanted(chunks: DataFrame, terms: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """Postings of the query terms only: other words are dropped before the aggregation."""
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(tokens(F.col(text))).alias("term"))
    return words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def tfidf_scores(chunks: DataFrame, queries: DataFrame, chunk_id: str = "chunk_id", text: str = "text", query_id: str = "query_id", query_text: str = "text", digits: int = 6) -> DataFrame:
    """``(query_id, chunk_id, score)``: sum of (1 + ln tf) (ln((N + 1) / (df + 1)) + 1) qtf, rounded."""
    terms = query_terms(queries, query_id, query_text)
    index = wanted(chunks, terms, chunk_id, text)
    total = chunks.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0).alias("idf"))
    weight = (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf") * F.col("qtf")
    scored = index.join(terms.join(idf, "term"), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), digits).alias("score"))
    return scored.filter("score > 0")


def raw_scores(chunks: DataFrame, queries: DataFrame, chunk_id: str = "chunk_id", text: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """``(query_id, chunk_id, score)``: sum of (1 + tf) qtf; no idf, no rounding."""
    terms = query_terms(queries, query_id, query_text)
    index = wanted(chunks, terms, chunk_id, text)
    return index.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.sum((F.col("tf") + 1) * F.col("qtf")).cast("double").alias("score"))


def top_k(scores: DataFrame, k: int, by: Column | None = None) -> DataFrame:
    """The k best of each query with their rank; ties by chunk id. ``row_number <= k`` becomes a group limit before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if by is None else by, F.asc("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def replace_entities(index: DataFrame, changed: DataFrame, entity: str = "entity_id") -> DataFrame:
    """The index with all rows of the changed entities exchanged for ``changed`` (same columns)."""
    return remove_entities(index, changed.select(entity).distinct(), entity).unionByName(changed)


def remove_entities(index: DataFrame, gone: DataFrame, entity: str = "entity_id") -> DataFrame:
    """The index without the entities of ``gone``; terms left without a chunk vanish with their rows."""
    return index.join(gone.select(entity).distinct(), entity, "left_anti")
