"""Retrieval queries: index, lexical and dense ranking, fusion, anchors, expansion, rerank, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evals, fusion, lexical, search, stored
from ..sources.state import work_dir
from .registry import registry
from .sqlkit import fold, table, tokens

QUERIES, SQL, query = registry()


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of searches: test items whose id is divisible by 50."""
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


POSTINGS_SQL = f"SELECT term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL"
TERMS_SQL = f"SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark WHERE item_id % {{n}} = 0) GROUP BY ALL"
TFIDF_SQL = f"""
p AS ({POSTINGS_SQL}), q AS ({TERMS_SQL}), n AS (SELECT greatest(count(*), 1) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
tfidf AS (SELECT q.query_id, p.chunk_id, round(sum((1 + ln(p.tf)) * (ln((n.n + 1) / (df.df + 1)) + 1) * q.qtf), 6) AS score
          FROM p JOIN q USING (term) JOIN df USING (term), n GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM tfidf WHERE score > 0)
"""
DENSE_SQL = """
dq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT dq.query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], dq.q), 6) AS score FROM embeddings e, dq),
den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)
"""
RRF_SQL = """
both_sides AS (SELECT query_id, chunk_id, rank, 'lexical' AS side FROM lex WHERE rank <= 20
               UNION ALL SELECT query_id, chunk_id, rank, 'dense' FROM den WHERE rank <= 20),
rrf AS (SELECT query_id, chunk_id, max(rank) FILTER (side = 'lexical') AS lexical_rank, max(rank) FILTER (side = 'dense') AS dense_rank,
               coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (side = 'lexical'), 0) + coalesce(sum(1.0::DOUBLE / (60 + rank)) FILTER (side = 'dense'), 0) AS score,
               CASE WHEN count(*) = 2 THEN 'hybrid' ELSE min(side) END AS retrieval_source
        FROM both_sides GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rrf)
"""


@query(f"SELECT term, chunk_id, tf FROM ({POSTINGS_SQL})")
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(_docs(spark, sf_dir))


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM ({POSTINGS_SQL}) GROUP BY term")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(_docs(spark, sf_dir)))


@query(f"WITH {TFIDF_SQL.format(n=50)} SELECT query_id, chunk_id, score, rank FROM lex WHERE rank <= 10")
def lexical_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_top_k(_docs(spark, sf_dir), asked(spark, sf_dir), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint"))


@query(f"""WITH p AS ({POSTINGS_SQL}), q AS ({TERMS_SQL.format(n=50)}),
s AS (SELECT query_id, chunk_id, CAST(sum((1 + tf) * qtf) AS DOUBLE) AS score FROM p JOIN q USING (term) GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 8""")
def lexical_raw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_top_k(_docs(spark, sf_dir), asked(spark, sf_dir), 8, weighted=False).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {DENSE_SQL} SELECT query_id, chunk_id, score, rank FROM den WHERE rank <= 10")
def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_top_k(vectors(spark, sf_dir), asked_vectors(spark, sf_dir), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("bigint"))


def _fuse(spark: SparkSession, sf_dir: str, lex: DataFrame, aimed: DataFrame, k: int) -> DataFrame:
    den = search.dense_top_k(vectors(spark, sf_dir), aimed, 20)
    out = fusion.reciprocal_rank_fusion(lex, den, k)
    return out.select("query_id", "chunk_id", F.col("rank").cast("bigint"), F.round("score", 9).alias("score"), F.col("lexical_rank").cast("bigint"), F.col("dense_rank").cast("bigint"), "retrieval_source")


@query(f"WITH {TFIDF_SQL.format(n=50)}, {DENSE_SQL}, {RRF_SQL} SELECT query_id, chunk_id, rank, round(score, 9) AS score, lexical_rank, dense_rank, retrieval_source FROM fused WHERE rank <= 8")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuse(spark, sf_dir, search.lexical_top_k(_docs(spark, sf_dir), asked(spark, sf_dir), 20), asked_vectors(spark, sf_dir), 8)


@query(f"WITH {TFIDF_SQL.format(n=1)}, {DENSE_SQL}, {RRF_SQL} SELECT query_id, chunk_id, rank, round(score, 9) AS score, lexical_rank, dense_rank, retrieval_source FROM fused WHERE rank <= 10")
def rrf_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query, its words read from a stored index that is built here."""
    path = stored.build(_docs(spark, sf_dir), f"{work_dir(spark)}/index-{uuid.uuid4().hex}")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _fuse(spark, sf_dir, stored.top_k(spark, path, items, 20), asked_vectors(spark, sf_dir), 10)


#: Parts stand for queries, the kinds of part that names end in for skills, suppliers for roles.
ANCHORS_SQL = rf"""
WITH q AS (SELECT p_partkey AS query_id, regexp_replace(trim({fold("p_name")}), '\s+', ' ', 'g') || CASE WHEN p_size % 10 = 0 THEN ' for 5 years' ELSE '' END AS q FROM part),
skills AS (SELECT DISTINCT 'skills::' || split_part(p_name, ' ', 2) AS chunk_id, lower(split_part(p_name, ' ', 2)) AS title FROM part),
roles AS (SELECT 'role-' || s_suppkey || CASE WHEN s_suppkey % 7 = 0 THEN '::canonical-employment-record' ELSE '::detail' END AS chunk_id, s_suppkey % 7 = 0 AS canon FROM supplier WHERE s_suppkey % 3 = 0),
a AS (SELECT query_id, chunk_id, 0 AS prio, 'exact_named_skill' AS reason FROM q JOIN skills ON length(title) >= 2 AND contains(q.q, title)
      UNION ALL SELECT query_id, chunk_id, CASE WHEN canon THEN 1 ELSE 2 END, 'career_chronology' FROM q, roles WHERE list_has_any(string_split(q.q, ' '), ['anos', 'years', 'year', 'yrs']))
SELECT query_id, chunk_id, pos, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prio, chunk_id) AS pos FROM a) WHERE pos <= 4
"""


@query(ANCHORS_SQL)
def anchors_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    more = F.when(F.col("p_size") % 10 == 0, " for 5 years").otherwise("")
    queries = part.select(F.col("p_partkey").alias("query_id"), F.concat("p_name", more).alias("text"))
    kind = F.substring_index("p_name", " ", -1)
    skills = part.select(F.concat(F.lit("skills::"), kind).alias("chunk_id"), F.lit("skills").alias("record_id"), F.lit("skill").alias("chunk_type"), F.concat(kind, F.lit("\nlevel")).alias("text")).distinct()
    sup = table(spark, sf_dir, "supplier")
    tail = F.when(F.col("s_suppkey") % 7 == 0, "::canonical-employment-record").otherwise("::detail")
    text = F.when(F.col("s_suppkey") % 3 == 0, "Period: 2001").otherwise("No dates")
    roles = sup.select(F.concat(F.lit("role-"), F.col("s_suppkey"), tail).alias("chunk_id"), F.concat(F.lit("role-"), F.col("s_suppkey")).alias("record_id"), F.lit("role_detail").alias("chunk_type"), text.alias("text"))
    return fusion.anchors(queries, skills.unionByName(roles), 4).select("query_id", "chunk_id", F.col("pos").cast("bigint"), "reason")


EXPAND_SQL = """
WITH hits AS (SELECT o_custkey AS query_id, 'o' || o_orderkey AS chunk_id, 'o' || o_orderkey AS record_id, o_totalprice AS score,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
e AS (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, min(l_linenumber * 1000000 + l_partkey) AS edge_pos FROM lineitem GROUP BY ALL),
c AS (SELECT 'p' || p_partkey AS target, 'p' || p_partkey || '::' || n AS candidate, n FROM part, range(1, 3) t(n)),
met AS (SELECT h.query_id, h.chunk_id AS seed, h.pos, h.score, e.edge_pos, c.n, c.candidate FROM hits h JOIN e ON e.source = h.record_id JOIN c USING (target)),
once AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id, candidate ORDER BY pos, edge_pos, n) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, edge_pos, n) AS k FROM once),
l AS (SELECT query_id, max(pos) AS last FROM hits GROUP BY query_id)
SELECT query_id, candidate AS chunk_id, last + k AS pos, score * 0.5 AS score, seed AS seed_chunk_id, 'links_to' AS relation FROM k JOIN l USING (query_id) WHERE k <= 5
"""


@query(EXPAND_SQL)
def graph_expand_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    name = F.concat(F.lit("o"), F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    hits = orders.select(F.col("o_custkey").alias("query_id"), name.alias("chunk_id"), name.alias("record_id"), F.col("o_totalprice").alias("score"), F.row_number().over(order).alias("pos"))
    edges = lines.groupBy(F.concat(F.lit("o"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target")).agg(F.min(F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("edge_pos"))
    record = F.concat(F.lit("p"), F.col("p_partkey"))
    chunks = part.select(record.alias("record_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("chunk_pos")).withColumn("chunk_id", F.concat_ws("::", "record_id", F.col("chunk_pos").cast("string")))
    out = fusion.expand(hits, edges.withColumn("relation", F.lit("links_to")), chunks, 5)
    return out.select("query_id", "chunk_id", F.col("pos").cast("bigint"), "score", "seed_chunk_id", "relation")


RERANK_SQL = f"""
WITH {TFIDF_SQL.format(n=50)},
v AS (SELECT *, CAST((chunk_id * 37 + query_id) % 101 AS INTEGER) AS relevance, CASE chunk_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'related' ELSE 'none' END AS support FROM lex WHERE rank <= 8)
SELECT query_id, chunk_id, pos, pre_rerank_score, relevance, support, CAST(relevance AS DOUBLE) AS score FROM (
  SELECT query_id, chunk_id, score AS pre_rerank_score, relevance, support, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS pos FROM v WHERE support <> 'none') WHERE pos <= 6
"""


@query(RERANK_SQL)
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, asked(spark, sf_dir))


def _reranked(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    hits = search.lexical_top_k(_docs(spark, sf_dir), items, 12).withColumnRenamed("rank", "pos")
    support = F.when(F.col("chunk_id") % 3 == 0, "direct").when(F.col("chunk_id") % 3 == 1, "related").otherwise("none")
    verdicts = hits.select("query_id", "chunk_id", F.col("pos").alias("verdict_pos"), ((F.col("chunk_id") * 37 + F.col("query_id")) % 101).cast("int").alias("relevance"), support.alias("support"), F.lit("stated").alias("reason"))
    out = fusion.apply_rerank(hits, verdicts, 6)
    return out.select("query_id", "chunk_id", F.col("pos").cast("bigint"), "pre_rerank_score", "relevance", "support", "score")


EVAL_SQL = f"""
WITH {TFIDF_SQL.format(n=1)},
rel AS (SELECT item_id AS query_id, doc_id AS record_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT l.query_id, l.rank, r.record_id IS NOT NULL AS relevant FROM lex l LEFT JOIN rel r ON r.query_id = l.query_id AND r.record_id = l.chunk_id WHERE l.rank <= 6),
c AS (SELECT b.item_id AS query_id, (SELECT count(*) FROM rel WHERE rel.query_id = b.item_id) AS expected,
             (SELECT min(rank) FROM h WHERE h.query_id = b.item_id AND relevant) AS first FROM benchmark b),
e AS (SELECT CASE WHEN expected = 0 OR first IS NOT NULL THEN 1.0 ELSE 0.0 END AS recall, coalesce(1.0 / first, 0.0) AS rr FROM c)
SELECT count(*) AS case_count, CAST(sum(CASE WHEN recall = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed,
       round_even(CAST(sum(CASE WHEN recall = 1 THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1), 4) AS pass_rate,
       round_even(CAST(sum(recall) AS DOUBLE) / greatest(count(*), 1), 4) AS positive_recall_at_k, round_even(CAST(sum(rr) AS DOUBLE) / greatest(count(*), 1), 4) AS positive_mrr,
       0.0::DOUBLE AS negative_safety_rate, 0::BIGINT AS forbidden_direct_hit_count
FROM e
"""


@query(EVAL_SQL)
def eval_mrr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a case; a document that contains it is expected."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("body"))
    hits = search.lexical_top_k(_docs(spark, sf_dir), items, 6).select("query_id", "chunk_id", F.col("rank").alias("pos"), F.col("chunk_id").alias("record_id"))
    # An expected hit only counts if it is found, so only documents among the hits and those that share the item's words can be one.
    relevant = fusion.containing(docs, items).select("query_id", "record_id", F.lit("expected").alias("kind"))
    cases = items.select("query_id", F.lit(False).alias("negative"), F.lit(None).cast("string").alias("max_proficiency"))
    return evals.suite(evals.cases(cases, relevant, hits, 6))
