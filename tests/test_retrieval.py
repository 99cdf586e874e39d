import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dense, evals, fusion, lexical

CHUNKS = [("v::core", "core", "python data python"), ("v::requirements", "requirements", "spark data"), ("v::source-fit", "source-fit", "python fit spark spark")]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, chunk_type string, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def by_hand(rows, query):
    qtf, n = Counter(query.split()), max(len(rows), 1)
    out = {}
    for cid, _, text in rows:
        tf = Counter(text.split())
        s = sum((1 + math.log(tf[t])) * (math.log((n + 1) / (sum(t in r[2].split() for r in rows) + 1)) + 1) * q for t, q in qtf.items() if tf[t])
        if s > 0:
            out[cid] = round(s, 6)
    return out


@pytest.mark.parametrize("fit", [False, True])
def test_tfidf_and_eligibility(spark, fit):
    rows = [r for r in CHUNKS if fit or r[1] != "source-fit"]
    got = lexical.tfidf_scores(lexical.eligible(chunks(spark), fit), queries(spark, "python spark python")).collect()
    assert {r["chunk_id"]: r["score"] for r in got} == by_hand(rows, "python spark python")


def test_raw_scores_and_ties(spark):
    got = lexical.top_k(lexical.raw_scores(chunks(spark), queries(spark, "data")), 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("v::core", 2.0), ("v::requirements", 2.0)]
    assert lexical.raw_scores(chunks(spark), queries(spark, "")).count() == 0


def test_index_upkeep(spark):
    index = lexical.postings(chunks(spark)).withColumn("entity_id", F.substring_index("chunk_id", "::", 1))
    assert lexical.remove_entities(index, spark.createDataFrame([("v",)], "entity_id string")).count() == 0
    again = lexical.replace_entities(index, index)
    assert sorted(map(str, again.select(*index.columns).collect())) == sorted(map(str, index.collect()))


def test_rrf(spark):
    hits = lambda *ids: spark.createDataFrame([(0, i, n) for n, i in enumerate(ids, 1)], "query_id int, chunk_id string, rank int")
    out = fusion.reciprocal_rank_fusion(hits("a", "b"), hits("b", "c"), 8).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["b", "a", "c"]
    assert [r["retrieval_source"] for r in out] == ["hybrid", "lexical", "dense"]
    assert math.isclose(out[0]["score"], 1 / 62 + 1 / 61)
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(hits("a"), hits("b"), 8, rrf_k=0)


def test_anchors_and_injection(spark):
    ev = spark.createDataFrame(
        [("skills::sql", "skills", "skill", "SQL\nx"), ("skills::r", "skills", "skill", "R\nx"), ("role-a::x", "role-a", "role_detail", "X\nPeriod: 2001"), ("role-b::canonical-employment-record", "role-b", "role_detail", "Y\nperiod"), ("role-c::n", "role-c", "role_detail", "none")],
        "chunk_id string, record_id string, chunk_type string, text string",
    )
    out = fusion.anchors(queries(spark, "Four years with MySQL", "years, SQL"), ev, 4).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in out] == [(0, "skills::sql"), (0, "role-b::canonical-employment-record"), (0, "role-a::x"), (1, "skills::sql")]
    hits = spark.createDataFrame([(0, "skills::sql", 1, 9.0, "lexical"), (0, "z", 2, 8.0, "lexical")], "query_id int, chunk_id string, rank int, score double, retrieval_source string")
    got = fusion.inject(hits, fusion.anchors(queries(spark, "sql"), ev, 4)).orderBy("pos").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("skills::sql", 1.0), ("z", 8.0)]
    assert [fusion.max_anchors(k) for k in (2, 6, 10)] == [2, 3, 4]


def test_expand(spark):
    hits = spark.createDataFrame([(0, "a1", "a", 1, 4.0)], "query_id int, chunk_id string, record_id string, pos int, score double")
    rel = spark.createDataFrame([("a", "references_metric", "ACH-1", 0), ("a", "links_to", "b", 1), ("a", "references_metric", "ACH-9", 2)], "source string, relation string, target string, edge_pos int")
    ch = spark.createDataFrame([("a1", "a", 0), ("achievement-metrics::ACH-1", "achievement-metrics", 0), ("b1", "b", 0), ("b2", "b", 1), ("b3", "b", 2)], "chunk_id string, record_id string, chunk_pos int")
    out = fusion.expand(hits, rel, ch, 8).orderBy("pos").collect()
    assert [(r["chunk_id"], r["score"], r["pos"]) for r in out] == [("achievement-metrics::ACH-1", 2.0, 2), ("b1", 2.0, 3), ("b2", 2.0, 4)]
    assert fusion.expand(hits, rel, ch, 1).count() == 1


def test_rerank(spark):
    hits = spark.createDataFrame([(0, c, n, 1.0) for n, c in enumerate("abcdefghij", 1)], "query_id int, chunk_id string, pos int, score double")
    v = spark.createDataFrame([(0, "b", 0, 50, "direct", ""), (0, "b", 1, 99, "direct", ""), (0, "a", 2, 50, "related", ""), (0, "c", 3, 90, "none", ""), (0, "j", 4, 100, "direct", ""), (0, "zz", 5, 100, "direct", "")], "query_id int, chunk_id string, verdict_pos int, relevance int, support string, reason string")
    out = fusion.apply_rerank(hits, v, 6).orderBy("pos").collect()
    assert [(r["chunk_id"], r["score"]) for r in out] == [("a", 50.0), ("b", 50.0)]


def test_dense_refresh(spark):
    schema = "chunk_id string, content_hash string, model string, dimensions int, vector array<double>"
    emb = dense.HashEmbedder(3)
    now = spark.createDataFrame([("a", "h1", "x y"), ("b", "h2", "z")], "chunk_id string, content_hash string, text string")
    first, changes = dense.refresh_vectors(spark.createDataFrame([], schema), now, emb, "m", 3)
    assert {r["change"] for r in changes.collect()} == {"embedded"} and first.count() == 2
    now2 = spark.createDataFrame([("a", "h1", "x y"), ("b", "h3", "w")], "chunk_id string, content_hash string, text string")
    _, changes = dense.refresh_vectors(first, now2, emb, "m", 3)
    assert {(r["chunk_id"], r["change"]) for r in changes.collect()} == {("a", "kept"), ("b", "embedded")}
    _, changes = dense.refresh_vectors(first, now, emb, "other", 3)
    assert {r["change"] for r in changes.collect()} == {"embedded"}
    scores = dense.cosine_scores(first, spark.createDataFrame([(0, [0.0, 0.0, 0.0])], "query_id int, vector array<double>")).collect()
    assert {r["score"] for r in scores} == {0.0}


def test_eval_suite(spark):
    stated = spark.createDataFrame([(1, False, None), (2, True, None), (3, True, None), (4, False, None)], "query_id int, negative boolean, max_proficiency string")
    labels = spark.createDataFrame([(1, "r1", "expected"), (3, "r9", "forbidden")], "query_id int, record_id string, kind string")
    hits = spark.createDataFrame([(1, "c0", 1, "r0"), (1, "c1", 2, "r1"), (3, "c9", 1, "r9")], "query_id int, chunk_id string, pos int, record_id string")
    rows = {r["query_id"]: r for r in evals.cases(stated, labels, hits, 6).collect()}
    assert (rows[1]["recall_at_k"], rows[1]["reciprocal_rank"]) == (1.0, 0.5)
    assert rows[2]["safe_negative"] and not rows[3]["safe_negative"] and rows[3]["forbidden_direct_hits"] == 1
    assert rows[4]["recall_at_k"] == 1.0 and rows[4]["passed"]
    s = evals.suite(evals.cases(stated, labels, hits, 6)).first()
    assert (s["case_count"], s["passed"], s["positive_mrr"], s["negative_safety_rate"]) == (4, 3, 0.25, 0.5)
