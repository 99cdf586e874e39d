"""Blocked search and contained words against the plain plans they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import dense, fusion, lexical, search


def texts(seed, n):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["common"] * 15
    return [" ".join(draw.choices(vocab, k=draw.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("weighted", [True, False])
def test_lexical_top_k(spark, kind, weighted, monkeypatch):
    monkeypatch.setattr(search, "SLICE", 16)  # many slices, so that bounds and ties between them count
    monkeypatch.setattr(search, "DENSE", 3)
    rows = list(enumerate(texts(1, 150))) + [(500 + i, "common w1 w2") for i in range(40)] + [(900, None), (901, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).repartition(3)
    queries = spark.createDataFrame([*enumerate(texts(2, 20)), (70, "nowhere else"), (71, None), (72, "common"), (73, "w1 w1 W2")], "query_id int, text string")
    plain = lexical.tfidf_scores(chunks, queries) if weighted else lexical.raw_scores(chunks, queries)
    want = lexical.top_k(plain, 5).select("query_id", "chunk_id", "score", "rank")
    got = search.lexical_top_k(chunks, queries, 5, weighted, block=7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("weighted", [True, False])
def test_many_queries_read_tokens_written_once(spark, kind, weighted, monkeypatch):
    for name, n in (("SLICE", 16), ("DENSE", 3), ("MANY", 2), ("FIRST", 20), ("GROUP", 3)):
        monkeypatch.setattr(search, name, n, raising=False)
    rows = list(enumerate(texts(1, 150))) + [(500 + i, "common w1 w2") for i in range(40)] + [(600, "w3 " * 50), (601, "common " * 90), (900, None), (901, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).repartition(3)
    queries = spark.createDataFrame([*enumerate(texts(2, 20)), (70, "nowhere else"), (71, None), (72, "common"), (73, "w1 w1 W2")], "query_id int, text string")
    plain = lexical.tfidf_scores(chunks, queries) if weighted else lexical.raw_scores(chunks, queries)
    want = lexical.top_k(plain, 5).select("query_id", "chunk_id", "score", "rank")
    got = search.lexical_top_k(chunks, queries, 5, weighted, block=12)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {p.rsplit("/", 2)[1].split("-")[0] for p in got.inputFiles()} == {"tokens", "longest"}


def test_dense_top_k(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE", 16)
    draw = random.Random(4)
    vectors = [(i, [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(120)] + [(200, None), (201, []), (202, [1.0, 2.0]), (203, [0.0] * 4), (204, [1.0, None, 0.0, 1.0])]
    table = spark.createDataFrame(vectors, "chunk_id long, vector array<double>").repartition(3)
    queries = table.filter("chunk_id % 10 = 0 OR chunk_id > 199").withColumnRenamed("chunk_id", "query_id")
    want = lexical.top_k(dense.cosine_scores(table, queries), 6).select("query_id", "chunk_id", "score", "rank")
    got = search.dense_top_k(table, queries, 6, block=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_sides(spark):
    none = spark.createDataFrame([], "query_id int, text string")
    some = spark.createDataFrame([(1, "a word")], "chunk_id int, text string")
    assert search.lexical_top_k(some, none, 3).collect() == []
    assert search.lexical_top_k(some.filter("false"), some.withColumnRenamed("chunk_id", "query_id"), 3).collect() == []


def test_contained_words(spark):
    draw = random.Random(7)
    words = sorted({"".join(draw.choices("abc", k=draw.randint(1, 5))) for _ in range(40)} | {"é", "a\nb", "abc", "abcabc"})
    rows = [(i, "".join(draw.choices("abcé \n", k=draw.randint(0, 60)))) for i in range(80)] + [(90, None), (91, "")]
    docs, vocabulary = spark.createDataFrame(rows, "id int, t string").repartition(3), spark.createDataFrame([(w,) for w in [*words, "", None, "abc"]], "w string")
    want = {(i, w) for i, t in rows if t is not None for w in words if w in t}
    for signs in (1 << 20, 20):
        got = [tuple(r) for r in fusion.contained(docs, vocabulary, "id", "t", "w", signs).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_containing_items(spark):
    bodies = [(1, "one two three four five six"), (2, "xone two three four fivex"), (3, "short"), (4, None), (5, "")]
    items = [(10, "one two three four five"), (11, "ort"), (12, ""), (13, "two three"), (14, None), (15, "not there at all, no")]
    docs, asked = spark.createDataFrame(bodies, "record_id int, body string"), spark.createDataFrame(items, "query_id int, text string")
    got = {tuple(r) for r in fusion.containing(docs, asked).collect()}
    assert got == {(q, d) for q, t in items if t is not None for d, b in bodies if b is not None and t in b}
