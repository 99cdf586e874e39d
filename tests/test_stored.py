"""The stored index against the plain plans, and how much of it a search leaves unread."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import lexical, stored
from tests.test_search import texts


@pytest.mark.parametrize("kind", ["long", "string"])
def test_same_rows_as_the_plain_plan(spark, kind, tmp_path):
    """Small shards are read whole here; reading in rounds is tested on a shard below."""
    rows = list(enumerate(texts(1, 300))) + [(500 + i, "common w1 w2") for i in range(40)] + [(900, None), (901, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").withColumn("chunk_id", F.col("chunk_id").cast(kind)).repartition(3)
    queries = spark.createDataFrame([*enumerate(texts(2, 20)), (70, "nowhere else"), (71, None), (72, "common"), (73, "w1 w1 W2"), (None, "w3 w4")], "query_id int, text string").filter("query_id IS NOT NULL")
    path = stored.build(chunks, f"{tmp_path}/i", shard=50, block=4, parts=5)
    for weighted, plain in ((True, lexical.tfidf_scores(chunks, queries)), (False, lexical.raw_scores(chunks, queries))):
        want = sorted(map(tuple, lexical.top_k(plain, 5).select("query_id", "chunk_id", "score", "rank").collect()))
        got = stored.top_k(spark, path, queries, 5, weighted, queries_a_pass=7)
        assert sorted(map(tuple, got.collect())) == want and want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [part" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_blocks_by_impact(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "hot " * (1 + i % 7) + f"w{i}") for i in range(100)], "chunk_id long, text string")
    path = stored.build(chunks, f"{tmp_path}/i", shard=1000, block=8)
    rows = spark.read.parquet(f"{path}/blocks").filter("term = 'hot'").orderBy("shard", "at").collect()
    assert sum(len(r["ids"]) for r in rows) == 100 and all(len(r["ids"]) <= 8 and r["top"] == r["tfs"][0] == max(r["tfs"]) for r in rows)
    for a, b in zip(rows, rows[1:]):
        assert a["shard"] != b["shard"] or (b["at"] == a["at"] + len(a["ids"]) and (-a["tfs"][-1], a["ids"][-1]) < (-b["top"], b["ids"][0]))
    assert {r["term"]: r["df"] for r in spark.read.parquet(f"{path}/terms").collect()} == {"hot": 100} | {f"w{i}": 1 for i in range(100)}


def test_empty_sides_and_unfinished_build(spark, tmp_path):
    some = spark.createDataFrame([(1, "a word here")], "chunk_id int, text string")
    path = stored.build(some, f"{tmp_path}/i")
    ask = some.withColumnRenamed("chunk_id", "query_id")
    assert [tuple(r)[:2] for r in stored.top_k(spark, path, ask, 3).collect()] == [(1, 1)]
    assert stored.top_k(spark, path, ask.filter("false"), 3).collect() == []
    assert stored.top_k(spark, path, ask.withColumn("text", F.lit(None).cast("string")), 3).collect() == []
    assert stored.top_k(spark, stored.build(some.filter("false"), f"{tmp_path}/none"), ask, 3).collect() == []
    stored_only = f"{tmp_path}/half"
    spark.read.parquet(f"{path}/blocks").write.partitionBy("part").parquet(f"{stored_only}/blocks")
    with pytest.raises(Exception):
        stored.top_k(spark, stored_only, ask, 3)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_stops_early_and_stays_exact(few):
    """A rare word decides: most of the frequent word's list is left unread, and all scores are as by adding up everything."""
    draw, n = random.Random(3), 5000
    held = {"often": {i: draw.choice([1, 1, 1, 2, 3, 9]) for i in range(n)}, "rare": {i: 1 + i % 3 for i in range(0, n, 500)}, "some": {i: 1 for i in range(0, n, 7)}}
    words, idf = sorted(held), np.array([1.0, 7.0, 2.5])
    rows = []
    for w in words:
        listed = sorted(held[w].items(), key=lambda p: (-p[1], p[0]))
        rows += [{"term": w, "at": b, "ids": [i for i, _ in listed[b : b + 16]], "tfs": [t for _, t in listed[b : b + 16]]} for b in range(0, len(listed), 16)]
    draw.shuffle(rows)
    asked = stored.Asked(words, idf, [["often", "rare", "some", "rare"], ["often"], ["some", "often"]])
    shard = stored.Shard(asked, pa.Table.from_pylist(rows), 16, few)
    for at, (own, often) in enumerate(asked.queries):
        total = {}
        for w, o in zip(own, often):
            for i, t in held[words[w]].items():
                total[i] = total.get(i, 0.0) + (1 + np.log(t)) * idf[w] * o
        want = sorted(((-round(s, 6), i) for i, s in total.items()))[:5]
        before = shard.read
        chunks, scores = shard.best(own, often, 5, 6)
        assert shard.ids.take(pa.array(chunks)).to_pylist() == [i for _, i in want] and scores.tolist() == pytest.approx([-s for s, _ in want])
        if at == 0 and not few:
            assert shard.read - before < n / 4 and shard.scored < n / 4
