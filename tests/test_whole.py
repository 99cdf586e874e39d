"""Queries over whole texts and whole query sets, against plain Python."""

import re

import pytest

from marlstone.plans import catalog

Q = catalog.queries()


def first_words(t):
    seen = {}
    for w in re.findall("[A-Za-z]+", t or ""):
        seen.setdefault(w.lower(), w)
    return " ".join(seen.values())


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    same = "please list every tool that we would need for the new harbour project, namely "
    turns = [(1, 0, "user", same + "cranes"), (1, 1, "assistant", "no"), (1, 2, "user", same + "Barges"), (1, 3, "user", "short  one"), (1, 4, "user", same + "barges"), (2, 0, "user", same * 3 + "zeppelin")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    texts = ["word Word " * 60 + "Zebra zebra lynx", None, "", "12 é", "the zeppelin and barges", "quartz opal jasper beryl garnet", *(f"filler number{i} text" for i in range(40))]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [(7, "unseen words only"), (30, "opal jasper beryl"), (50, "zeppelin and barges"), (100, "garnet"), (230, "nothing here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i % 7 + 1), 1.0, float(i % 3)]) for i in range(130)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, texts


def test_distinct_words_of_whole_texts(spark, root):
    d, texts = root
    got = {r["doc_id"]: r["words"] for r in Q["ordered_distinct_ci"](spark, d).collect()}
    assert got == {i: first_words(t) for i, t in enumerate(texts)} and got[0] == "word Zebra lynx"


def test_requirements_of_whole_turns(spark, root):
    d, _ = root
    got = sorted((r["vacancy_id"], r["req_pos"], r["requirement"][-12:].split(" ")[-1]) for r in Q["requirement_explode"](spark, d).collect())
    assert [(v, w) for v, _, w in got] == [(1, "one"), (1, "cranes"), (1, "Barges"), (2, "zeppelin")]
    cover = {(r["vacancy_id"], r["requirement"].split(" ")[-1]): r["coverage"] for r in Q["coverage_classify"](spark, d).collect()}
    assert cover[2, "zeppelin"] != "unsupported" and cover[1, "Barges"] != "unsupported" and cover[1, "one"] == "unsupported"
    assert {r["vacancy_id"]: r["n_requirements"] for r in Q["match_summary"](spark, d).collect()} == {1: 3, 2: 1}


def test_query_sets(spark, root):
    d, _ = root
    r = Q["eval_mrr_recall"](spark, d).first()
    assert r["case_count"] == 5 and r["passed"] == 5 and r["positive_mrr"] == 0.6
    for name in ("lexical_tfidf_topk", "lexical_raw_topk"):
        assert {x["query_id"] for x in Q[name](spark, d).collect()} == {50, 100}, name
    assert {x["query_id"] for x in Q["dense_cosine_topk"](spark, d).collect()} == {0, 50, 100}
    for name in ("rrf_fusion", "rrf_batch_queries"):
        assert {x["query_id"] for x in Q[name](spark, d).collect()} == {0, 50, 100}, name
    assert {x["query_id"] for x in Q["rerank_apply"](spark, d).collect()} <= {50, 100}
