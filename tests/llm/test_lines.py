"""Shared lines against brute force, in one range and in many."""

import hashlib
import random

import pytest

from marlstone.llm import lines

TABLE = str.maketrans(lines.UPPER, lines.LOWER)


def brute(rows, chars=20, docs=3):
    key = lambda line: line.strip(lines.SPACE).translate(TABLE)
    found = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                found.setdefault(key(line), set()).add(d)
    tops = {k: max(s, key=lambda d: (d is not None, d or 0)) for k, s in found.items() if len(s) >= docs}
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if key(x) not in tops or tops[key(x)] == d]
        out.append((d, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest(), "\n".join(left)))
    return out


def corpus(seed=3):
    draw = random.Random(seed)
    common = [f"A shared line of the documents, number {i}" for i in range(12)]
    own = lambda: f"a line of its own {draw.random()}"
    rows = []
    for d in range(120):
        body = [draw.choice([own(), draw.choice(common), "\t " + draw.choice(common).upper() + " \x0b", "short", "", "License line in a third of them all"]) for _ in range(draw.randint(1, 14))]
        rows.append((d, "\n".join(body)))
    rows += [(None, common[0] + "\n" + common[0]), (None, "x"), (500, None), (501, ""), (502, "\n\n"), (7, rows[7][1]), (7, "another text\n" + common[1]), (503, "éééééééééééééééééééé\nÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ"), (504, "éééééééééééééééééééé"), (505, "éééééééééééééééééééé"), (506, "0123456789012345678"), (507, "0123456789012345678"), (508, "0123456789012345678")]
    rows += [(600 + i, "twenty characters ab") for i in range(2)] + [(700, "\n".join(["License line in a third of them all"] * 300))]
    return rows


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_lines(spark, tmp_path, ranges):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, keep string, pos int").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = lines.op12_line_dedup(spark, str(tmp_path))
        assert got.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
        want = brute(rows)
        assert order(map(tuple, got.collect())) == order(r[:4] for r in want)
        texts = lines.drop_shared_lines(docs)
        assert texts.columns == ["doc_id", "text", "pos"]  # a column named like one made here goes
        assert order((r["doc_id"], r["text"]) for r in texts.collect()) == order((r[0], r[4]) for r in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r[2] for r in want) > 300


@pytest.mark.parametrize("docs", [2, 5])
def test_other_numbers_of_documents(spark, docs):
    rows = corpus(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lines.digests(frame, lines.keep_bitmaps(frame, min_chars=5, min_docs=docs))
    assert order(map(tuple, got.collect())) == order(r[:4] for r in brute(rows, 5, docs))


def test_string_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(x, "one line that all of them have") for x in "abc"], "doc_id string, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in lines.digests(frame, lines.keep_bitmaps(frame)).collect()} == {"a": 1, "b": 1, "c": 0}
    none = frame.filter("false")
    assert lines.digests(none, lines.keep_bitmaps(none)).collect() == []
    assert lines.drop_shared_lines(none).collect() == []
