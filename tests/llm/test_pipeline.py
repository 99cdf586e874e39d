"""The pipeline against plain Python, stage by stage and as a whole."""

import random
import re

import corpus_pipeline
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import mixing, secrets

EN = "the of and to in that is was for with house water tree people made over under long short light".split()
DE = "der die und nicht ein ich über straße haus wasser baum leute machen lang kurz licht schnell".split()


def build(spark, root):
    draw = random.Random(11)
    rows = []
    for i in range(90):
        w = EN if i % 2 else DE
        rows.append((i, " ".join(f"{draw.choice(w)}{draw.choice(w)}" for _ in range(draw.randint(30, 90))), "en" if i % 2 else "de", f"src{i % 4}"))
    bench = [(0, " ".join(draw.choices(EN, k=25))), (1, " ".join(draw.choices(EN, k=12)))]
    rows += [(100, rows[3][1], "en", "src0"), (101, rows[3][1] + " ", "en", "src1"), (102, rows[4][1], "de", "src1"), (103, "1234 ### 567", "en", "src2"), (104, None, None, "src2"), (105, "", "de", None)]
    rows += [(110, rows[5][1] + " " + bench[0][1] + " " + rows[6][1], "en", "src3"), (111, 'key token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + rows[7][1][::-1], "en", "src3")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return rows, bench


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_pipeline(spark, tmp_path):
    root = str(tmp_path)
    rows, bench = build(spark, root)
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: r[3] for r in rows}
    ids = [i for i, t in text.items() if t and any(c.isalpha() for c in t)]
    fps = {i: fingerprint(text[i]) for i in ids}
    group = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
    ids = [i for i in ids if group[i] == i]
    grams = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    ids = [i for i in ids if not any(len(grams(b) & grams(text[i])) >= 0.8 * len(grams(b)) for _, b in bench)]
    assert 110 not in ids and 100 not in ids and 102 not in ids and 111 in ids
    masked = {i: re.sub(r'token = "[0-9a-f]{40}', "[secret]", text[i]) for i in ids}

    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, root)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs.write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
        if name == "secrets":
            got = {r["doc_id"]: r for r in docs.collect()}
            assert {i: r["text"] for i, r in got.items()} == masked and all(r["n_chars"] == len(r["text"]) for r in got.values())
    last = {r["doc_id"]: r["taken"] for r in docs.collect()}
    sizes = {s: sum(len(masked[i].split()) for i in ids if source[i] == s) for s in {source[i] for i in ids}}
    assert abs(sum(last.values()) - sum(sizes.values())) <= len(sizes) and set(last) <= set(ids)
    whole = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, root).collect()}
    assert whole == last


def test_extra_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "the house token=ABCDEFGHIJKLMNOP", "s", 7, "q"), (1, "the house token=ABCDEFGHIJKLMNOP", "s", 7, "q")], "doc_id long, text string, source string, taken int, `_row` string")
    model = secrets.Markov(secrets.random_strings(100), secrets.identifiers(["a"], 100))
    assert [r["text"] for r in secrets.redact(df, model).collect()] == ["the house [secret]"] * 2
    out = mixing.mix(df, carry=True)
    assert out.columns.count("taken") == 1 and "_row" in out.columns
    assert out.agg(F.sum("taken")).first()[0] == 6
