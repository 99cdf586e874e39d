"""Samples by stratum: no value is left out."""

import random

from pyspark.sql import functions as F

from marlstone.llm import common, language


def test_every_language_is_trained(spark):
    draw = random.Random(5)
    rows = []
    for k in range(70):
        stems = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(20)]
        rows += [(len(rows) + i, " ".join(draw.choices(stems, k=60)), f"l{k:02}") for i in range(8 if k < 64 else 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.langs == [f"l{k:02}" for k in range(70)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    rare = [(i, lang) for i, _, lang in rows if lang >= "l64"]
    assert sum(got[i] == lang for i, lang in rare) >= 0.95 * len(rare)


def test_more_values_than_rows_asked(spark):
    df = spark.range(3000).select("id", (F.col("id") % 300).cast("string").alias("s"))
    got = common.bounded_sample(df, F.col("id"), "s", 100)
    assert got.columns == ["id", "s"] and got.select("s").distinct().count() == 300 and got.count() <= 400
    assert abs(common.bounded_sample(df, F.col("id"), "s", 1500).count() - 1500) < 200
