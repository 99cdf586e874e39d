"""Feeds are parsed and sources united once, not once for each place that names them."""

import re

from pyspark.sql import functions as F

from marlstone.operators import merge
from marlstone.plans import feeds as plans
from marlstone.sources import feeds


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_united_once(spark):
    ref = "array<array<struct<source_path:string,source_entry_index:int>>>"
    df = spark.createDataFrame([([[("b", 0), ("a", 1)], [("b", 0), (None, 1), ("a", None)]],), (None,)], f"x {ref}")
    out = df.select(merge.distinct_sources(F.flatten("x")).alias("y"))
    assert [r["y"] and [tuple(v) for v in r["y"]] for r in out.collect()] == [[("b", 0), ("a", 1), (None, 1), ("a", None)], None]
    assert plan(out).count("flatten(") == 1


def test_a_feed_is_parsed_once_a_shape(spark):
    text = '{"vacancies": [{"company": "A", "role_title": "R", "tech_stack": ["x"]}]}'
    files = spark.createDataFrame([("p", "h", text), ("q", "i", "{")], "source_path string, source_hash string, text string")
    adapted = feeds.adapt(feeds.check(feeds.envelope(files)))
    assert [(r["company"], r["tech_stack"]) for r in adapted.collect()] == [("A", ["x"])]
    assert len(re.findall("parse_?json", plan(adapted), re.I)) == 2


def test_files_of_one_small_table_are_many_tasks(spark):
    assert plans._files(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
