"""Passing tables of a stage go with it; only what its result reads stays."""

import os

from pyspark.sql import functions as F

from marlstone.llm import minhash, simhash, widehash
from marlstone.llm.common import CLEANUP, scratch, shared_dir, written


def tables(spark):
    folder = shared_dir(spark).removeprefix("file://") + "/marlstone"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_within_are_deleted_but_those_kept(spark):
    was = tables(spark)
    with scratch(spark):
        a = written(spark.range(3), "a")
        with scratch(spark):
            b, c = written(a, "b"), written(a, "c", keep=True)
            assert b.count() == 3
        assert {x[0] for x in tables(spark) - was} == {"a", "c"}
    assert {x[0] for x in tables(spark) - was} == {"c"} and c.count() == 3
    assert spark.conf.get(CLEANUP) == "false"


def test_near_duplicates_leave_no_sets(spark):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("id") % 20) * 100 + i)))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), text.alias("text"))
    for how in (widehash, minhash, simhash):
        was = tables(spark)
        kept = how.keep_representatives(docs)
        assert {x.rsplit("-", 1)[0] for x in tables(spark) - was} == {"representatives", "repeated"}, how
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20)), how
