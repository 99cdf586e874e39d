"""Evaluation of retrieval on labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of proficiency in rising order.
PROFICIENCY = ("none", "familiarity", "working", "core")


def proficiency_rank(c: Column) -> Column:
    """0 to 3; unknown or null is 0."""
    return F.coalesce(F.greatest(F.array_position(F.array(*[F.lit(x) for x in PROFICIENCY]), F.lower(c)) - 1, F.lit(0)), F.lit(0)).cast("int")


def cases(stated: DataFrame, labels: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """A row for each case.

    ``stated(query_id, negative, max_proficiency)``; ``labels(query_id, record_id, kind)`` with kind expected or
    forbidden; ``hits(query_id, chunk_id, pos, record_id)`` and, if they were reranked, ``support``; optionally
    ``proficiency``. Recall is 1 where nothing is expected. A negative case is safe without hits, or, reranked, without
    direct ones; forbidden hits count likewise.
    """
    reranked = "support" in hits.columns
    top = hits.filter(F.col("pos") <= k)
    direct = F.col("support").eqNullSafe("direct") if reranked else F.lit(True)
    level = proficiency_rank(F.col("proficiency")) if "proficiency" in hits.columns else F.lit(0)
    marked = top.join(labels.withColumnRenamed("record_id", "lr").withColumnRenamed("query_id", "lq"), (F.col("query_id") == F.col("lq")) & (F.col("record_id") == F.col("lr")), "left")
    of_hits = marked.groupBy("query_id").agg(
        F.min(F.when(F.col("kind") == "expected", F.col("pos"))).alias("first_relevant"),
        F.countDistinct(F.when((F.col("kind") == "forbidden") & direct, F.col("pos"))).alias("forbidden_direct_hits"),
        F.count_if(direct).alias("counted"), F.max(level).alias("observed"),
    )
    expected = labels.filter("kind = 'expected'").groupBy("query_id").agg(F.count("*").alias("expected"))
    out = stated.join(expected, "query_id", "left").join(of_hits, "query_id", "left")
    recall = F.when(F.col("expected").isNull() | F.col("first_relevant").isNotNull(), 1.0).otherwise(0.0)
    safe = ~F.col("negative") | (F.coalesce("counted", F.lit(0)) == 0)
    modest = F.col("max_proficiency").isNull() | (F.coalesce("observed", F.lit(0)) <= proficiency_rank(F.col("max_proficiency")))
    bad = F.coalesce("forbidden_direct_hits", F.lit(0))
    return out.select(
        "query_id", "negative", recall.alias("recall_at_k"), F.coalesce(F.lit(1.0) / F.col("first_relevant"), F.lit(0.0)).alias("reciprocal_rank"),
        safe.alias("safe_negative"), modest.alias("proficiency_ok"), bad.alias("forbidden_direct_hits"), ((recall == 1.0) & safe & (bad == 0) & modest).alias("passed"),
    )


def suite(results: DataFrame) -> DataFrame:
    """One row of rates over all cases, rounded to four digits."""
    mean = lambda value, of: F.bround(F.coalesce(F.sum(F.when(of, value)), F.lit(0.0)) / F.greatest(F.count_if(of), F.lit(1)), 4)
    positive = ~F.col("negative")
    return results.agg(
        F.count("*").alias("case_count"), F.count_if("passed").alias("passed"), mean(F.col("passed").cast("double"), F.lit(True)).alias("pass_rate"),
        mean(F.col("recall_at_k"), positive).alias("positive_recall_at_k"), mean(F.col("reciprocal_rank"), positive).alias("positive_mrr"),
        mean(F.col("safe_negative").cast("double"), F.col("negative")).alias("negative_safety_rate"),
        F.coalesce(F.sum("forbidden_direct_hits"), F.lit(0)).alias("forbidden_direct_hit_count"),
    )
