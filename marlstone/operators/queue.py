"""Bounded, idempotent work queue; budgets; ordered unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Statuses that end an entry, and the one that a retry takes up again.
DEFERRED = "DEFERRED_CAP"
FAILED = "FAILED_REVIEW_REQUIRED"
TERMINAL = ("PASS", "COMPLETED_BELOW_TARGET", "SKIPPED_NOT_ELIGIBLE", "FAILED_REVIEW_REQUIRED")


def ordered_union(*parts: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Keys of the parts, one part after the other, each key where it comes first; blank keys are dropped. Adds ``pos``."""
    tagged = [p.select(F.col(key), F.lit(i).alias("_part"), (F.col(order) if order else F.col(key)).cast("string" if not order else p.schema[order].dataType.simpleString()).alias("_at")) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged).filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    first = rows.groupBy(key).agg(F.min(F.struct("_part", "_at")).alias("x"))
    return first.select(key, F.row_number().over(Window.orderBy("x._part", "x._at", key)).alias("pos"))


def fingerprint(*columns: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def group_fingerprint(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """A digest of each group's rows in a stated order; the group's rows are small structs, not texts."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n"), 256).alias("fingerprint"))


def plan_batch(queue: DataFrame, cap: int, retry_failed: bool = False, key: str = "vacancy_id") -> DataFrame:
    """Adds ``action``: missing, idempotent, not_eligible, deferred or generate.

    ``queue(key, pos, exists, fingerprint, previous_fingerprint, previous_status, eligible)``. Only rows that need work count
    against the cap, in the order of ``pos``.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")
    done = F.col("previous_status").isin(*TERMINAL)
    if retry_failed:
        done = done & (F.col("previous_status") != FAILED)
    same = F.coalesce((F.col("fingerprint") == F.col("previous_fingerprint")) & done, F.lit(False))
    first = F.when(~F.col("exists"), "missing").when(same, "idempotent").when(~F.col("eligible"), "not_eligible").otherwise("generate")
    # The cap is on the whole queue: work rows alone are ranked, with a limit before the sort's single task.
    work = queue.withColumn("action", first)
    taken = work.filter("action = 'generate'").orderBy("pos").limit(cap).select(F.col(key), F.lit(True).alias("_taken"))
    out = work.join(taken, key, "left")
    return out.withColumn("action", F.when((F.col("action") == "generate") & F.col("_taken").isNull(), "deferred").otherwise(F.col("action"))).drop("_taken")


def budget_prefix(rows: DataFrame, by: list[str], order: list[Column], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Rows of each group taken in order while both limits hold; the first that does not fit ends the prefix.

    Sizes are not negative, so running totals only rise and a filter on them is the prefix."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("pos", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.filter((F.col("pos") <= most_rows) & (F.col("used") <= most_size))


def cut_required(all_rows: DataFrame, kept: DataFrame, key: str, required: str = "required") -> DataFrame:
    """Required rows that a budget has cut: must be empty."""
    return all_rows.filter(F.col(required)).join(kept, key, "left_anti").select(key)


def best_iteration(candidates: DataFrame, by: str) -> DataFrame:
    """The candidate of each group that wins: gate passed, validators passed, higher scores; the earliest on ties."""
    order = F.struct((~F.col("gate_passed")).alias("g"), (~F.col("validators_pass")).alias("v"), (-F.col("overall_score")).alias("o"), (-F.col("evidence_score")).alias("e"), F.col("iteration").alias("i"))
    return candidates.groupBy(by).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != by]), order).alias("x")).select(by, "x.*")


def escalation_tier(iteration: Column) -> Column:
    """1, 2 or 3 for iterations 1-2, 3-4 and 5."""
    return F.when(iteration <= 2, 1).when(iteration <= 4, 2).otherwise(3)


def stale(entries: DataFrame, records: DataFrame, version: int, key: str = "vacancy_id") -> DataFrame:
    """Keys of entries that another logic version wrote and whose record still exists."""
    old = entries.filter(~F.col("logic_version").eqNullSafe(F.lit(version)))
    return old.select(key).join(records.select(key), key, "left_semi")


def candidates(entries: DataFrame, records: DataFrame, fresh: DataFrame, version: int, key: str = "vacancy_id") -> DataFrame:
    """The queue in order: deferred entries, stale ones, then freshly indexed ones, each key once."""
    return ordered_union(entries.filter(F.col("status") == DEFERRED).select(key), stale(entries, records, version, key), fresh.select(key), key=key)
