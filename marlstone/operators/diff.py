"""Snapshot differences and what they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame, path: str = "source_path", digest: str = "source_hash") -> DataFrame:
    """``(path, change)`` for every path of either side: new, modified, unchanged or deleted. Paths are unique on each side."""
    old = previous.select(F.col(path), F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    new = current.select(F.col(path), F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return old.join(new, path, "full_outer").select(path, change.alias("change"))


def impacted(changes: DataFrame, previous_ids: DataFrame, current_ids: DataFrame, path: str = "source_path", entity: str = "entity_id") -> DataFrame:
    """Entities whose record may differ: those that modified or deleted files had, and those that new or modified ones have."""
    gone = changes.filter(F.col("change").isin("modified", "deleted")).select(path)
    come = changes.filter(F.col("change").isin("new", "modified")).select(path)
    before = previous_ids.join(gone, path, "left_semi").select(entity)
    return before.union(current_ids.join(come, path, "left_semi").select(entity)).distinct()


def affected_records(records: DataFrame, ids: DataFrame, entity: str = "entity_id") -> DataFrame:
    """The records of impacted entities, from all sources."""
    return records.join(ids, entity, "left_semi")


def outcome(ids: DataFrame, existing: DataFrame, merged: DataFrame, entity: str = "entity_id") -> DataFrame:
    """``(entity, outcome)`` of impacted ids: deleted without a record, semantic_unchanged where hash and source paths
    are as before, else reindexed. ``existing`` and ``merged`` have ``content_hash`` and ``source_paths`` (sorted)."""
    old = existing.select(F.col(entity), F.col("content_hash").alias("_h"), F.col("source_paths").alias("_p"))
    new = merged.select(F.col(entity), "content_hash", "source_paths")
    same = F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("source_paths").eqNullSafe(F.col("_p"))
    result = F.when(F.col("content_hash").isNull(), "deleted").when(same, "semantic_unchanged").otherwise("reindexed")
    return ids.join(new, entity, "left").join(old, entity, "left").select(entity, result.alias("outcome"))
