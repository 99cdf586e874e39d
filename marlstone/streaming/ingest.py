"""Ingest runs over one snapshot of state, and the streams that feed them.

A run compares files with the manifest, checks and adapts new and changed ones, merges only what they touch, and exchanges the
buckets of these in every table. All tables, the report among them, come into force with one snapshot: outcomes are always told from the
last whole run, so a run that dies is done again from there. A second run over the same files changes nothing but the log of runs.

Document frequencies are kept by differences: the postings that a run takes out count -1, those it puts in +1, and the signed counts
are added to a log that is summed up from time to time. Texts of rejected files are kept once a content hash, with the number of files
that hold them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, diff, lexical, merge
from ..sources import feeds
from ..sources.state import StateStore

VERSION = 6
SOURCES = "source_path string, source_hash string, source_format string, status string, entity_ids array<string>, errors array<string>, pipeline_version int"
RUNS = "run_id string, status string, counts map<string,bigint>"
OUTCOMES = "vacancy_id string, outcome string, run_id string"
POSTINGS = "term string, chunk_id string, tf bigint, vacancy_id string"
RAW = "source_hash string, content binary, refs bigint"
TABLES = ("sources", "records", "merged", "chunks", "postings", "frequencies", "quarantine", "raw")


@dataclass
class Report:
    run_id: str
    status: str
    counts: dict[str, int]


def signed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(term, df, total_tf)``: by how much the postings ``after`` raise or lower the counts that ``before`` took part in; terms that stay are left out."""
    rows = before.select("term", F.lit(-1).alias("s"), "tf").unionByName(after.select("term", F.lit(1).alias("s"), "tf"))
    out = rows.groupBy("term").agg(F.sum("s").alias("df"), F.sum(F.col("s") * F.col("tf")).alias("total_tf"))
    return out.filter("df <> 0 OR total_tf <> 0")


def frequencies(counts: DataFrame) -> DataFrame:
    """The log of signed counts, summed up; terms without a document are gone."""
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf")).filter("df <> 0")


def _references(raw: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Raw copies of the hashes that rejected files gain or lose, with their numbers of files."""
    none = F.lit(None).cast("binary")
    moves = (
        before.select("source_hash", none.alias("content"), F.lit(-1).cast("long").alias("refs")).unionByName(after.select("source_hash", "content", F.lit(1).cast("long").alias("refs")))
    )
    hashes = moves.select("source_hash").distinct()
    both = raw.join(hashes, "source_hash", "left_semi").unionByName(moves)
    return both.groupBy("source_hash").agg(F.max("content").alias("content"), F.sum("refs").alias("refs"))


def drop_unreferenced(store: StateStore) -> None:
    """Drops raw copies that no rejected file holds any more."""
    run = store.begin()
    unused = run.read("raw", RAW).filter("refs <= 0").select("source_hash")
    run.replace("raw", "source_hash", unused, store.spark.createDataFrame([], RAW))
    run.commit()


def run_batch(
    spark: SparkSession, store: StateStore, files: DataFrame, run_id: str, commit: str | None = None, full_rebuild: bool = False, partial: bool = False, batch: tuple[str, int] | None = None
) -> Report:
    """One run over ``files(source_path, source_hash, text)``, with ``content`` if their bytes are to be kept where they are rejected.

    A state of another pipeline version is rebuilt from nothing. With ``partial`` the files are those that came, and others stay as they are; without,
    files that are not given are deleted ones. ``batch`` names a stream and its batch: one that is in the state already is not run again.
    """
    run = store.begin()
    if batch and run.base.batches.get(batch[0], -1) >= batch[1]:
        return Report(run_id, "replayed", {})
    manifest = run.read("sources", SOURCES)
    old_version = manifest.agg(F.max("pipeline_version")).first()[0]
    if full_rebuild or (old_version is not None and old_version != VERSION):
        run.wipe(*TABLES)
        manifest = run.read("sources", SOURCES)
    if partial:
        manifest = run.read("sources", SOURCES, files.select("source_path")).join(files.select("source_path"), "source_path", "left_semi")
    changes = run.passing("changes", diff.snapshot_diff(manifest, files))
    counts = {k: 0 for k in ("new", "modified", "unchanged", "deleted")} | {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    counts |= {"discovered": sum(counts[k] for k in ("new", "modified", "unchanged"))}
    counts |= _changed(spark, run, files, changes, manifest, run_id, commit) if counts["discovered"] + counts["deleted"] > counts["unchanged"] else dict.fromkeys(("quarantined", "impacted", "reindexed", "semantic_unchanged", "deleted_entities"), 0)
    counts["active"] = run.read("merged", "vacancy_id string").count()
    status = "completed_with_quarantine" if counts["quarantined"] else "success"
    run.append("runs", spark.createDataFrame([(run_id, status, counts)], RUNS).coalesce(1))
    run.commit(batch)
    return Report(run_id, status, counts)


def _changed(spark: SparkSession, run, files: DataFrame, changes: DataFrame, manifest: DataFrame, run_id: str, commit: str | None) -> dict[str, int]:
    """Carries changed files through all tables; the run's counters."""
    given = files if "content" in files.columns else files.withColumn("content", F.col("text").cast("binary"))
    fresh = run.passing("fresh", given.join(changes.filter("change in ('new', 'modified')").select("source_path"), "source_path", "left_semi"))
    stale = run.passing("stale", changes.filter("change <> 'unchanged'").select("source_path"))
    # Checked once; what follows starts from the verdicts.
    checked = run.passing("checked", feeds.check(feeds.envelope(fresh.select("source_path", "source_hash", "text"))).drop("doc"))
    adapted = run.passing("adapted", feeds.adapt(feeds.envelope(checked.filter(F.size("errors") == 0)), commit))
    rejected = run.passing("rejected", feeds.quarantine(checked))
    path = F.get("provenance", 0)["source_path"]
    before = manifest.join(stale, "source_path", "left_semi").select(F.explode("entity_ids").alias("vacancy_id"))
    ids = run.passing("impacted", before.union(adapted.select("vacancy_id")).distinct())
    outdated = stale.withColumnRenamed("source_path", "_p")
    run.replace("records", "vacancy_id", ids, adapted, lambda old: old.withColumn("_p", path).join(outdated, "_p", "left_anti").drop("_p"))
    records = run.read("records", adapted.schema, ids)
    merged = run.passing("merging", merge.merge_records(diff.affected_records(records, ids, "vacancy_id")))

    paths = F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p["source_path"])))
    existing = run.read("merged", merged.schema, ids).join(ids, "vacancy_id", "left_semi")
    result = run.passing("outcomes", diff.outcome(ids, existing.withColumn("source_paths", paths), merged.withColumn("source_paths", paths), "vacancy_id"))
    run.replace("merged", "vacancy_id", ids, merged)
    new_chunks = run.passing("chunks", chunks.posting_chunks(merged))
    run.replace("chunks", "vacancy_id", ids, new_chunks)
    redo = run.passing("redo", result.filter("outcome <> 'semantic_unchanged'").select("vacancy_id"))
    index = lexical.postings(new_chunks.join(redo, "vacancy_id", "left_semi")).join(new_chunks.select("chunk_id", "vacancy_id"), "chunk_id")
    index = run.passing("postings", index.select("term", "chunk_id", "tf", "vacancy_id"))
    taken = run.read("postings", POSTINGS, redo).join(redo, "vacancy_id", "left_semi")
    run.append("frequencies", signed_counts(taken, index))
    run.fold("frequencies", frequencies)
    run.replace("postings", "vacancy_id", redo, index)

    held = run.read("quarantine", rejected.schema, stale).join(stale, "source_path", "left_semi")
    bad = fresh.join(rejected.select("source_path"), "source_path", "left_semi")
    hashes = held.select("source_hash").union(bad.select("source_hash")).distinct()
    copies = run.passing("copies", _references(run.read("raw", RAW, hashes), held, bad))
    run.replace("raw", "source_hash", copies.select("source_hash"), copies)
    run.replace("quarantine", "source_path", stale, rejected)
    own = adapted.groupBy(path.alias("source_path")).agg(F.array_sort(F.collect_set("vacancy_id")).alias("entity_ids"))
    empty = F.array().cast("array<string>")
    entries = (
        fresh.select("source_path", "source_hash").join(own, "source_path", "left").join(rejected.select("source_path", "errors"), "source_path", "left")
        .join(checked.select("source_path", "source_format"), "source_path")
        .select("source_path", "source_hash", "source_format", F.when(F.col("errors").isNull(), "valid").otherwise("quarantined").alias("status"), F.coalesce("entity_ids", empty).alias("entity_ids"), F.coalesce("errors", empty).alias("errors"), F.lit(VERSION).alias("pipeline_version"))
    )
    run.replace("sources", "source_path", stale, entries)
    run.append("outcomes_log", result.withColumn("run_id", F.lit(run_id)))
    by_outcome = {r["outcome"]: r["count"] for r in result.groupBy("outcome").count().collect()}
    return {
        "quarantined": rejected.count(), "impacted": sum(by_outcome.values()), "reindexed": by_outcome.get("reindexed", 0), "semantic_unchanged": by_outcome.get("semantic_unchanged", 0), "deleted_entities": by_outcome.get("deleted", 0),
    }


def reindexed(store: StateStore, run_id: str) -> DataFrame:
    """Ids that a run has indexed anew: the candidates of the work queue."""
    return store.log("outcomes_log", OUTCOMES).filter((F.col("run_id") == run_id) & (F.col("outcome") == "reindexed")).select("vacancy_id")


def file_stream(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """The files below ``root`` as a stream, a file again whenever it has changed."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def watch(spark: SparkSession, root: str, checkpoint: str, run: Callable[[int], None], glob: str = "*.json"):
    """Starts a stream that calls ``run(epoch)`` whenever files have come below ``root``, and ends when it has caught up."""
    stream = file_stream(spark, root, glob).select("path").writeStream
    return stream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: run(epoch)).start()


def follow(spark: SparkSession, store: StateStore, files: DataFrame, checkpoint: str, name: str = "feed", commit: str | None = None):
    """Starts a stream of ``run_batch`` files, such as ``feeds.named(file_stream(...), root)``, each batch of which is a run over the files that came or changed; ends when it has caught up.

    The batch's number goes into the snapshot that holds its rows, so a batch that is played again, its run having died before or after that, counts
    once. A stream tells nothing of deleted files: a run over all files now and then does."""

    def run(batch: DataFrame, epoch: int) -> None:
        run_batch(spark, store, batch, f"{name}-{epoch}", commit, partial=True, batch=(name, epoch))

    return files.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(run).start()
