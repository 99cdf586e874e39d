"""Runs over governed Markdown: what changed is normalised, chunked, indexed and related anew; a second run over the same files changes nothing.

Links are kept in a table by the path they lead to, whether a file is there or not. Only records that changed, and those with a link to
a path that came, went or changed its record, have their relations drawn anew; the table is probed by these paths only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, diff, lexical, sections
from ..sources import markdown
from ..sources.state import StateStore, Transaction
from .ingest import RUNS, Report, frequencies, signed_counts

VERSION = 2
SOURCES = "source_path string, source_hash string, record_id string, pipeline_version int"
TABLES = ("evidence_sources", "evidence_records", "evidence_chunks", "evidence_postings", "evidence_frequencies", "evidence_links", "evidence_relations")
POSTINGS = "term string, chunk_id string, tf bigint, record_id string"
LINKS = "source string, path string"
RELATIONS = "source string, relation string, target string"
LOG = "evidence_runs"


def run_batch(spark: SparkSession, store: StateStore, files: DataFrame, run_id: str, policy_prefix: str = "_meta/", routers: tuple[str, ...] = (), commit: str | None = None, full_rebuild: bool = False) -> Report:
    """One run over ``files(source_path, text)``. A bad file or a record id that two files have raises, and the state stays as it was."""
    run = store.begin()
    manifest = run.read("evidence_sources", SOURCES)
    old = manifest.agg(F.max("pipeline_version")).first()[0]
    if full_rebuild or (old is not None and old != VERSION):
        run.wipe(*TABLES)
        manifest = run.read("evidence_sources", SOURCES)
    now = files.select("source_path", "text", F.sha2("text", 256).alias("source_hash"))
    changes = run.passing("changes", diff.snapshot_diff(manifest, now))
    counts = {k: 0 for k in ("new", "modified", "unchanged", "deleted")} | {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    counts |= {"discovered": sum(counts[k] for k in ("new", "modified", "unchanged")), "impacted": 0, "reindexed": 0}
    if counts["discovered"] + counts["deleted"] > counts["unchanged"]:
        counts |= _changed(run, now, changes, manifest, policy_prefix, routers, commit)
    counts |= {k: run.read(f"evidence_{k}", "x int").count() for k in ("records", "chunks", "relations")}
    run.append(LOG, spark.createDataFrame([(run_id, "success", counts)], RUNS).coalesce(1))
    run.commit()
    return Report(run_id, "success", counts)


def _changed(run: Transaction, now: DataFrame, changes: DataFrame, manifest: DataFrame, policy_prefix: str, routers: tuple[str, ...], commit: str | None) -> dict[str, int]:
    fresh = now.join(changes.filter("change in ('new', 'modified')").select("source_path"), "source_path", "left_semi")
    records = markdown.normalize(fresh.select("source_path", "text"), policy_prefix, routers, commit)
    made = run.passing("made", records.withColumn("source_hash", F.col("content_hash")))
    stale = run.passing("stale", changes.filter("change <> 'unchanged'").select("source_path"))
    gone = manifest.join(stale, "source_path", "left_semi").select("source_path", "record_id")
    touched = run.passing("touched", gone.select("record_id").union(made.select("record_id")).distinct())
    before = run.passing("before", run.read("evidence_records", made.schema, touched).join(touched, "record_id", "left_semi"))
    run.replace("evidence_records", "record_id", touched, made, lambda old: old.join(stale, "source_path", "left_anti"))
    after = run.read("evidence_records", made.schema, touched).join(touched, "record_id", "left_semi")
    if twice := markdown.duplicate_ids(after).first():
        raise ValueError(f"record id {twice['record_id']!r} of several files: {twice['source_paths']}")
    new_chunks = run.passing("chunks", chunks.active(chunks.record_chunks(made, sections.sections(made))))
    run.replace("evidence_chunks", "record_id", touched, new_chunks)
    index = run.passing("postings", lexical.postings(new_chunks).join(new_chunks.select("chunk_id", "record_id"), "chunk_id").select("term", "chunk_id", "tf", "record_id"))
    taken = run.read("evidence_postings", POSTINGS, touched).join(touched, "record_id", "left_semi")
    run.append("evidence_frequencies", signed_counts(taken, index))
    run.fold("evidence_frequencies", frequencies)
    run.replace("evidence_postings", "record_id", touched, index)
    entries = made.select("source_path", "source_hash", "record_id", F.lit(VERSION).alias("pipeline_version"))
    run.replace("evidence_sources", "source_path", stale, entries)
    _relate(run, made, before, touched, stale)
    return {"impacted": touched.count(), "reindexed": made.count()}


def _relate(run: Transaction, made: DataFrame, before: DataFrame, touched: DataFrame, stale: DataFrame) -> None:
    """Links of the touched records are exchanged; relations are drawn for these, and for records with a link to a path whose file came, went or changed."""
    links = run.passing("links", sections.link_paths(made))
    paths = sections.link_paths(before).select("path").union(links.select("path")).distinct()
    sources = touched.withColumnRenamed("record_id", "source")
    run.replace("evidence_links", "path", paths, links, lambda old: old.join(sources, "source", "left_anti"))
    moved = stale.withColumnRenamed("source_path", "path")
    pointing = run.read("evidence_links", LINKS, moved).join(moved, "path", "left_semi").select("source")
    again = run.passing("again", sources.union(pointing).distinct().withColumnRenamed("source", "record_id"))
    records = run.passing("again_records", run.read("evidence_records", made.schema, again).join(again, "record_id", "left_semi"))
    wanted = run.passing("again_links", sections.link_paths(records))
    known = run.read("evidence_sources", SOURCES, wanted.select(F.col("path").alias("source_path"))).select(F.col("source_path").alias("path"), F.col("record_id").alias("target"))
    drawn = sections.relations(records, known, wanted)
    run.replace("evidence_relations", "source", again.withColumnRenamed("record_id", "source"), drawn)
