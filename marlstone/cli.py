"""Command line: ``python -m marlstone ingest|evidence|retrieve|match|validate``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import hybrid, lexical, matching, sections
from .sources import feeds, markdown
from .sources.state import StateStore
from .streaming import evidence as evidence_runs
from .streaming import ingest

CHUNKS = "chunk_id string, vacancy_id string, chunk_type string, text string, content_hash string, source_paths array<string>"


def retrieve(store: StateStore, query: str, k: int = 5, include_source_fit: bool = False) -> DataFrame:
    """Lexical hits of one query on the chunks of a state."""
    chunks = lexical.eligible(store.read("chunks", CHUNKS), include_source_fit)
    queries = store.spark.createDataFrame([(0, query)], "query_id int, text string")
    hits = lexical.top_k(lexical.tfidf_scores(chunks, queries), k)
    return hits.join(chunks.select("chunk_id", "vacancy_id", "chunk_type", "source_paths"), "chunk_id").orderBy("rank")


def match(records: DataFrame, evidence: DataFrame, mode: str = "lexical", k: int = 6, **sides: object) -> DataFrame:
    """Coverage of every requirement of every record by evidence chunks, in one plan; ``sides`` go to ``hybrid.retrieve``."""
    reqs = matching.requirements(records).withColumn("q", F.concat_ws("#", "vacancy_id", F.col("req_pos").cast("string")))
    found = hybrid.retrieve(reqs.select(F.col("q").alias("query_id"), F.col("requirement").alias("text")), evidence, mode, k, **sides)
    about = evidence.select("chunk_id", "record_id", "chunk_type", "proficiency", "source_path")
    return matching.coverage(reqs.drop("q"), found.join(about, "chunk_id").join(reqs.select(F.col("q").alias("query_id"), "vacancy_id", "req_pos"), "query_id"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="run over the feed files below ROOT")
    a.add_argument("root")
    a.add_argument("state")
    a.add_argument("--run-id")
    a.add_argument("--full-rebuild", action="store_true")
    a.add_argument("--fail-on-quarantine", action="store_true")
    a = sub.add_parser("retrieve", help="search the chunks of a state")
    a.add_argument("state")
    a.add_argument("query")
    a.add_argument("--top-k", type=int, default=5)
    a.add_argument("--include-source-fit", action="store_true")
    a = sub.add_parser("evidence", help="run over the Markdown files below ROOT")
    a.add_argument("root")
    a.add_argument("state")
    a.add_argument("--run-id")
    a.add_argument("--full-rebuild", action="store_true")
    a = sub.add_parser("match", help="cover the requirements of a state's records by its evidence")
    a.add_argument("state")
    a.add_argument("--vacancy-id")
    a.add_argument("--top-k", type=int, default=6)
    a = sub.add_parser("validate", help="check the Markdown files below ROOT")
    a.add_argument("root")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "ingest":
        run_id = args.run_id or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        report = ingest.run_batch(spark, StateStore(spark, args.state), feeds.read_files(spark, args.root), run_id, full_rebuild=args.full_rebuild)
        print(report.run_id, report.status, *(f"{k}={v}" for k, v in report.counts.items()))
        return 2 if args.fail_on_quarantine and report.counts["quarantined"] else 0
    if args.command == "evidence":
        run_id = args.run_id or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        report = evidence_runs.run_batch(spark, StateStore(spark, args.state), markdown.read_files(spark, args.root), run_id, full_rebuild=args.full_rebuild)
        print(report.run_id, report.status, *(f"{k}={v}" for k, v in report.counts.items()))
        return 0
    if args.command == "match":
        store = StateStore(spark, args.state)
        records = store.current("merged")
        records = records if args.vacancy_id is None else records.filter(F.col("vacancy_id") == args.vacancy_id)
        for r in matching.summary(match(records, store.current("evidence_chunks"), k=args.top_k)).orderBy("vacancy_id").toLocalIterator():
            print(r["vacancy_id"], r["coverage_score"], *(f"{c}={r[c]}" for c in ("n_requirements", *matching.WEIGHTS, "unsupported")))
        return 0
    if args.command == "retrieve":
        for r in retrieve(StateStore(spark, args.state), args.query, args.top_k, args.include_source_fit).toLocalIterator():
            print(r["rank"], r["score"], r["chunk_id"])
        return 0
    records = markdown.normalize(markdown.read_files(spark, args.root))
    issues = markdown.governance_issues(records, sections.relations(records))
    errors = 0
    for r in issues.orderBy("severity", "source_path", "code").toLocalIterator():
        errors += r["severity"] == "error"
        print(r["severity"], r["source_path"], r["code"], r["detail"])
    return int(errors > 0)
