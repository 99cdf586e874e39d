"""Governed Markdown: front matter and body, to normalised records.

The split is an expression; only the front matter, a few lines a file, is parsed in Python (Arrow batches), there being no YAML function.
PyYAML is used where it is installed; else a small reader of the subset that front matter needs (scalars, lists, nested lists of
scalars) takes its place. A bad file raises, as the corpus is governed: nothing is quarantined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sections import linked_paths, metric_refs

# Statuses that are not reused; keys that are no attributes.
NOT_REUSED = ("draft", "deprecated", "needs_reconciliation")
# Vocabularies of the governance check.
REQUIRED = ("schema_version", "record_id", "record_type", "status", "last_updated", "confidence", "visibility", "public_safe", "source_refs")
VOCABULARY = {
    "record_type": ("profile", "education", "certifications", "skills", "role", "project", "achievement_registry", "governance", "conflict_log"),
    "status": ("draft", "needs_reconciliation", "canonical", "validated_public", "validated_public_supporting", "deprecated"),
    "confidence": ("high", "medium", "low"),
}
SKILL_LEVELS = ("core", "working", "familiarity")
RESERVED = ("schema_version", "record_id", "record_type", "status", "confidence", "visibility", "public_safe", "source_refs")


def read_files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """``(source_path, text)`` of the Markdown files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    return files.select(F.regexp_replace("path", "^.*" + re.escape(base), "").alias("source_path"), F.col("content").cast("string").alias("text"))


def scalar(text: str) -> Any:
    """Value of a plain YAML scalar."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    if t.lower() in ("", "~", "null"):
        return None
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if re.fullmatch(r"[-+]?\d+\.\d*", t):
        return float(t)
    if t[0] == "[" and t[-1] == "]":
        return [scalar(x) for x in t[1:-1].split(",") if x.strip()]
    return t


def parse_front_matter(text: str) -> dict[str, Any]:
    """Mapping at the head of a file, dates as ISO text."""
    try:
        import yaml
    except ImportError:
        data: Any = _subset(text)
    else:
        # The same safe values, read by libyaml where PyYAML was built with it.
        data = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
    if not isinstance(data, dict):
        raise ValueError("front matter must be a mapping")
    return plain(data)


def plain(value: Any) -> Any:
    """Dates as text and keys as text, through lists and mappings."""
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def _subset(text: str) -> Any:
    out: dict[str, Any] = {}
    key = None
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(scalar(bare.lstrip()[2:]))
        elif ":" in bare and not bare.startswith(" "):
            key, _, rest = bare.partition(":")
            out[key := key.strip()] = scalar(rest) if rest.strip() else None
        else:
            return None
    return out


def split(files: DataFrame) -> DataFrame:
    """Adds ``front``, ``body`` and ``body_start_line`` (from 1); a file without a closed front matter raises."""
    text = F.col("text")
    end = F.locate("\n---\n", text, 5)
    ok = text.startswith("---\n") & (end > 0)
    message = F.concat("source_path", F.when(~text.startswith("---\n"), ": missing YAML front matter").otherwise(": unterminated YAML front matter"))
    checked = F.when(ok, text).otherwise(F.raise_error(message))
    head = F.substr(checked, F.lit(1), end + 4)
    return files.select(
        "*", F.substr(checked, F.lit(5), end - 5).alias("front"), F.substr(checked, end + 5).alias("body"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("body_start_line")
    )


def retrieval_class(path: Column, policy_prefix: str, routers: tuple[str, ...]) -> Column:
    return F.when(path.startswith(policy_prefix), "policy").when(path.isin(*routers), "router").otherwise("evidence")


def normalize(files: DataFrame, policy_prefix: str = "_meta/", routers: tuple[str, ...] = (), commit: str | None = None) -> DataFrame:
    """Normalised records, with body and its first line for the sections."""

    def meta(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: json.dumps(parse_front_matter(t), ensure_ascii=False))

    parse = F.pandas_udf(meta, "string")
    m = split(files).withColumn("meta", F.parse_json(parse("front")))
    get = lambda k: F.trim(F.coalesce(F.try_variant_get("meta", f"$.{k}", "string"), F.lit("")))
    named = F.when(get("record_id") != "", get("record_id")).otherwise(F.raise_error(F.concat("source_path", F.lit(": missing record_id"))))
    # Only a true boolean is safe: the text "true" is not.
    safe = F.coalesce((F.schema_of_variant(F.try_variant_get("meta", "$.public_safe", "variant")) == "BOOLEAN") & F.try_variant_get("meta", "$.public_safe", "boolean"), F.lit(False))
    r = m.select(
        named.alias("record_id"), get("record_type").alias("record_type"), get("status").alias("status"), get("confidence").alias("confidence"), get("visibility").alias("visibility"), safe.alias("public_safe"),
        retrieval_class(F.col("source_path"), policy_prefix, routers).alias("retrieval_class"), "source_path", F.lit(commit).cast("string").alias("source_commit"),
        F.coalesce(F.try_variant_get("meta", "$.source_refs", "array<string>"), F.array().cast("array<string>")).alias("source_refs"), metric_refs(F.col("body")).alias("metric_refs"),
        linked_paths(F.col("body")).alias("linked_markdown_paths"), F.to_json(F.map_filter(F.variant_get("meta", "$", "map<string,variant>"), lambda k, v: ~k.isin(*RESERVED))).alias("attributes"),
        F.sha2("text", 256).alias("content_hash"), "body", "body_start_line",
    )
    eligible = F.col("public_safe") & ~F.col("status").isin(*NOT_REUSED)
    return r.withColumn("eligible", eligible).withColumn("embedding_candidate", eligible & (F.col("retrieval_class") == "evidence"))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Record ids that more than one file has; must be empty."""
    return records.groupBy("record_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source_path")).alias("source_paths")).filter("n > 1")


def manifest(records: DataFrame) -> DataFrame:
    """Counts of records by retrieval class, by type and in all, in one pass: (retrieval_class, record_type, n, n_candidates); null where it is summed over."""
    sets = records.groupingSets([["retrieval_class"], ["record_type"], []], "retrieval_class", "record_type")
    return sets.agg(F.count("*").alias("n"), F.count_if("embedding_candidate").alias("n_candidates"))


def governance_issues(records: DataFrame, relations_to: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """``(source_path, severity, code, detail)`` of normalised records: fields, vocabularies, dates and ids, repeated record and metric ids, metrics that
    no record defines, skill levels, references that ``registry(source_ref)`` lacks, and links to files that do not exist."""
    meta = lambda k: F.get_json_object("attributes", f"$.{k}")
    error = lambda test, code, detail="": F.when(test, F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else F.coalesce(detail, F.lit(""))).alias("detail")))
    warn = lambda test, code: F.when(test, F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit("").alias("detail")))
    checks = [error(F.col(c) == "", "missing_field", c) for c in ("record_type", "status", "confidence", "visibility")]
    checks += [error((F.col(c) != "") & ~F.col(c).isin(*words), f"invalid_{c}", F.col(c)) for c, words in VOCABULARY.items()]
    checks += [
        error((F.col("visibility") != "public") | ~F.col("public_safe"), "not_public"), error(~F.coalesce(meta("last_updated").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "invalid_last_updated", meta("last_updated")),
        error(~F.col("record_id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "invalid_record_id", F.col("record_id")),
        warn((F.size("source_refs") == 0) & (F.col("record_type") != "governance"), "no_source_refs"), warn(F.contains("body", F.lit("To be populated")) | (F.col("status") == "draft"), "incomplete"),
    ]
    level = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^- \*\*Level:\*\*"))
    named = F.transform(level, lambda x: F.lower(F.regexp_extract(x, r"^- \*\*Level:\*\*\s*(.*?)\s*$", 1)))
    wrong = F.filter(named, lambda x: ~x.isin(*SKILL_LEVELS))
    skills = F.col("record_type") == "skills"
    checks += [error(skills & (F.size(level) == 0), "no_skill_level"), error(skills & (F.size(wrong) > 0), "invalid_skill_level", F.array_join(wrong, ","))]
    out = records.select("source_path", F.inline(F.array_compact(F.array(*checks))))
    row = lambda df, severity, code, detail: df.select("source_path", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(detail).cast("string").alias("detail"))
    out = out.unionByName(row(duplicate_ids(records).withColumn("source_path", F.explode("source_paths")), "error", "duplicate_record_id", "record_id"))
    defined = records.select("source_path", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^##\s+(ACH-[A-Z0-9-]+)\b"), F.lit(1))).alias("metric"))
    twice = defined.groupBy("metric").agg(F.count("*").alias("n")).filter("n > 1").select("metric")
    out = out.unionByName(row(defined.join(twice, "metric", "left_semi").distinct(), "error", "duplicate_metric", "metric"))
    used = records.select("source_path", F.explode("metric_refs").alias("metric"))
    out = out.unionByName(row(used.join(defined.select("metric").distinct(), "metric", "left_anti"), "error", "unknown_metric", "metric"))
    if registry is not None:
        refs = records.select("source_path", F.explode("source_refs").alias("source_ref")).join(registry.select("source_ref"), "source_ref", "left_anti")
        out = out.unionByName(row(refs, "error", "unknown_source_ref", "source_ref"))
    if relations_to is not None:
        links = records.select("source_path", "record_id", F.size("linked_markdown_paths").alias("n"))
        found = relations_to.filter("relation = 'links_to'").groupBy(F.col("source").alias("record_id")).agg(F.count("*").alias("m"))
        lost = links.join(found, "record_id", "left").withColumn("lost", F.col("n") - F.coalesce("m", F.lit(0))).filter("lost > 0")
        out = out.unionByName(row(lost, "error", "broken_link", "lost"))
    return out
