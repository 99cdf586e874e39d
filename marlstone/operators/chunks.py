"""Texts for retrieval: chunks of postings and of normalised Markdown records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import semantic_hash
from ..functions.text import fields, plain_number, slug, strip, truthy


def labelled(label: str, value: Column) -> Column:
    """``label: value``, null where the value is blank."""
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(label + ": "), value.cast("string")))


def listed(label: str, items: Column) -> Column:
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.concat(F.lit(label + ": "), F.array_join(items, "; ")))


def text_of(*lines: Column) -> Column:
    """Trimmed lines that are not blank, one below the other."""
    cleaned = F.filter(F.transform(F.array(*lines), lambda x: strip(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(cleaned, "\n")


def posting_chunks(records: DataFrame) -> DataFrame:
    """Up to three chunks a record: core, requirements, source-fit; empty ones are dropped."""
    c = F.col
    points = lambda x: F.concat(plain_number(x), F.lit("/100"))
    core = text_of(
        F.concat(F.lit("Role: "), c("role_title")), F.concat(F.lit("Company: "), c("company")), labelled("Seniority", c("seniority")),
        labelled("Company category", c("company_category")), labelled("Location", c("location_raw")), labelled("Work model", c("work_model")),
        F.concat(F.lit("Application language: "), c("application_language")), F.concat(F.lit("JD fidelity: "), c("jd_fidelity"), F.lit(" ("), points(c("jd_fidelity_score")), F.lit(")")),
        F.concat(F.lit("JD generation eligible: "), c("jd_generation_eligible").cast("string")), labelled("Description", c("description")),
    )
    wants = text_of(listed("Technologies / capabilities", c("tech_stack")), listed("Requirements", c("requirements")), listed("Responsibilities", c("responsibilities")))
    fit = text_of(
        F.when(c("fit_score").isNotNull(), F.concat(F.lit("Source fit score: "), points(c("fit_score")))), labelled("Source fit summary", c("fit_summary")),
        listed("Source strengths", c("fit_strengths")), listed("Source gaps", c("fit_gaps")),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("chunk_type"), t.alias("text")) for k, t in (("core", core), ("requirements", wants), ("source-fit", fit))])
    paths = F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p["source_path"])))
    out = records.withColumn("source_paths", paths).select("vacancy_id", "source_paths", F.inline(kinds))
    return out.filter("text <> ''").select(F.concat_ws("::", "vacancy_id", "chunk_type").alias("chunk_id"), "vacancy_id", "chunk_type", "text", F.sha2("text", 256).alias("content_hash"), "source_paths")


# Statuses of metrics that may be used, and usages that block a credential.
APPROVED_METRIC = ("validated_public", "validated_public_technical")
BLOCKED_USE = ("blocked", "do_not_use", "do not use")
METRIC_RECORD, SKILL_RECORD = "achievement-metrics", "skills"


def record_chunks(records: DataFrame, sections: DataFrame, approved: tuple[str, ...] = APPROVED_METRIC) -> DataFrame:
    """Typed chunks of normalised records.

    ``records(record_id, record_type, retrieval_class, eligible, source_path, source_refs, metric_refs)``,
    ``sections(record_id, pos, section_id, title, heading_path, semantic_type, content)``. Routers give none; the metric and
    skill records give one for each entry; elsewhere every section with content gives one, which carries the
    record's boundary texts as constraints.
    """
    bounds = F.transform(F.array_sort(F.collect_list(F.when((F.col("semantic_type") == "boundary") & (strip(F.col("content")) != ""), F.struct("pos", strip(F.col("content")).alias("t")))).over(Window.partitionBy("record_id"))), lambda x: x["t"])
    # Sections come dealt by record, so this window exchanges nothing, and they are made once.
    s = sections.withColumn("bounds", bounds).join(records.drop("body"), "record_id").filter("retrieval_class <> 'router'").withColumn("f", fields(F.col("content")))
    get = lambda k: F.try_element_at("f", F.lit(k))
    low = lambda k: F.lower(F.coalesce(get(k), F.lit("")))
    metric, skill = F.col("record_id") == METRIC_RECORD, F.col("record_id") == SKILL_RECORD
    credential = (F.col("semantic_type") == "credential") | F.upper("title").startswith("CERT-")
    filled = lambda k: F.coalesce(get(k), F.lit("")) != ""
    s = s.filter((metric & (F.col("semantic_type") == "metric")) | (skill & (filled("level") | filled("proficiency"))) | (~metric & ~skill & (strip(F.col("content")) != "")))
    metric_id = F.regexp_extract(F.trim(F.substring_index("title", "—", 1)), r"^(\S+)", 1)
    generic = (
        F.when(F.col("retrieval_class") == "policy", F.concat(F.lit("policy_"), "semantic_type"))
        .when((F.col("semantic_type") == "section") & F.col("record_type").isin("project", "role"), F.concat("record_type", F.lit("_detail"))).otherwise(F.col("semantic_type"))
    )
    kind = F.when(metric, "achievement_metric").when(skill, F.when(filled("level"), "skill").otherwise("language")).when(credential, "credential").otherwise(generic)
    chunk_id = F.when(metric, F.concat_ws("::", "record_id", metric_id)).when(skill | credential, F.concat_ws("::", "record_id", slug(F.col("title")))).otherwise(F.col("section_id"))
    usable = low("status").isin(*approved) & truthy(get("public safe")) & (low("cv usage") == "approved")
    live = ~low("status").rlike("expired|inactive|revoked") & ~low("cv usage").isin(*BLOCKED_USE)
    fit = F.when(metric, F.col("eligible") & usable).when(skill, F.col("eligible")).when(credential, F.col("eligible") & live).otherwise(F.col("eligible") & (F.col("retrieval_class") == "evidence"))
    given = lambda *ks: F.filter(F.array(*[get(k) for k in ks]), lambda x: F.coalesce(x, F.lit("")) != "")
    limits = F.when(metric, given("usage constraint")).when(skill, given("usage note", "boundary")).when(credential, F.array().cast("array<string>")).otherwise(F.col("bounds"))
    refs = F.when(metric, F.array(metric_id)).when(skill | credential, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct("metric_refs")))
    out = s.select(
        chunk_id.alias("chunk_id"), "record_id", "record_type", kind.alias("chunk_type"), "title", "heading_path", strip(F.concat_ws("\n", "title", "content")).alias("text"), "source_path", "source_refs",
        refs.alias("metric_refs"), limits.alias("constraints"), "retrieval_class", fit.alias("cv_eligible"), F.when(skill, F.coalesce(get("proficiency"), F.nullif(low("level"), F.lit("")))).alias("proficiency"), "pos",
    )
    return out.withColumn("content_hash", semantic_hash("chunk_id", "constraints", "metric_refs", "proficiency", "record_id", "source_refs", "text"))


def active(chunks: DataFrame) -> DataFrame:
    """Chunks that are indexed; of several with one id the last by position counts."""
    ok = chunks.filter("cv_eligible AND retrieval_class = 'evidence'")
    return ok.groupBy("chunk_id").agg(F.max_by(F.struct(*[F.col(c) for c in ok.columns if c != "chunk_id"]), "pos").alias("x")).select("chunk_id", "x.*")


PROMPT = ("chunk_id", "record_id", "chunk_type", "title", "text", "proficiency", "metric_refs", "constraints", "source_path", "attributes")


def compact(chunks: DataFrame) -> DataFrame:
    """Chunks as they go into a prompt: (chunk_id, payload JSON, size in characters), for the budget."""
    have = [c for c in PROMPT if c in chunks.columns]
    payload = F.to_json(F.struct(*have), {"ignoreNullFields": "false"})
    return chunks.select("chunk_id", payload.alias("payload")).withColumn("size", F.length("payload"))
