"""Edge of the engine: rendering, templates, brands, identity, readiness of bundles, and the feed."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section headings by language.
HEADINGS = {
    "en": {"summary": "Professional Summary", "experience": "Experience", "projects": "Selected Projects", "skills": "Skills", "education": "Education", "certifications": "Certifications"},
    "es": {"summary": "Resumen Profesional", "experience": "Experiencia", "projects": "Proyectos Seleccionados", "skills": "Habilidades", "education": "Formación", "certifications": "Certificaciones"},
    "fr": {"summary": "Résumé Professionnel", "experience": "Expérience", "projects": "Projets Sélectionnés", "skills": "Compétences", "education": "Formation", "certifications": "Certifications"},
}


def heading(section: str) -> Column:
    """Heading of a section in the document's language, English where it is none of the known."""
    out = F.lit("## " + HEADINGS["en"][section])
    for lang in ("es", "fr"):
        out = F.when(F.col("language") == lang, "## " + HEADINGS[lang][section]).otherwise(out)
    return out


def markdown(docs: DataFrame) -> DataFrame:
    """``(doc_id, markdown)`` of documents; projects, education and certifications only where there are any."""
    bullets = lambda xs: F.transform(xs, lambda b: F.concat(F.lit("- "), b["text"]))
    one = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    none = F.array().cast("array<string>")
    jobs = F.flatten(F.transform("experience", lambda x: F.concat(one(F.concat(F.lit("### "), x["title"], F.lit(" — "), x["organization"]), F.concat(F.lit("*"), x["period"], F.lit("*")), ""), bullets(x["bullets"]), one(""))))
    work = F.flatten(F.transform("projects", lambda x: F.concat(one(F.concat(F.lit("### "), x["name"])), bullets(x["bullets"]), one(""))))
    listed = lambda c: F.concat(one(heading(c), ""), bullets(F.col(c)), one(""))
    some = lambda c, body: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, body).otherwise(none)
    lines = F.concat(
        one(F.concat(F.lit("# "), F.col("headline.text")), "", F.concat(F.lit("**"), F.col("target_role"), F.lit("**")), "", heading("summary"), "", F.col("summary.text"), "", heading("experience"), ""),
        F.coalesce(jobs, none), some("projects", F.concat(one(heading("projects"), ""), work)), F.coalesce(listed("skills"), one(heading("skills"), "", "")), some("education", listed("education")), some("certifications", listed("certifications")),
    )
    return docs.select("doc_id", F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def letter_markdown(letters: DataFrame) -> DataFrame:
    """``(doc_id, markdown)`` of ``letters(doc_id, salutation, paragraphs array<string>, closing)``."""
    parts = F.concat(F.array(F.trim("salutation")), F.transform("paragraphs", lambda p: F.trim(p)), F.array(F.trim("closing")))
    return letters.select("doc_id", F.concat(F.trim(F.array_join(parts, "\n\n")), F.lit("\n")).alias("markdown"))


def escape(c: Column) -> Column:
    """HTML escape, null as empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


@dataclass(frozen=True)
class Template:
    template_id: str
    file: str
    adaptive: bool = True
    locked: bool = False
    #: Line length and lines a page of each attempt to fit, more careful each time.
    attempts: tuple[tuple[int, int], ...] = ((92, 50), (86, 47), (80, 44), (72, 40), (64, 36))


NARROW = ((84, 46), (78, 43), (72, 40), (66, 37), (60, 35))
TEMPLATES = {
    t.template_id: t
    for t in (
        Template("sidebar_a", "sidebar_a.html.j2", attempts=NARROW), Template("sidebar_b", "sidebar_b.html.j2", attempts=NARROW), Template("letter", "letter.html.j2"), Template("classic", "letter.html.j2"),
        Template("locked", "locked.html.j2", adaptive=False, locked=True, attempts=NARROW),
    )
}


def template(template_id: str) -> Template:
    if template_id not in TEMPLATES:
        raise ValueError(f"unknown template {template_id!r}; known: {sorted(TEMPLATES)}")
    return TEMPLATES[template_id]


@dataclass(frozen=True)
class Brand:
    company: str
    source_kind: str = "fallback"
    source_url: str | None = None
    verified: bool = False
    primary: str = "#1F2937"
    secondary: str = "#4B5563"
    accent: str = "#2563EB"
    surface: str = "#FFFFFF"
    text: str = "#111827"
    muted: str = "#4B5563"

    def __post_init__(self) -> None:
        for c in (self.primary, self.secondary, self.accent, self.surface, self.text, self.muted):
            if not re.fullmatch("#[0-9A-Fa-f]{6}", c):
                raise ValueError(f"not a colour of six hex digits: {c!r}")


def company_slug(company: str) -> str:
    plain = unicodedata.normalize("NFKD", company).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-") or "company"


def resolve_brand(company: str, profiles: Mapping[str, Mapping[str, object]]) -> Brand:
    """The company's profile, by slug; a neutral fallback if there is none. A profile of another company, or one that is no fallback and not verified, raises."""
    found = profiles.get(company_slug(company))
    if found is None:
        return Brand(company)
    brand = Brand(**found)
    if brand.company.strip().lower() != company.strip().lower():
        raise ValueError(f"brand profile of {brand.company!r} is not that of {company!r}")
    if brand.source_kind != "fallback" and not (brand.verified and brand.source_url):
        raise ValueError("a brand profile must be verified and name its source")
    return brand


PUBLIC, PRIVATE = ("name", "location", "linkedin", "github", "website"), ("email", "phone")


def resolve_identity(public: Mapping[str, str | None], env: Mapping[str, str], with_private: bool = False, visibility: str = "public", override: bool = False) -> tuple[dict[str, str], dict[str, str]]:
    """Fields and where each comes from: the environment before the public file. Private fields only come from the environment, on request, and not into
    public artifacts unless overridden."""
    if visibility not in ("public", "private"):
        raise ValueError("visibility must be public or private")
    if with_private and visibility == "public" and not override:
        raise ValueError("private contact data is refused in a public artifact")
    if bad := sorted(k for k in PRIVATE if public.get(k)):
        raise ValueError(f"private fields in the public file: {bad}")
    if bad := sorted(set(public) - {*PUBLIC, *PRIVATE}):
        raise ValueError(f"unknown fields in the public file: {bad}")
    values = {k: v for k in PUBLIC if (v := public.get(k))}
    source = dict.fromkeys(values, "public_file")
    for k in (*PUBLIC, *(PRIVATE if with_private else ())):
        if (v := (env.get(f"IDENTITY_{k.upper()}") or "").strip()):
            values[k], source[k] = v, "environment"
    if not values.get("name"):
        raise ValueError("a name is required")
    return values, source


def bundle_readiness(bundles: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds ``reasons`` and ``ready_to_send`` to ``bundles(doc_id, quality_reached, letter_ready)``; ``templates(doc_id, role, fit_status, design_status,
    physical_status)``, of which the primary one counts."""
    primary = templates.filter("role = 'primary'").select("doc_id", "fit_status", "design_status", "physical_status")
    j = bundles.join(primary, "doc_id", "left")
    rules = [
        (~F.col("quality_reached"), "content_quality_target_not_reached"), (~F.col("letter_ready"), "cover_letter_missing"), (~F.col("fit_status").eqNullSafe("FIT"), "primary_template_fit_failed"),
        (~F.col("design_status").eqNullSafe("PASS"), "primary_template_design_failed"), (~F.col("physical_status").eqNullSafe("PASS"), "primary_template_physical_layout_failed"),
    ]
    out = j.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in rules])))
    return out.withColumn("ready_to_send", F.size("reasons") == 0)


def finalize(results: DataFrame, bundles: DataFrame) -> DataFrame:
    """``(vacancy_id, run_id, status)`` of a batch: no fresh output, missing output, blocked by a gate (to review), failed, or as the bundle says.

    ``results(vacancy_id, run_id)``; ``bundles(vacancy_id, run_id, ready_to_send, blocked, error)``."""
    j = results.join(bundles.withColumn("_there", F.lit(True)), ["vacancy_id", "run_id"], "left")
    fresh = (F.coalesce("vacancy_id", F.lit("")) != "") & (F.coalesce("run_id", F.lit("")) != "")
    status = (
        F.when(~fresh, "SKIPPED_NO_FRESH_OUTPUT").when(F.col("_there").isNull(), "SKIPPED_MISSING_OUTPUT").when(F.col("error").isNotNull(), "FAILED_PRESENTATION_GATE")
        .when(F.col("blocked").isNotNull() | ~F.col("ready_to_send"), "REVIEW_REQUIRED").otherwise("PASS")
    )
    return j.select("vacancy_id", "run_id", status.alias("status"), F.coalesce("blocked", "error").alias("reason"))


def of_date(records: DataFrame, day: str) -> DataFrame:
    """Records that a source of the day has: searched then, updated then, or with the day in its path."""
    yes = lambda test: F.coalesce(test, F.lit(False))
    return records.filter(F.exists("provenance", lambda p: yes(p["source_search_date"] == day) | yes(p["source_updated_at"].startswith(day)) | yes(F.contains(p["source_path"], F.lit(day)))))


def feed(records: DataFrame, batch: DataFrame, reports: DataFrame, day: str) -> DataFrame:
    """Rows of the feed in order: records of the day with the status of their latest result and the scores of its report.

    ``batch(vacancy_id, run_id, status, ready_to_send, seq)``, the last of which counts; ``reports(run_id, match_coverage_score, overall_score)``."""
    last = batch.groupBy("vacancy_id").agg(F.max_by(F.struct("run_id", "status", "ready_to_send"), "seq").alias("b")).select("vacancy_id", "b.*")
    j = of_date(records, day).join(last, "vacancy_id", "left").join(reports, "run_id", "left")
    ready = F.coalesce("ready_to_send", F.lit(False))
    rows = j.select(
        "vacancy_id", "company", "role_title", "url", "fit_score", F.coalesce("fit_summary", F.lit("")).alias("fit_summary"), "jd_fidelity", F.coalesce("location_raw", "city").alias("location"), "work_model",
        F.col("match_coverage_score").alias("coverage"), F.col("overall_score").alias("review_score"), F.when(ready, "READY").otherwise(F.coalesce("status", F.lit("NOT GENERATED"))).alias("generation_status"), ready.alias("ready_to_send"),
    )
    return rows.orderBy(F.coalesce("fit_score", F.lit(0.0)).desc(), F.coalesce("company", F.lit("")))


def feed_page(day: str, rows: list[Mapping[str, object]]) -> str:
    """A plain page of feed rows that the caller has fetched, as many as one page shows."""
    safe = lambda x: html.escape(str(x if x is not None else ""), quote=True)
    items = "".join(f"<li><b>{safe(r['company'])}</b> {safe(r['role_title'])} <i>{safe(r['generation_status'])}</i></li>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{safe(day)}</title><ul>{items}</ul>\n"


def models(docs: DataFrame, config_json: str) -> DataFrame:
    """Documents with digests of themselves and of the configuration they are shown with."""
    body = F.to_json(F.struct(*sorted(c for c in docs.columns if c != "doc_id")), {"ignoreNullFields": "false"})
    return docs.withColumn("source_cv_hash", F.sha2(body, 256)).withColumn("config_hash", F.sha2(F.lit(config_json), 256))
