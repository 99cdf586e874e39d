"""Validation of generated claims against the evidence that they cite, and the gates on top.

Claims are rows ``(doc_id, location, text, refs)``; evidence is ``(chunk_id, text, chunk_type, proficiency, constraints, cv_eligible)``; what a document
may cite is ``(doc_id, chunk_id)``. References meet evidence in one equi-join, are brought back a row a claim, and all codes are
expressions over that row. Issues are rows ``(doc_id, location, code, detail)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbers

# Patterns and word lists.
QUANTIFIED = r"(?:\b\d+(?:[.,]\d+)?\s*%|\b\d+(?:[.,]\d+)?\s*[xX]\b|\bMXN\b|\bUSD\b|\$\s*\d|\b\d+\s*->\s*\d+)"
YEARS = r"(?iU)\b(\d{1,2})\+?\s*(?:years?|años?)\b"
PEOPLE = (
    r"(?i)(?:direct reports?|people manager|managed (?:a )?team of \d+|led (?:a )?team of \d+|"
    r"reportes directos|gestion(?:ó| de)? (?:un )?equipo de \d+|dirigi(?:ó|r) (?:un )?equipo de \d+)"
)
SPECIALIZATIONS = ("arima", "sarima", "prophet")
EXPERT = ("expert", "expertise", "advanced", "mastery", "experto", "experta", "dominio avanzado")
BOUNDARIES = ("do not claim", "do not present", "must not claim", "no claim", "no inferred", "do not infer")
APPROXIMATE = ("approximately", "approx.", "approx ", "aproximadamente")
ATTRIBUTIONS = ("llm", "assistant")
MARKERS = {
    "en": ("the", "and", "with", "for", "led", "built", "developed", "designed", "improved", "model", "data", "business", "production"),
    "es": ("el", "la", "los", "las", "con", "para", "lideró", "desarrolló", "diseñó", "mejoró", "modelo", "datos", "negocio", "producción"),
}
THRESHOLDS = (("overall_score", 92), ("vacancy_alignment", 90), ("evidence_strength", 95), ("language_quality", 95))


def cited(claims: DataFrame, evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """Claims with ``cites``: an array, in the order of the references, of (ref, known, allowed, evidence fields)."""
    refs = claims.select("doc_id", "location", F.posexplode("refs").alias("at", "ref"))
    ok = allowed.select("doc_id", F.col("chunk_id").alias("ref"), F.lit(True).alias("_ok")).distinct()
    ev = evidence.select(F.col("chunk_id").alias("ref"), F.col("text").alias("ev_text"), "chunk_type", "proficiency", "constraints", "cv_eligible", F.lit(True).alias("_known"))
    met = refs.join(ev, "ref", "left").join(ok, ["doc_id", "ref"], "left")
    one = F.struct(
        "at", "ref", F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce("_ok", F.lit(False)).alias("ok"), "ev_text", "chunk_type", "proficiency",
        F.coalesce("constraints", F.array().cast("array<string>")).alias("limits"), F.coalesce("cv_eligible", F.lit(False)).alias("eligible"),
    )
    back = met.groupBy("doc_id", "location").agg(F.array_sort(F.collect_list(one)).alias("cites"))
    return claims.join(back, ["doc_id", "location"], "left")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _shared(words: tuple[str, ...], a: Column, b: Column) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(a, w) & F.contains(b, w))


def _years(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(YEARS), F.lit(1)), lambda x: x.cast("int")))


def claim_issues(claims: DataFrame, evidence: DataFrame, allowed: DataFrame, attributions: tuple[str, ...] = ATTRIBUTIONS) -> DataFrame:
    """All issues of all claims; ``attributions`` are names that a metric may be forbidden to be credited to. A claim without references, or with an unknown one, has that issue alone."""
    c = cited(claims, evidence, allowed)
    cites, text = F.col("cites"), F.lower("text")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.coalesce(x["ev_text"], F.lit(""))), "\n")
    refs_where = lambda test: F.array_join(F.transform(F.filter(cites, test), lambda x: x["ref"]), ",")
    metric = F.filter(cites, lambda x: x["chunk_type"] == "achievement_metric")
    c = c.withColumn("ev", joined(cites)).withColumn("metric", metric).withColumn("mtext", joined(F.col("metric")))
    c = c.withColumn("limits", F.lower(F.array_join(F.flatten(F.transform("metric", lambda x: x["limits"])), " ")))
    none = F.coalesce(F.size("refs"), F.lit(0)) == 0
    unknown = F.exists(cites, lambda x: ~x["known"])
    fine = ~none & ~F.coalesce(unknown, F.lit(False))
    in_body = F.regexp_like("location", F.lit("^(summary|experience|projects)"))
    quantified = fine & in_body & F.regexp_like("text", F.lit(QUANTIFIED))
    measured = quantified & (F.size("metric") > 0)
    extra = F.array_sort(F.array_except(numbers(F.col("text")), numbers(F.col("mtext"))))
    limits = F.col("limits")
    years, held = _years(F.col("text")), _years(F.col("ev"))
    blocked = F.filter(F.flatten(F.transform(cites, lambda x: F.transform(x["limits"], lambda y: F.lower(y)))), lambda y: _has(y, BOUNDARIES))
    people = F.regexp_like("text", F.lit(PEOPLE))
    rules: list[tuple[Column, str, Column]] = [
        (none, "missing_evidence_ref", F.lit("")),
        (~none & unknown, "unknown_evidence_ref", refs_where(lambda x: ~x["known"])),
        (fine & F.exists(cites, lambda x: ~x["ok"]), "evidence_outside_match", refs_where(lambda x: ~x["ok"])),
        (fine & F.exists(cites, lambda x: ~x["eligible"]), "ineligible_evidence", refs_where(lambda x: ~x["eligible"])),
        (fine & (years.isNotNull() & (held.isNull() | (years > held))), "unsupported_years_claim", years.cast("string")),
        (fine & people & ~F.regexp_like("ev", F.lit(PEOPLE)), "unsupported_people_management", F.lit("")),
        (quantified & (F.size("metric") == 0), "quantified_claim_without_metric", F.lit("")),
        (measured & (F.size(extra) > 0), "metric_value_not_in_evidence", F.array_join(extra, ",")),
        (measured & F.contains(limits, F.lit("up to")) & ~_has(text, ("up to", "hasta")), "metric_qualifier_lost", F.lit("up to")),
        (measured & F.contains(limits, F.lit("approximately")) & ~_has(text, APPROXIMATE), "metric_qualifier_lost", F.lit("approximately")),
        (measured & F.contains(limits, F.lit("do not attribute")) & (F.size(_shared(attributions, limits, text)) > 0), "forbidden_metric_attribution", F.array_join(_shared(attributions, limits, text), ",")),
    ]
    single = F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), detail.alias("detail"))) for test, code, detail in rules])
    named = F.transform(F.filter(F.array(*[F.lit(s) for s in SPECIALIZATIONS]), lambda s: F.contains(text, s) & ~F.contains(F.lower("ev"), s)), lambda s: F.struct(F.lit("unsupported_specialization").alias("code"), s.alias("detail")))
    walls = F.flatten(F.transform(blocked, lambda y: F.array_compact(F.array(
        F.when(F.size(_shared(SPECIALIZATIONS, y, text)) > 0, F.struct(F.lit("evidence_boundary_violation").alias("code"), F.array_join(_shared(SPECIALIZATIONS, y, text), ",").alias("detail"))),
        F.when(F.contains(y, F.lit("people management")) & people, F.struct(F.lit("evidence_boundary_violation").alias("code"), F.lit("people management").alias("detail"))),
    ))))
    modest = F.filter(cites, lambda x: F.coalesce(F.lower(x["proficiency"]).isin("familiarity", "working"), F.lit(False)) & _has(text, EXPERT))
    steps = F.transform(modest, lambda x: F.struct(F.lit("proficiency_escalation").alias("code"), x["ref"].alias("detail")))
    several = F.when(fine, F.concat(walls, named, steps)).otherwise(F.array().cast("array<struct<code:string,detail:string>>"))
    return c.select("doc_id", "location", F.inline(F.concat(F.array_compact(single), several)))


def marker_balance(text: Column) -> tuple[Column, Column]:
    """Counts of English and Spanish marker words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúüñ]+"), F.lit(0))
    return tuple(F.size(F.filter(found, _among(lang))) for lang in ("en", "es"))


def _among(lang: str):
    return lambda w: w.isin(*MARKERS[lang])


def language_issues(docs: DataFrame) -> DataFrame:
    """Issues of ``docs(doc_id, language, expected, text)``; with ``und`` expected one warning alone."""
    en, es = marker_balance(F.col("text"))
    und = F.col("expected") == "und"
    rules = [
        (und, "language_undetermined"), (~und & ~F.col("language").eqNullSafe(F.col("expected")), "language_code_mismatch"),
        ((F.col("expected") == "en") & (es >= en + 4), "language_content_mismatch"), ((F.col("expected") == "es") & (en >= es + 4), "language_content_mismatch"),
    ]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules]))).alias("code"))


def structure_issues(docs: DataFrame, least: int = 3, most: int = 18) -> DataFrame:
    """Issues of ``docs(doc_id, n_experience, n_bullets)``."""
    rules = [(F.col("n_experience") == 0, "missing_experience"), (F.col("n_bullets") < least, "too_few_bullets"), (F.col("n_bullets") > most, "too_many_bullets")]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules]))).alias("code"))


def quality_gate(reviews: DataFrame) -> DataFrame:
    """Adds ``passed`` and ``reasons`` to ``reviews(decision, <scores>, n_blocking, factual, language, structure)``, the last three being statuses."""
    rules = [(F.col("decision") != "PASS", "headhunter_decision_not_pass")]
    rules += [(F.col(c) < n, f"{c}_below_{n}") for c, n in THRESHOLDS]
    rules += [(F.col("n_blocking") > 0, "blocking_issues_present")]
    rules += [(F.col(c) != "PASS", f"{c}_validation_failed") for c in ("factual", "language", "structure")]
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in rules]))
    return reviews.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def letter_issues(letters: DataFrame, cv_refs: DataFrame, most_words: int = 200) -> DataFrame:
    """Issues of ``letters(doc_id, language, expected_language, company, expected_company, role, expected_role, text, refs)``: other language, company
    or role than the document's, too long, or references that ``cv_refs(doc_id, ref)`` does not have."""
    rules = [(~F.col(c).eqNullSafe(F.col(f"expected_{c}")), f"{c}_mismatch") for c in ("language", "company", "role")]
    rules.append((F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) > most_words, "too_many_words"))
    plain = letters.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules]))).alias("code"), F.lit("").alias("detail"))
    refs = letters.select("doc_id", F.explode("refs").alias("ref")).distinct().join(cv_refs.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti")
    return plain.unionByName(refs.select("doc_id", F.lit("unknown_evidence_ref").alias("code"), F.col("ref").alias("detail")))


def trace_issues(traces: DataFrame, chunks: DataFrame, records: DataFrame) -> DataFrame:
    """What ``traces(trace_id, vacancy_id, chunk_ids, record_ids, chunk_paths, record_paths)`` claims beyond ``chunks(vacancy_id, chunk_id, source_paths)``
    and ``records(record_id, source_path)``: rows (trace_id, code, detail); none if the lineage holds."""
    t = traces
    ids = t.select("trace_id", "vacancy_id", F.explode("chunk_ids").alias("chunk_id"))
    no_chunk = ids.join(chunks, ["vacancy_id", "chunk_id"], "left_anti").select("trace_id", F.lit("unknown_chunk").alias("code"), F.col("chunk_id").alias("detail"))
    recs = t.select("trace_id", F.explode("record_ids").alias("record_id"))
    no_record = recs.join(records, "record_id", "left_anti").select("trace_id", F.lit("unknown_record").alias("code"), F.col("record_id").alias("detail"))
    has = ids.join(chunks, ["vacancy_id", "chunk_id"]).select("trace_id", F.explode("source_paths").alias("path")).distinct()
    no_path = t.select("trace_id", F.explode("chunk_paths").alias("path")).distinct().join(has, ["trace_id", "path"], "left_anti").select("trace_id", F.lit("unsupported_chunk_path").alias("code"), F.col("path").alias("detail"))
    held = recs.join(records, "record_id").select("trace_id", F.col("source_path").alias("path")).distinct()
    no_source = t.select("trace_id", F.explode("record_paths").alias("path")).distinct().join(held, ["trace_id", "path"], "left_anti").select("trace_id", F.lit("unsupported_record_path").alias("code"), F.col("path").alias("detail"))
    return no_chunk.unionByName(no_record).unionByName(no_path).unionByName(no_source)
