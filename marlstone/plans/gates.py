"""Queries on validators and gates, the work queue, the feed and evaluation; rows are made of the relational tables by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import source_key
from ..functions.text import fields, slug, truthy, work_model
from ..operators import chunks, context, dense, evals, fitting, hybrid, matching, presentation, queue, validators
from . import retrieval, workflow
from .registry import registry
from .sqlkit import in_list, table

QUERIES, SQL, query = registry()

#: Claims by the remainder of a key: text, references, codes that must come out.
CLAIMS = (
    ("fine", ("s1",), ()), ("x", (), ("missing_evidence_ref",)), ("10 years of x", ("s1", "zz"), ("unknown_evidence_ref",)), ("x", ("x1",), ("evidence_outside_match", "ineligible_evidence")),
    ("6 years", ("s1",), ("unsupported_years_claim",)), ("led a team of 5", ("s1",), ("unsupported_people_management",)), ("used ARIMA", ("s1",), ("unsupported_specialization",)),
    ("grew 30%", ("s1",), ("quantified_claim_without_metric",)), ("grew 25%", ("m1",), ("metric_qualifier_lost",)), ("up to 30%", ("m1",), ("metric_value_not_in_evidence",)),
    ("LLM up to 25%", ("m1",), ("forbidden_metric_attribution",)), ("expert in SQL", ("s1",), ("proficiency_escalation",)),
    ("Prophet", ("x1",), ("evidence_boundary_violation", "evidence_outside_match", "ineligible_evidence", "unsupported_specialization")),
)
EVIDENCE = [("m1", "ACH Result 25% up to", "achievement_metric", None, ["up to 25", "do not attribute to LLM"], True), ("s1", "SQL for 5 years", "skill", "familiarity", [], True), ("x1", "plain", "section", None, ["Do not claim prophet"], False)]


def _pick(values: list[Column], n: Column) -> Column:
    return F.element_at(F.array(*values), (n + 1).cast("int"))


@query(f"SELECT p_partkey AS doc_id, code FROM (SELECT p_partkey, unnest(({[list(c) for _, _, c in CLAIMS]})[p_partkey % {len(CLAIMS)} + 1]) AS code FROM part)")
def claim_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each part, each rule in turn."""
    n = F.col("p_partkey") % len(CLAIMS)
    refs = _pick([F.array(*[F.lit(r) for r in c[1]]).cast("array<string>") for c in CLAIMS], n)
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("summary").alias("location"), _pick([F.lit(c[0]) for c in CLAIMS], n).alias("text"), refs.alias("refs"))
    evidence = spark.createDataFrame(EVIDENCE, "chunk_id string, text string, chunk_type string, proficiency string, constraints array<string>, cv_eligible boolean")
    allowed = claims.select("doc_id", F.explode(F.array(F.lit("m1"), F.lit("s1"))).alias("chunk_id"))
    return validators.claim_issues(claims, evidence, allowed).select("doc_id", "code")


def _markers(lang: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-záéíóúüñ]+'), lambda w: w IN {in_list(validators.MARKERS[lang])}))"


@query(f"""
WITH d AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'und' END AS want, {_markers('en')} AS en, {_markers('es')} AS es FROM documents),
c AS (SELECT doc_id, unnest([CASE WHEN want = 'und' THEN 'language_undetermined' END, CASE WHEN want <> 'und' AND lang IS DISTINCT FROM want THEN 'language_code_mismatch' END,
      CASE WHEN (want = 'en' AND es >= en + 4) OR (want = 'es' AND en >= es + 4) THEN 'language_content_mismatch' END]) AS code FROM d)
SELECT doc_id, code FROM c WHERE code IS NOT NULL
""")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = _pick([F.lit("en"), F.lit("es"), F.lit("und")], F.col("doc_id") % 3)
    return validators.language_issues(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), want.alias("expected"), "text"))


@query("""SELECT doc_id, code FROM (SELECT o_orderkey AS doc_id, unnest([CASE WHEN o_orderkey % 4 = 0 THEN 'missing_experience' END, CASE WHEN o_custkey % 25 < 3 THEN 'too_few_bullets' END,
CASE WHEN o_custkey % 25 > 18 THEN 'too_many_bullets' END]) AS code FROM orders) WHERE code IS NOT NULL""")
def structure_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validators.structure_issues(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 4).alias("n_experience"), (F.col("o_custkey") % 25).alias("n_bullets")))


@query(r"""
WITH l AS (SELECT doc_id, lang, source, text, doc_id % 10 AS r FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, unnest([CASE WHEN lang IS DISTINCT FROM 'en' THEN 'language_mismatch' END, CASE WHEN source IS DISTINCT FROM 'web' THEN 'company_mismatch' END, CASE WHEN len(regexp_extract_all(text, '\S+')) > 200 THEN 'too_many_words' END]) AS code, '' AS detail FROM l
      UNION ALL SELECT doc_id, 'unknown_evidence_ref', 'e' || r FROM l WHERE r >= 7)
SELECT doc_id, code, detail FROM c WHERE code IS NOT NULL
""")
def letter_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as letters; each cites two chunks, of which its document has those numbered below 7."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    ref = F.concat(F.lit("e"), F.col("doc_id") % 10)
    same = F.lit("Lead")
    letters = d.select("doc_id", F.col("lang").alias("language"), F.lit("en").alias("expected_language"), F.col("source").alias("company"), F.lit("web").alias("expected_company"), same.alias("role"), same.alias("expected_role"), F.regexp_replace("text", r"[\x0b\x1c-\x1f\x85\p{Z}]", "_").alias("t"), "text", F.array(ref, F.lit("e0")).alias("refs"))
    held = d.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("e"), i.cast("string")))).alias("ref"))
    return validators.letter_issues(letters, held)


@query("""SELECT doc_id, page, code FROM (SELECT p_partkey AS doc_id, 1 AS page, unnest([CASE WHEN p_size % 3 <> 2 THEN 'page_count_mismatch' END, CASE WHEN p_size % 5 > 0 THEN 'overflow' END, CASE WHEN p_size % 7 > 3 THEN 'orphan_heading' END,
CASE WHEN p_size % 6 > 2 THEN 'page_size_mismatch' END]) AS code FROM part) WHERE code IS NOT NULL""")
def layout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    over = lambda n, m: F.greatest(s % n - m, F.lit(0))
    return fitting.layout_issues(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(2).alias("expected_pages"), (s % 3).alias("n_pages"), (612.0 + s % 6).alias("width_pt"), F.lit(792.0).alias("height_pt"), over(5, 0).alias("n_overflow"), over(7, 3).alias("n_orphans"),
    ))


@query("""
WITH x AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS vacancy_id, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'r' || o_custkey END AS run_id FROM orders)
SELECT vacancy_id, run_id, CASE WHEN run_id = '' THEN 'SKIPPED_NO_FRESH_OUTPUT' WHEN o_orderkey % 5 = 0 THEN 'SKIPPED_MISSING_OUTPUT' WHEN o_orderkey % 7 = 0 THEN 'FAILED_PRESENTATION_GATE'
       WHEN o_orderkey % 11 = 0 OR o_orderkey % 2 = 1 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'brand' WHEN o_orderkey % 7 = 0 THEN 'boom' END AS reason FROM x
""")
def batch_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    run = F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("r"), F.col("o_custkey")))
    results = table(spark, sf_dir, "orders").select(k.cast("string").alias("vacancy_id"), run.alias("run_id"), k.alias("o_orderkey"))
    bundles = results.filter(k % 5 != 0).select("vacancy_id", "run_id", (k % 2 == 0).alias("ready_to_send"), F.when(k % 11 == 0, "brand").alias("blocked"), F.when(k % 7 == 0, "boom").alias("error"))
    return presentation.finalize(results.drop("o_orderkey"), bundles)


@query("""
WITH b AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'content_quality_target_not_reached' END, CASE WHEN c_custkey % 3 = 0 THEN 'cover_letter_missing' END,
  CASE WHEN c_custkey % 13 = 0 OR c_custkey % 5 = 0 THEN 'primary_template_fit_failed' END, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 7 = 0 THEN 'primary_template_design_failed' END,
  CASE WHEN c_custkey % 13 = 0 OR c_custkey % 11 = 0 THEN 'primary_template_physical_layout_failed' END], lambda x: x IS NOT NULL) AS r FROM customer)
SELECT c_custkey AS doc_id, array_to_string(r, ',') AS reasons, len(r) = 0 AS ready_to_send FROM b
""")
def bundle_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth has no primary template."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    bad = lambda n, good: F.when(k % n == 0, "FAILED").otherwise(good)
    bundles = c.select(k.alias("doc_id"), (k % 2 != 0).alias("quality_reached"), (k % 3 != 0).alias("letter_ready"))
    templates = c.select(k.alias("doc_id"), F.when(k % 13 == 0, "alternate").otherwise("primary").alias("role"), bad(5, "FIT").alias("fit_status"), bad(7, "PASS").alias("design_status"), bad(11, "PASS").alias("physical_status"))
    return presentation.bundle_readiness(bundles, templates).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "ready_to_send")


@query("""
WITH last AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS run FROM orders GROUP BY o_custkey)
SELECT c_custkey AS vacancy_id, c_name AS company, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS fit_score, CASE WHEN run IS NULL THEN 'NOT GENERATED' WHEN run % 2 = 0 THEN 'READY' ELSE status END AS generation_status,
       coalesce(run % 2 = 0, false) AS ready_to_send, CASE WHEN run % 3 = 0 THEN CAST(run % 100 AS DOUBLE) END AS coverage, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS location
FROM customer LEFT JOIN last ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0
""")
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a day (by path, date of search or of update) with their latest order as result, and its report."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    day, none = "2026-01-02", F.lit(None).cast("string")
    told = F.struct(
        F.when(k % 3 == 1, f"in/{day}.json").otherwise("in/x.json").alias("source_path"), F.when(k % 3 == 2, day).otherwise(none).alias("source_search_date"), F.when(k % 2 == 0, day + "T10").otherwise(none).alias("source_updated_at"),
    )
    records = c.select(
        k.alias("vacancy_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("role_title"), none.alias("url"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("fit_score"), none.alias("fit_summary"),
        F.lit("full").alias("jd_fidelity"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("location_raw"), F.col("c_name").alias("city"), none.alias("work_model"), F.array(told).alias("provenance"),
    )
    batch = o.select(F.col("o_custkey").alias("vacancy_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("ready_to_send"), F.col("o_orderkey").alias("seq"))
    reports = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 100).cast("double").alias("match_coverage_score"), F.lit(95).alias("overall_score"))
    return presentation.feed(records, batch, reports, day).select("vacancy_id", "company", "fit_score", "generation_status", "ready_to_send", "coverage", "location")


@query("""
SELECT l_orderkey AS doc_id, arg_min(l_linenumber, (CASE WHEN l_discount > 0.08 THEN 0 ELSE 1 END, CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END, -l_quantity, -l_tax, l_linenumber)) AS iteration FROM lineitem GROUP BY l_orderkey
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as candidates."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("iteration"), (F.col("l_discount") > 0.08).alias("gate_passed"), (F.col("l_quantity") > 25).alias("validators_pass"), F.col("l_quantity").alias("overall_score"), F.col("l_tax").alias("evidence_score"))
    return queue.best_iteration(rows, "doc_id").select("doc_id", "iteration")


@query("SELECT p_partkey, CASE WHEN p_size % 5 + 1 <= 2 THEN 1 WHEN p_size % 5 + 1 <= 4 THEN 2 ELSE 3 END AS tier FROM part")
def escalation_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", queue.escalation_tier(F.col("p_size") % 5 + 1).alias("tier"))


@query("""
WITH e AS (SELECT o_orderkey AS k, o_orderkey % 4 AS v, o_orderkey % 5 = 0 AS deferred FROM orders),
u AS (SELECT k, 0 AS part FROM e WHERE deferred UNION ALL SELECT k, 1 FROM e WHERE v <> 3 AND k % 3 <> 0 UNION ALL SELECT k, 2 FROM e WHERE k % 7 = 0)
SELECT k AS vacancy_id, row_number() OVER (ORDER BY part, CAST(k AS VARCHAR)) AS pos FROM (SELECT k, min(part) AS part FROM u GROUP BY k)
""")
def queue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deferred entries, those of another logic version that still have a record, then fresh ones, each once."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    entries = o.select(k.alias("vacancy_id"), F.when(k % 5 == 0, queue.DEFERRED).otherwise("PASS").alias("status"), (k % 4).cast("int").alias("logic_version"))
    name = k.alias("vacancy_id")
    return queue.candidates(entries, o.filter(k % 3 != 0).select(name), o.filter(k % 7 == 0).select(name), 3).select("vacancy_id", F.col("pos").cast("bigint").alias("pos"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT l_orderkey AS trace_id, 'unknown_chunk' AS code, 'p' || l_partkey AS detail FROM l WHERE l_partkey % 4 = 0
UNION ALL SELECT l_orderkey, 'unknown_record', 'p' || l_partkey FROM l WHERE l_partkey % 6 = 0
UNION ALL SELECT DISTINCT l_orderkey, 'unsupported_chunk_path', 's' || l_partkey % 10 FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey % 4 <> 0 AND b.l_partkey % 10 = a.l_partkey % 10)
UNION ALL SELECT DISTINCT l_orderkey, 'unsupported_record_path', 's' || l_partkey % 10 FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey % 6 <> 0 AND b.l_partkey % 10 = a.l_partkey % 10)
""")
def trace_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as traces that name their parts as chunks and records, and a source for each part; every fourth chunk and every sixth record are missing."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    part, path = F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_partkey") % 10)
    ids, paths = F.collect_set(part), F.collect_set(path)
    traces = l.groupBy(F.col("l_orderkey").alias("trace_id"), F.col("l_orderkey").alias("vacancy_id")).agg(ids.alias("chunk_ids"), ids.alias("record_ids"), paths.alias("chunk_paths"), paths.alias("record_paths"))
    there = l.filter("l_partkey % 4 <> 0").select(F.col("l_orderkey").alias("vacancy_id"), part.alias("chunk_id"), F.array(path).alias("source_paths"))
    records = table(spark, sf_dir, "part").filter("p_partkey % 6 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("record_id"), F.concat(F.lit("s"), F.col("p_partkey") % 10).alias("source_path"))
    return validators.trace_issues(traces, there, records)


DOCUMENT_SQL = """
l AS (SELECT o_orderkey AS d, l_linenumber - 1 AS i, 'part ' || l_partkey AS t, 'e' || l_partkey % 50 AS r, o_orderpriority, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey AS doc_id, 'headline' AS location, o_orderpriority AS text, ['h'] AS refs FROM orders UNION ALL SELECT o_orderkey, 'summary', o_orderstatus, ['h', 's'] FROM orders
      UNION ALL SELECT o_orderkey, 'experience[0].identity', 'Org ' || o_custkey || ' 2020', ['h'] FROM orders
      UNION ALL SELECT d, 'experience[0].bullets[' || row_number() OVER (PARTITION BY d ORDER BY i, t, r) - 1 || ']', t, [r] FROM l
      UNION ALL SELECT d, 'skills[' || row_number() OVER (PARTITION BY d ORDER BY i, t, r) - 1 || ']', t, [r] FROM l)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: a job whose bullets are the order's lines, which are its skills too."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line = lambda text, *refs: F.struct(text.alias("text"), F.array(*refs).alias("evidence_refs"))
    one = line(F.concat(F.lit("part "), F.col("l_partkey")), F.concat(F.lit("e"), F.col("l_partkey") % 50))
    lines = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("x")))), lambda y: y["x"]).alias("lines"))
    j = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("*")
    h, none = F.lit("h"), F.array().cast(f"array<{context.LINE}>")
    job = F.struct(F.lit("Org").alias("organization"), F.col("o_custkey").cast("string").alias("title"), F.lit("2020").alias("period"), F.array(h).alias("evidence_refs"), F.col("lines").alias("bullets"))
    return j.select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "es").otherwise("en").alias("language"), F.lit("Role").alias("target_role"), line(F.col("o_orderpriority"), h).alias("headline"), line(F.col("o_orderstatus"), h, F.lit("s")).alias("summary"),
        F.array(job).alias("experience"), F.array().cast(f"array<struct<name:string,evidence_refs:array<string>,bullets:array<{context.LINE}>>>").alias("projects"), F.col("lines").alias("skills"), none.alias("education"), none.alias("certifications"),
    )


@query(f"WITH {DOCUMENT_SQL} SELECT doc_id, location, text, array_to_string(refs, ',') AS refs FROM c WHERE doc_id IN (SELECT d FROM l)")
def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.claims(_documents(spark, sf_dir)).select("doc_id", "location", "text", F.array_join("refs", ",").alias("refs"))


@query(f"WITH {DOCUMENT_SQL} SELECT DISTINCT doc_id, unnest(refs) AS ref FROM c WHERE doc_id IN (SELECT d FROM l)")
def document_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.cited_refs(_documents(spark, sf_dir))


@query(f"""
WITH {DOCUMENT_SQL}, b AS (SELECT d, string_agg('- ' || t, chr(10) ORDER BY i, t, r) AS b FROM l GROUP BY d)
SELECT d AS doc_id, sha256('# ' || o_orderpriority || chr(10) || chr(10) || '**Role**' || chr(10) || chr(10) || '## ' || CASE WHEN d % 2 = 0 THEN 'Resumen Profesional' ELSE 'Professional Summary' END || chr(10) || chr(10) || o_orderstatus || chr(10) || chr(10) ||
  '## ' || CASE WHEN d % 2 = 0 THEN 'Experiencia' ELSE 'Experience' END || chr(10) || chr(10) || '### ' || o_custkey || ' — Org' || chr(10) || '*2020*' || chr(10) || chr(10) || b || chr(10) || chr(10) ||
  '## ' || CASE WHEN d % 2 = 0 THEN 'Habilidades' ELSE 'Skills' END || chr(10) || chr(10) || b || chr(10)) AS markdown_sha256 FROM b JOIN orders ON o_orderkey = d
""")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.markdown(_documents(spark, sf_dir)).select("doc_id", F.sha2("markdown", 256).alias("markdown_sha256"))


@query("""SELECT p_partkey, substr(trim(regexp_replace(p_name || '/ü ' || p_partkey, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 80) || '--' || substr(sha256(p_name || '/ü ' || p_partkey), 1, 16) AS key,
coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS slug, CASE p_size % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'On-site' ELSE 'Office' END AS work_model,
p_size % 3 = 0 AS approved, CAST(p_size AS VARCHAR) AS size FROM part""")
def name_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, slugs, work models, and fields of Markdown lists."""
    path = F.concat("p_name", F.lit("/ü "), F.col("p_partkey"))
    lines = F.concat(F.lit("x\n- **Public Safe:** "), F.when(F.col("p_size") % 3 == 0, "Yes ").otherwise("no"), F.lit("\n- **Size:** 0\n- **size:** `"), F.col("p_size"), F.lit("`\n"))
    f = fields(lines)
    model = _pick([F.lit(" Remoto"), F.lit("Híbrido"), F.lit("Presencial"), F.lit("Office ")], F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", source_key(path).alias("key"), slug(F.col("p_name")).alias("slug"), work_model(model).alias("work_model"), truthy(f["public safe"]).alias("approved"), f["size"].alias("size"))


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS negative, CASE WHEN c_custkey % 4 = 0 THEN 'familiarity' END AS most FROM customer),
h AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey % 6 AS rec, CASE o_orderkey % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'related' ELSE 'none' END AS support,
             CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS level FROM orders),
t AS (SELECT * FROM h WHERE pos <= 6),
a AS (SELECT k, min(pos) FILTER (rec = k % 6 AND k % 3 <> 0) AS first, count(*) FILTER (rec = 5 AND k % 6 <> 5 AND support = 'direct') AS bad, count(*) FILTER (support = 'direct') AS direct, max(level) AS level FROM t GROUP BY k),
r AS (SELECT c.k, negative, CASE WHEN negative OR first IS NOT NULL THEN 1.0 ELSE 0.0 END AS recall, coalesce(1.0 / first, 0.0) AS rr, NOT negative OR coalesce(direct, 0) = 0 AS safe, most IS NULL OR coalesce(level, 0) <= 1 AS modest, coalesce(bad, 0) AS bad
      FROM c LEFT JOIN a ON a.k = c.k)
SELECT k AS query_id, negative, CAST(recall AS DOUBLE) AS recall_at_k, CAST(rr AS DOUBLE) AS reciprocal_rank, safe AS safe_negative, modest AS proficiency_ok, bad AS forbidden_direct_hits, recall = 1 AND safe AND bad = 0 AND modest AS passed FROM r
""")
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases, every third a negative one, their orders as reranked hits: expected and forbidden records, levels and support."""
    from pyspark.sql.window import Window

    c, o, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey")
    stated = c.select(k.alias("query_id"), (k % 3 == 0).alias("negative"), F.when(k % 4 == 0, "familiarity").alias("max_proficiency"))
    labels = c.filter(k % 3 != 0).select(k.alias("query_id"), (k % 6).alias("record_id"), F.lit("expected").alias("kind")).union(c.filter(k % 6 != 5).select(k, F.lit(5).cast("bigint"), F.lit("forbidden")))
    n = F.col("o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    support = F.when(n % 5 == 0, "direct").when(n % 5 == 1, "related").otherwise("none")
    hits = o.select(F.col("o_custkey").alias("query_id"), n.alias("chunk_id"), F.row_number().over(order).alias("pos"), (n % 6).alias("record_id"), support.alias("support"), F.when(n % 7 == 0, "working").otherwise("familiarity").alias("proficiency"))
    return evals.cases(stated, labels, hits, 6)


@query(f"""
{workflow.COVERAGE_SQL.replace("cov AS (", "cov0 AS (").rstrip()},
x AS (SELECT h.*, d.source AS record_id, CASE WHEN chunk_id % 2 = 0 THEN 'skill' ELSE 'section' END AS chunk_type, CASE WHEN chunk_id % 2 = 0 THEN chunk_id % 4 // 2 + 1 ELSE 0 END AS lv,
             CASE chunk_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'related' ELSE 'none' END AS support, row_number() OVER (PARTITION BY vacancy_id, req_pos ORDER BY score DESC, chunk_id) AS pos FROM h JOIN documents d ON d.doc_id = h.chunk_id),
y AS (SELECT vacancy_id, req_pos, count(*) FILTER (support = 'direct') AS direct, count(*) FILTER (support = 'related') AS related, max(CASE WHEN support <> 'none' THEN lv END) AS best, count(DISTINCT CASE WHEN support <> 'none' THEN record_id END) AS records,
             arg_min(score, (support <> 'direct', pos)) FILTER (support <> 'none') AS top FROM x GROUP BY ALL),
z AS (SELECT r.vacancy_id, r.req_pos, CASE WHEN direct IS NULL THEN 'unsupported' WHEN direct = 0 AND related > 0 THEN 'weak' WHEN direct = 0 THEN 'unsupported' WHEN best >= 3 OR (best >= 2 AND records >= 2) THEN 'strong' WHEN best = 1 THEN 'weak'
      WHEN records >= 2 OR top >= 4 OR lower(requirement) IN {in_list(matching.GENERIC)} THEN 'partial' ELSE 'weak' END AS coverage FROM reqs r LEFT JOIN y USING (vacancy_id, req_pos))
SELECT vacancy_id, req_pos, coverage FROM z
""")
def coverage_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage where a reranker has judged the hits."""
    reqs, hits = workflow.hits_of_requirements(spark, sf_dir)
    n = F.col("chunk_id").cast("bigint") % 3
    judged = hits.withColumn("support", F.when(n == 0, "direct").when(n == 1, "related").otherwise("none"))
    return matching.coverage(reqs, judged).select("vacancy_id", F.col("req_pos").cast("bigint").alias("req_pos"), "coverage")


@query("""
WITH n AS (SELECT doc_id, doc_id % 7 = 0 AS fresh, doc_id % 5 = 0 AS edited, doc_id % 9 = 0 AS gone FROM documents)
SELECT doc_id AS chunk_id, CASE WHEN gone THEN 'removed' WHEN fresh OR edited THEN 'embedded' ELSE 'kept' END AS change FROM n WHERE NOT (gone AND fresh)
""")
def vectors_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of vectors when a seventh of the chunks is new, a fifth edited and a ninth gone."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), "text")
    old = F.when(F.col("chunk_id") % 5 == 0, "old").otherwise(F.col("content_hash"))
    previous = d.filter("chunk_id % 7 <> 0").select("chunk_id", old.alias("content_hash"), F.lit("m").alias("model"), F.lit(4).alias("dimensions"), F.array(*[F.lit(0.0)] * 4).alias("vector"))
    return dense.refresh_vectors(previous, d.filter("chunk_id % 9 <> 0"), dense.HashEmbedder(4), "m", 4)[1]


@query(f"""
WITH p AS ({retrieval.POSTINGS_SQL}), q AS ({retrieval.TERMS_SQL.format(n=50)}),
s AS (SELECT query_id, chunk_id, CAST(sum((1 + tf) * qtf) AS DOUBLE) AS score FROM p JOIN q USING (term) GROUP BY ALL),
lex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s), {retrieval.DENSE_SQL.replace('WHERE vec_id % 50 = 0', 'WHERE vec_id % 50 = 0 AND vec_id IN (SELECT item_id FROM benchmark)')},
{retrieval.RRF_SQL}
SELECT query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, rank AS pos, round(score, 9) AS score, retrieval_source FROM fused WHERE rank <= 6
""")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval as a whole: the sides meet by the number of a document and of a vector; no chunk is an anchor here and there are no relations."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("record_id"), F.lit("section").alias("chunk_type"), "text")
    items = retrieval.asked(spark, sf_dir)
    vectors = retrieval.vectors(spark, sf_dir)
    asked = retrieval.asked_vectors(spark, sf_dir).join(items.select("query_id"), "query_id", "left_semi")
    out = hybrid.retrieve(items, docs, "hybrid", 6, vectors, asked)
    return out.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("pos").cast("bigint").alias("pos"), F.round("score", 9).alias("score"), "retrieval_source")


@query("""
WITH c AS (SELECT 'c' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'role' ELSE 'other' END AS rec, split_part(p_name, ' ', 1) AS title, p_partkey, p_size % 5 <> 0 AS ok, p_size % 7 <> 0 AS pub FROM part),
u AS (SELECT id, 0 AS part, 0 AS a, row_number() OVER (ORDER BY rec, id) AS ord FROM c WHERE ok AND pub AND rec = 'profile'
      UNION ALL SELECT id, 1, 0, row_number() OVER (ORDER BY rec, id) FROM c WHERE ok AND pub AND rec = 'role' AND p_partkey % 10 = 0
      UNION ALL SELECT id, 2, 0, p_partkey FROM c WHERE ok AND p_partkey % 4 = 0),
f AS (SELECT id, min((part, ord)) AS m FROM u GROUP BY id)
SELECT id AS chunk_id, row_number() OVER (ORDER BY m) AS pos FROM f
""")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chunks: those of the profile are stable, some roles stick by a marker in their text, and every fourth was matched."""
    p = table(spark, sf_dir, "part")
    s = F.col("p_size")
    text = F.when(F.col("p_partkey") % 10 == 0, "with marker").otherwise("plain")
    all_ = p.select(
        F.concat(F.lit("c"), F.col("p_partkey")).alias("chunk_id"), F.when(s % 3 == 0, "profile").when(s % 3 == 1, "role").otherwise("other").alias("record_id"), F.lit("T").alias("title"), F.array(F.lit("T")).alias("heading_path"),
        text.alias("text"), (s % 5 != 0).alias("cv_eligible"), (s % 7 != 0).alias("public_safe"), "p_partkey",
    )
    stable = context.backbone(all_, (context.Backbone("profile", ("T",)),))
    sticky = context.editorial_anchors(all_, context.Anchors(markers=(("role", "marker"),)))
    matched = all_.filter("p_partkey % 4 = 0").select("chunk_id", F.col("p_partkey").cast("int").alias("pos"))
    return context.assemble(all_, stable, sticky, matched).select("chunk_id", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT 'p' || p_size AS chunk_id, max(p_partkey) AS last FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1 GROUP BY p_size")
def active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eligible evidence chunks with one id the last."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_size")).alias("chunk_id"), k.alias("pos"), (k % 3 != 0).alias("cv_eligible"), F.when(k % 4 == 1, "policy").otherwise("evidence").alias("retrieval_class"), k.alias("last"))
    return chunks.active(rows).select("chunk_id", "last")
