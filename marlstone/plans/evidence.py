"""Queries on governed Markdown: documents and nations become files with front matter, and the shipped operators read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, context, sections
from ..sources import markdown
from .registry import registry
from .sqlkit import table

QUERIES, SQL, query = registry()

ROUTERS = ("notes/7/doc-7.md",)
STATUS = ("canonical", "validated_public", "draft", "deprecated", "unclear")
TYPES = ("role", "project", "education", "note")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_path, text)``: a file for each document, one of metrics and one of skills (nations, which are few)."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    text = lambda x: F.coalesce(F.col(x), F.lit(""))
    one_of = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    name = F.concat(F.lit("doc-"), k)
    front = F.concat(
        F.lit("schema_version: 1\nrecord_id: "), F.when(k % 97 == 0, F.concat(F.lit("Doc_"), k)).otherwise(name), F.lit("\nrecord_type: "), one_of(TYPES, k), F.lit("\nstatus: "), one_of(STATUS, k),
        F.lit("\nconfidence: high\nvisibility: "), F.when(k % 11 == 0, "private").otherwise("public"), F.lit("\npublic_safe: "), (k % 3 != 0).cast("string"),
        F.lit("\nlast_updated: "), F.when(k % 13 == 0, "soon").otherwise(F.concat(F.lit("2024-03-0"), k % 9 + 1)), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("\nsource_refs:\n  - s"), k % 7)),
    )
    body = F.concat(
        F.lit("# "), text("source"), F.lit("\n"), text("text"), F.lit("\n\n## Usage boundaries\nNever name "), text("lang"), F.lit(".\n\n### CERT-"), k, F.lit(" Course\n- **Status:** "), F.when(k % 3 == 1, "Expired").otherwise("Active"),
        F.lit("\n- **CV usage:** "), F.when(k % 4 == 1, "blocked").otherwise("approved"), F.lit("\n\n## Results\nSee [next](../"), (k + 1) % 100, F.lit("/doc-"), k + 1, F.lit(".md) and ACH-"), k % 30, F.lit(".\n"),
    )
    path = F.concat(F.when(k % 20 == 0, "_meta/").otherwise(F.concat(F.lit("notes/"), k % 100, F.lit("/"))), name, F.lit(".md"))
    docs = d.select(path.alias("source_path"), F.concat(F.lit("---\n"), front, F.lit("\n---\n"), body).alias("text"))
    n = F.col("n_nationkey")
    metric = F.concat(
        F.lit("\n## ACH-"), n, F.lit(" — "), F.col("n_name"), F.lit("\n- **Status:** "), F.when(n % 2 == 0, "validated_public").otherwise("draft"), F.lit("\n- **Public safe:** true\n- **CV usage:** "), F.when(n % 5 == 0, "pending").otherwise("approved"),
        F.lit("\n- **Usage constraint:** up to "), n, F.lit("\n"),
    )
    skill = F.concat(F.lit("\n## "), F.col("n_name"), F.lit("\n- **Level:** "), one_of(("Core", "working", "familiarity", "expert"), n), F.lit("\n- **Usage note:** within "), F.col("n_regionkey"), F.lit("\n"))
    head = lambda rid, kind: F.lit(f"---\nrecord_id: {rid}\nrecord_type: {kind}\nstatus: canonical\nconfidence: high\nvisibility: public\npublic_safe: true\nlast_updated: 2024-03-01\nsource_refs:\n  - s1\n---\n# All\n")
    joined = lambda t: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, t.alias("t")))), lambda x: x["t"]), "")
    both = table(spark, sf_dir, "nation").agg(joined(metric).alias("m"), joined(skill).alias("s"))
    registers = both.select(F.inline(F.array(
        F.struct(F.lit("metrics.md").alias("source_path"), F.concat(head("achievement-metrics", "achievement_registry"), "m").alias("text")),
        F.struct(F.lit("skills.md").alias("source_path"), F.concat(head("skills", "skills"), "s").alias("text")),
    )))
    return docs.unionByName(registers)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.normalize(_files(spark, sf_dir), routers=ROUTERS)


SPACES = r"[\s\x0b\pZ\x1c-\x1f\x{85}]"
BREAKS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section')"


RECORDS_SQL = rf"""
WITH f AS (
  SELECT doc_id AS k, CASE WHEN doc_id % 97 = 0 THEN 'Doc_' ELSE 'doc-' END || doc_id AS rid, (CASE WHEN doc_id % 20 = 0 THEN '_meta/' ELSE 'notes/' || doc_id % 100 || '/' END) || 'doc-' || doc_id || '.md' AS path,
    CASE WHEN doc_id % 20 = 0 THEN 'policy' WHEN doc_id = 7 THEN 'router' ELSE 'evidence' END AS cls, ['role', 'project', 'education', 'note'][doc_id % 4 + 1] AS typ, ['canonical', 'validated_public', 'draft', 'deprecated', 'unclear'][doc_id % 5 + 1] AS st,
    doc_id % 3 <> 0 AS safe, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END AS n_refs, CASE WHEN doc_id % 6 = 0 THEN 11 ELSE 13 END AS first_line,
    '# ' || coalesce(source, '') || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '## Usage boundaries' || chr(10) || 'Never name ' || coalesce(lang, '') || '.' || chr(10) || chr(10) || '### CERT-' || doc_id || ' Course' || chr(10)
    || '- **Status:** ' || CASE WHEN doc_id % 3 = 1 THEN 'Expired' ELSE 'Active' END || chr(10) || '- **CV usage:** ' || CASE WHEN doc_id % 4 = 1 THEN 'blocked' ELSE 'approved' END || chr(10) || chr(10)
    || '## Results' || chr(10) || 'See [next](../' || (doc_id + 1) % 100 || '/doc-' || doc_id + 1 || '.md) and ACH-' || doc_id % 30 || '.' || chr(10) AS body
  FROM documents
  UNION ALL SELECT NULL, 'achievement-metrics', 'metrics.md', 'evidence', 'achievement_registry', 'canonical', true, 1, 12, '# All' || chr(10) || string_agg(chr(10) || '## ACH-' || n_nationkey || ' — ' || n_name || chr(10) || '- **Status:** '
    || CASE WHEN n_nationkey % 2 = 0 THEN 'validated_public' ELSE 'draft' END || chr(10) || '- **Public safe:** true' || chr(10) || '- **CV usage:** ' || CASE WHEN n_nationkey % 5 = 0 THEN 'pending' ELSE 'approved' END || chr(10)
    || '- **Usage constraint:** up to ' || n_nationkey || chr(10), '' ORDER BY n_nationkey) FROM nation
  UNION ALL SELECT NULL, 'skills', 'skills.md', 'evidence', 'skills', 'canonical', true, 1, 12, '# All' || chr(10) || string_agg(chr(10) || '## ' || n_name || chr(10) || '- **Level:** ' || ['Core', 'working', 'familiarity', 'expert'][n_nationkey % 4 + 1]
    || chr(10) || '- **Usage note:** within ' || n_regionkey || chr(10), '' ORDER BY n_nationkey) FROM nation),
r AS (SELECT *, safe AND st NOT IN ('draft', 'deprecated', 'needs_reconciliation') AS ok, list_sort(list_distinct(regexp_extract_all(body, '\bACH-[A-Z0-9-]+\b'))) AS refs FROM f)
"""


@query(f"""{RECORDS_SQL} SELECT rid AS record_id, typ AS record_type, st AS status, cls AS retrieval_class, path AS source_path, n_refs, array_to_string(refs, ',') AS metric_refs, safe AS public_safe, ok AS eligible,
ok AND cls = 'evidence' AS embedding_candidate, first_line AS body_start_line, sha256(body) AS body_sha256 FROM r""")
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter parsed, records classed and made eligible."""
    return _records(spark, sf_dir).select(
        "record_id", "record_type", "status", "retrieval_class", "source_path", F.size("source_refs").alias("n_refs"), F.array_join("metric_refs", ",").alias("metric_refs"), "public_safe", "eligible", "embedding_candidate",
        "body_start_line", F.sha2("body", 256).alias("body_sha256"),
    )


@query(f"""{RECORDS_SQL} SELECT cls AS retrieval_class, typ AS record_type, count(*) AS n, count(*) FILTER (ok AND cls = 'evidence') AS n_candidates FROM r GROUP BY GROUPING SETS ((cls), (typ), ())""")
def evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.manifest(_records(spark, sf_dir))


SECTIONS_SQL = rf"""{RECORDS_SQL},
s AS (SELECT rid, regexp_split_to_array(regexp_replace(body, '({BREAKS})$', ''), '{BREAKS}') AS ls FROM r),
l AS (SELECT rid, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM s),
h AS (SELECT rid, n, pos, length(regexp_extract(line, '^(#+)', 1)) AS level, {_strip(r"regexp_extract(line, '^(#{1,6})\s+(.+?)\s*$', 2)")} AS title, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos), n) AS stop
      FROM l WHERE regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*$')),
a AS (SELECT x.rid, x.pos, list(y.title ORDER BY y.level) AS names FROM h x JOIN h y ON y.rid = x.rid AND y.pos <= x.pos
      WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.rid = x.rid AND b.pos > y.pos AND b.pos <= x.pos AND b.level <= y.level) GROUP BY ALL),
c AS (SELECT h.rid, h.pos, {_strip("coalesce(string_agg(line, chr(10) ORDER BY l.pos), '')")} AS content FROM h LEFT JOIN l ON l.rid = h.rid AND l.pos > h.pos AND l.pos < h.stop GROUP BY ALL),
e AS (SELECT h.*, names, content, h.rid || '::' || array_to_string(list_transform(names, lambda t: {_slug('t')}), '::') AS sid,
        CASE WHEN upper(title) LIKE 'ACH-%' THEN 'metric' WHEN upper(title) LIKE 'CONFLICT-%' THEN 'conflict' WHEN regexp_matches(upper(title), '^Q-[A-Z0-9-]+\b') THEN 'open_question' WHEN upper(title) LIKE 'CERT-%' THEN 'credential'
             WHEN regexp_matches(lower(title), 'contribution|ownership') THEN 'ownership' WHEN regexp_matches(lower(title), 'boundar|usage constraint|usage rule') THEN 'boundary' WHEN lower(title) LIKE '%summary%' THEN 'summary'
             WHEN regexp_matches(lower(title), 'technolog|technical') THEN 'technology' WHEN lower(title) LIKE '%skill%' THEN 'skill_group' WHEN regexp_matches(lower(title), 'outcome|impact|result') THEN 'outcome' ELSE 'section' END AS kind
      FROM h JOIN a USING (rid, pos) JOIN c USING (rid, pos))
"""


@query(f"""{SECTIONS_SQL} SELECT rid AS record_id, CAST(pos AS INT) AS pos, sid AS section_id, CAST(level AS INT) AS level, title, array_to_string(names, ' > ') AS path, kind AS semantic_type,
CAST(first_line + pos AS INT) AS start_line, CAST(first_line + greatest(stop - 1, pos) AS INT) AS end_line, sha256(content) AS content_sha256 FROM e JOIN r USING (rid)""")
def evidence_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of three levels with their paths, kinds and extents."""
    out = sections.sections(_records(spark, sf_dir))
    return out.select("record_id", "pos", "section_id", "level", "title", F.array_join("heading_path", " > ").alias("path"), "semantic_type", "start_line", "end_line", F.sha2("content", 256).alias("content_sha256"))


_FIELD = lambda k: rf"regexp_extract(content, '(?m)^- \*\*{k}:\*\* (.*)$', 1)"
CHUNKS_SQL = rf"""{SECTIONS_SQL},
b AS (SELECT rid, list(content ORDER BY pos) AS bounds FROM e WHERE kind = 'boundary' AND content <> '' GROUP BY rid),
g AS (SELECT e.*, r.cls, r.typ, r.ok, r.refs, coalesce(bounds, []) AS bounds, {_FIELD('Status')} AS f_status, {_FIELD('CV usage')} AS f_use, {_FIELD('Level')} AS f_level,
        CASE WHEN e.rid = 'achievement-metrics' THEN 'm' WHEN e.rid = 'skills' THEN 's' WHEN kind = 'credential' THEN 'c' ELSE 'g' END AS w FROM e JOIN r USING (rid) LEFT JOIN b USING (rid) WHERE cls <> 'router'),
k AS (SELECT * FROM g WHERE CASE w WHEN 'm' THEN kind = 'metric' WHEN 's' THEN f_level <> '' ELSE content <> '' END)
SELECT CASE w WHEN 'm' THEN rid || '::' || regexp_extract(title, '^(\S+)', 1) WHEN 'g' THEN sid ELSE rid || '::' || {_slug('title')} END AS chunk_id,
  CASE WHEN w = 'm' THEN 'achievement_metric' WHEN w = 's' THEN 'skill' WHEN w = 'c' THEN 'credential' WHEN cls = 'policy' THEN 'policy_' || kind WHEN kind = 'section' AND typ IN ('project', 'role') THEN typ || '_detail' ELSE kind END AS chunk_type,
  CASE w WHEN 'm' THEN ok AND f_status = 'validated_public' AND f_use = 'approved' WHEN 's' THEN ok WHEN 'c' THEN ok AND f_status <> 'Expired' AND f_use <> 'blocked' ELSE ok AND cls = 'evidence' END AS cv_eligible,
  sha256({_strip("title || chr(10) || content")}) AS text_sha256,
  CASE w WHEN 'm' THEN {_FIELD('Usage constraint')} WHEN 's' THEN {_FIELD('Usage note')} WHEN 'c' THEN '' ELSE array_to_string(bounds, '|') END AS limits,
  CASE w WHEN 'm' THEN regexp_extract(title, '^(\S+)', 1) WHEN 'g' THEN array_to_string(refs, ',') ELSE '' END AS metric_refs, CASE WHEN w = 's' THEN lower(f_level) END AS proficiency FROM k
"""


@query(CHUNKS_SQL)
def evidence_chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of sections, metrics, skills and credentials with what limits them."""
    r = _records(spark, sf_dir)
    out = chunks.record_chunks(r, sections.sections(r))
    return out.select("chunk_id", "chunk_type", "cv_eligible", F.sha2("text", 256).alias("text_sha256"), F.array_join("constraints", "|").alias("limits"), F.array_join("metric_refs", ",").alias("metric_refs"), "proficiency")


@query(f"""{RECORDS_SQL} SELECT rid AS source, 'references_metric' AS relation, unnest(refs) AS target FROM r
UNION ALL SELECT x.rid, 'links_to', y.rid FROM r x JOIN r y ON y.k = x.k + 1 WHERE x.k % 20 <> 0 AND y.k % 20 <> 0""")
def evidence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and files that records name; links from or to folders that aren't where the link says lead nowhere."""
    return sections.relations(_records(spark, sf_dir))


@query(f"""{RECORDS_SQL},
i AS (SELECT path, 'error' AS severity, 'invalid_record_type' AS code, typ AS detail FROM r WHERE typ = 'note' UNION ALL SELECT path, 'error', 'invalid_status', st FROM r WHERE st = 'unclear'
UNION ALL SELECT path, 'error', 'not_public', '' FROM r WHERE NOT safe OR k % 11 = 0 UNION ALL SELECT path, 'error', 'invalid_last_updated', 'soon' FROM r WHERE k % 13 = 0
UNION ALL SELECT path, 'error', 'invalid_record_id', rid FROM r WHERE rid LIKE 'Doc%' UNION ALL SELECT path, 'warning', 'no_source_refs', '' FROM r WHERE n_refs = 0
UNION ALL SELECT path, 'warning', 'incomplete', '' FROM r WHERE st = 'draft' OR contains(body, 'To be populated') UNION ALL SELECT path, 'error', 'invalid_skill_level', (SELECT string_agg('expert', ',') FROM nation WHERE n_nationkey % 4 = 3) FROM r WHERE rid = 'skills'
UNION ALL SELECT path, 'error', 'unknown_metric', m FROM (SELECT path, unnest(refs) AS m FROM r) WHERE m NOT IN (SELECT 'ACH-' || n_nationkey FROM nation)
UNION ALL SELECT path, 'error', 'broken_link', '1' FROM r x WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r y WHERE y.k = x.k + 1 AND x.k % 20 <> 0 AND y.k % 20 <> 0))
SELECT path AS source_path, severity, code, detail FROM i""")
def governance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies, dates, ids, sources, metrics, skill levels and links of all files."""
    r = _records(spark, sf_dir)
    return markdown.governance_issues(r, sections.relations(r))


RULES = context.Editorial(identities=("lead engineer",), order=("beta", "alpha"), progression=("beta",), wanted_skill=("genai",), wanted_certifications={"c": ("cert",)})


@query("""
WITH d AS (SELECT c_custkey AS k, c_custkey % 4 AS m, c_custkey % 7 AS n FROM customer)
SELECT CAST(k AS VARCHAR) AS doc_id, code, location FROM (
  SELECT k, 'identity_outside_canonical_family' AS code, 'headline' AS location FROM d WHERE k % 3 <> 0 UNION ALL SELECT k, 'beta_missing', 'experience' FROM d WHERE m = 3 UNION ALL SELECT k, 'alpha_missing', 'experience' FROM d WHERE m >= 2
  UNION ALL SELECT k, 'alpha_order', 'experience' FROM d WHERE m = 1 UNION ALL SELECT k, 'beta_progression_missing', 'experience' FROM d WHERE m < 3 AND k % 5 = 0 UNION ALL SELECT k, 'too_many_projects', 'projects' FROM d WHERE m = 3
  UNION ALL SELECT k, 'too_many_certifications', 'certifications' FROM d WHERE n = 6 UNION ALL SELECT k, 'skills_missing', 'skills' FROM d WHERE k % 2 = 1 UNION ALL SELECT k, 'wanted_skill_missing', 'skills' FROM d WHERE k % 2 = 1
  UNION ALL SELECT k, 'certifications_missing', 'certifications' FROM d WHERE n = 0 UNION ALL SELECT k, 'mandatory_certification_missing_c', 'certifications' FROM d WHERE n = 0
  UNION ALL SELECT k, 'empty_employer_facing_field', 'summary' FROM d WHERE k % 10 = 0 UNION ALL SELECT k, 'diagnostic_language_exposed', 'summary' FROM d WHERE k % 10 <> 0 AND k % 9 = 0)
""")
def editorial_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as written documents with entries, projects, skills and certificates that keep or break the rules."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    line = lambda t: F.struct(t.alias("text"), F.array(F.lit("s1")).alias("evidence_refs"))
    none = F.array().cast(f"array<{context.LINE}>")
    entry = lambda org, title: F.struct(F.lit(org).alias("organization"), title.alias("title"), F.lit("2020").alias("period"), F.array(F.lit("s1")).alias("evidence_refs"), F.array(line(F.lit("did it"))).alias("bullets"))
    beta, alpha = entry("Beta Bank", F.when(k % 5 == 0, "Clerk").otherwise("Senior Analyst")), entry("Alpha", F.lit("Analyst"))
    entries = F.when(k % 4 == 0, F.array(beta, alpha)).when(k % 4 == 1, F.array(alpha, beta)).when(k % 4 == 2, F.array(beta)).otherwise(F.slice(F.array(beta), 1, 0))
    project = lambda i: F.struct(F.concat(F.lit("Project "), F.lit(i)).alias("name"), F.array(F.lit("s1")).alias("evidence_refs"), none.alias("bullets"))
    docs = c.select(
        k.cast("string").alias("doc_id"), F.lit("en").alias("language"), F.when(k % 3 == 0, "Lead  Engineer").otherwise("Clerk").alias("target_role"), line(F.col("c_name")).alias("headline"),
        line(F.when(k % 10 == 0, "").when(k % 9 == 0, "Evidence NOT available").otherwise(F.col("c_mktsegment"))).alias("summary"), entries.alias("experience"),
        F.slice(F.array(*[project(i) for i in range(3)]), 1, (k % 4).cast("int")).alias("projects"), F.slice(F.array(line(F.lit("GenAI tools"))), 1, (1 - k % 2).cast("int")).alias("skills"), F.array(line(F.col("c_mktsegment"))).alias("education"),
        F.slice(F.array(*[line(F.lit(f"Cert {i}")) for i in range(6)]), 1, (k % 7).cast("int")).alias("certifications"),
    )
    return context.editorial_issues(docs, RULES)
