"""Queries on sections, chunks, matching, claims, gates, queues, budgets and telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import semantic_hash
from ..functions.text import numbers, plain_number
from ..operators import chunks, fitting, matching, queue, search, sections, telemetry, validators
from ..sources.state import work_dir
from .registry import registry
from .retrieval import POSTINGS_SQL
from .sqlkit import squeeze, table, tokens

QUERIES, SQL, query = registry()

HEADS = r"<h([1-6])[^>]*>(.*?)</h[1-6]>"


@query(r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS lv, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS ti FROM pages),
e AS (SELECT page_id, unnest(lv)::INT AS level, unnest(ti) AS title, generate_subscripts(lv, 1) - 1 AS pos FROM h)
SELECT page_id, pos, level, title, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS next_pos, title AS path FROM e
""")
def section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages; the corpus has one level a page, so a path is its own title (deeper ones are in the tests)."""
    p = table(spark, sf_dir, "pages")
    pattern = F.lit("(?s)" + HEADS)
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("level"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("title"))
    heads = p.select("page_id", F.posexplode(pairs).alias("pos", "x")).select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.level").cast("int").alias("level"), F.col("x.title").alias("title"))
    return sections.hierarchy(heads, "page_id").select("page_id", "pos", "level", "title", "next_pos", F.array_join("heading_path", " > ").alias("path"))


@query(r"""
WITH p AS (SELECT page_id, '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path, html FROM pages),
l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS href FROM p),
t AS (SELECT page_id, rtrim(regexp_extract(url, '^https?://[^/]+/[^/?#]*/?([0-9]+)', 1), '/') AS num FROM pages)
SELECT l.page_id AS source, count(*) AS n_links, count(t.page_id) AS n_resolved FROM l LEFT JOIN t ON t.num = regexp_replace(l.href, '^/+', '') AND t.num <> '' GROUP BY l.page_id
""")
def relation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = p.select(F.col("page_id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("href"))
    target = p.select(F.col("page_id").alias("target"), F.regexp_extract("url", r"^https?://[^/]+/[^/?#]*/?([0-9]+)", 1).alias("num")).filter("num <> ''")
    met = links.join(target, F.regexp_replace("href", "^/+", "") == F.col("num"), "left")
    return met.groupBy("source").agg(F.count("*").alias("n_links"), F.count("target").alias("n_resolved"))


@query("""
WITH l AS (SELECT l_orderkey, string_agg('part ' || l_partkey || ' x ' || CAST(l_quantity AS BIGINT), '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_orderkey, 'core' AS chunk_type, 'Status: ' || o_orderstatus || chr(10) || 'Priority: ' || o_orderpriority AS text FROM orders
      UNION ALL SELECT o_orderkey, 'requirements', 'Lines: ' || items FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey || '::' || chunk_type AS chunk_id, text, sha256(text) AS content_hash FROM c
""")
def chunk_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    item = F.concat(F.lit("part "), F.col("l_partkey"), F.lit(" x "), F.col("l_quantity").cast("bigint"))
    lines = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("t")))), lambda x: x["t"]).alias("items"))
    j = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    core = chunks.text_of(chunks.labelled("Status", F.col("o_orderstatus")), chunks.labelled("Priority", F.col("o_orderpriority")))
    kinds = F.array(F.struct(F.lit("core").alias("chunk_type"), core.alias("text")), F.struct(F.lit("requirements").alias("chunk_type"), chunks.text_of(chunks.listed("Lines", F.col("items"))).alias("text")))
    out = j.select("o_orderkey", F.inline(kinds)).filter("text <> ''")
    return out.select(F.concat_ws("::", F.col("o_orderkey").cast("string"), "chunk_type").alias("chunk_id"), "text", F.sha2("text", 256).alias("content_hash"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records: user turns by length are stack, requirements or responsibilities."""
    t = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("s", F.struct("turn", F.col("text").alias("t")))
    pick = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.col("s")))), lambda x: x["t"])
    n = F.length("text")
    return t.groupBy(F.col("conv_id").alias("vacancy_id")).agg(pick(n < 60).alias("tech_stack"), pick((n >= 60) & (n < 150)).alias("requirements"), pick(n >= 150).alias("responsibilities"), F.lit("role").alias("role_title"))


REQUIREMENTS_SQL = f"""
t AS (SELECT conv_id, turn, {squeeze('text')} AS r, CASE WHEN length(text) < 60 THEN 0 WHEN length(text) < 150 THEN 1 ELSE 2 END AS part FROM conversations WHERE role = 'user'),
f AS (SELECT * FROM t WHERE r <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(r) ORDER BY part, turn) = 1),
reqs AS (SELECT conv_id AS vacancy_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS req_pos, r AS requirement,
         CASE part WHEN 0 THEN 'technology_or_capability' WHEN 1 THEN 'requirement' ELSE 'responsibility' END AS requirement_type, CASE part WHEN 2 THEN 'important' ELSE 'critical' END AS importance FROM f)
"""


@query(f"WITH {REQUIREMENTS_SQL} SELECT * FROM reqs")
def requirement_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.requirements(_records(spark, sf_dir)).withColumn("req_pos", F.col("req_pos").cast("bigint"))


COVERAGE_SQL = f"""
WITH {REQUIREMENTS_SQL},
q AS (SELECT vacancy_id, req_pos, term, count(*) AS qtf FROM (SELECT vacancy_id, req_pos, unnest({tokens('requirement')}) AS term FROM reqs) GROUP BY ALL),
p AS ({POSTINGS_SQL}),
s AS (SELECT vacancy_id, req_pos, chunk_id, CAST(sum((1 + tf) * qtf) AS DOUBLE) AS score FROM p JOIN q USING (term) GROUP BY ALL),
h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vacancy_id, req_pos ORDER BY score DESC, chunk_id) <= 5),
e AS (SELECT h.*, d.source AS record_id, CASE WHEN chunk_id % 2 = 0 THEN 'skill' ELSE 'section' END AS chunk_type, CASE WHEN chunk_id % 2 = 0 THEN chunk_id % 4 // 2 + 1 ELSE 0 END AS lv FROM h JOIN documents d ON d.doc_id = h.chunk_id),
a AS (SELECT vacancy_id, req_pos, max(lv) AS best, count(DISTINCT record_id) AS records, max(score) AS top FROM e GROUP BY ALL),
cov AS (SELECT r.vacancy_id, r.req_pos, r.requirement, CASE WHEN best IS NULL THEN 'unsupported' WHEN best >= 3 OR (best >= 2 AND records >= 2) THEN 'strong' WHEN best = 1 THEN 'weak'
        WHEN records >= 2 OR top >= 4 THEN 'partial' ELSE 'weak' END AS coverage FROM reqs r LEFT JOIN a USING (vacancy_id, req_pos))
"""


def hits_of_requirements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All requirements, and the documents that answer each best."""
    reqs = matching.requirements(_records(spark, sf_dir)).withColumn("q", F.struct("vacancy_id", "req_pos"))
    docs = table(spark, sf_dir, "documents")
    best = search.lexical_top_k(docs.select(F.col("doc_id").alias("chunk_id"), "text"), reqs, 5, weighted=False, query_id="q", query_text="requirement")
    hits = best.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("record_id")), "chunk_id")
    even = F.col("chunk_id") % 2 == 0
    level = F.when(even, F.when(F.col("chunk_id") % 4 == 2, "working").otherwise("familiarity"))
    hits = hits.select(
        F.col("query_id.vacancy_id").alias("vacancy_id"), F.col("query_id.req_pos").alias("req_pos"), F.col("rank").alias("pos"), F.col("chunk_id").cast("string").alias("chunk_id"), "record_id",
        F.when(even, "skill").otherwise("section").alias("chunk_type"), level.alias("proficiency"), "score", F.col("record_id").alias("source_path"),
    )
    return reqs.drop("q"), hits


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.coverage(*hits_of_requirements(spark, sf_dir))


@query(f"{COVERAGE_SQL} SELECT * FROM cov")
def coverage_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("vacancy_id", F.col("req_pos").cast("bigint").alias("req_pos"), "requirement", "coverage")


@query(f"""{COVERAGE_SQL} SELECT vacancy_id, count(*) AS n_requirements, count(*) FILTER (coverage = 'strong') AS strong, count(*) FILTER (coverage = 'partial') AS partial, count(*) FILTER (coverage = 'weak') AS weak,
count(*) FILTER (coverage = 'unsupported') AS unsupported,
round_even(CAST(sum(CASE coverage WHEN 'strong' THEN 1.0 WHEN 'partial' THEN 0.65 WHEN 'weak' THEN 0.3 ELSE 0 END) AS DOUBLE) * 100 / greatest(count(*), 1), 1) AS coverage_score FROM cov GROUP BY vacancy_id""")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.summary(_matches(spark, sf_dir)).drop("evidence_chunk_ids", "evidence_record_ids")


@query(f"""{COVERAGE_SQL} SELECT vacancy_id, coalesce(string_agg(DISTINCT CAST(chunk_id AS VARCHAR), ',' ORDER BY CAST(chunk_id AS VARCHAR)), '') AS chunk_ids,
coalesce(string_agg(DISTINCT record_id, ',' ORDER BY record_id), '') AS record_ids FROM (SELECT DISTINCT vacancy_id FROM reqs) LEFT JOIN e USING (vacancy_id) GROUP BY vacancy_id""")
def match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence that answers any requirement of a posting, each once."""
    out = matching.summary(_matches(spark, sf_dir))
    return out.select("vacancy_id", F.array_join("evidence_chunk_ids", ",").alias("chunk_ids"), F.array_join("evidence_record_ids", ",").alias("record_ids"))


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || ',"p_type":' || CASE WHEN p_size % 3 = 0 THEN 'null' ELSE '"' || p_type || '"' END || '}') AS content_hash FROM part""")
def semantic_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of parts; a null type is written out."""
    kind = F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", semantic_hash("p_brand", "p_name", "p_size", kind).alias("content_hash"))


@query("""SELECT source, doc_id, pos, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, row_number() OVER w AS pos, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM documents
WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)) WHERE pos <= 40 AND used <= 70000""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = queue.budget_prefix(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")], "n_chars", 40, 70000)
    return out.select("source", "doc_id", F.col("pos").cast("bigint").alias("pos"), "used")


@query("""
WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS pos, sha256(o_orderkey || '|' || o_orderstatus) AS fp,
                  sha256(o_orderkey || '|' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'x' END) AS old,
                  CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'DEFERRED_CAP' WHEN 2 THEN 'FAILED_REVIEW_REQUIRED' END AS st, o_custkey % 10 <> 0 AS present, o_orderstatus <> 'P' AS ok FROM orders),
a AS (SELECT *, CASE WHEN NOT present THEN 'missing' WHEN coalesce(fp = old AND st IN ('PASS', 'COMPLETED_BELOW_TARGET', 'SKIPPED_NOT_ELIGIBLE', 'FAILED_REVIEW_REQUIRED'), false) THEN 'idempotent'
                     WHEN NOT ok THEN 'not_eligible' ELSE 'generate' END AS x FROM q)
SELECT o_orderkey, CASE WHEN x = 'generate' AND row_number() OVER (PARTITION BY x ORDER BY pos) > 5 THEN 'deferred' ELSE x END AS action FROM a
""")
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work: priority, then date; five are taken."""
    o = table(spark, sf_dir, "orders")
    key = lambda tail: F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), tail), 256)
    status = F.element_at(F.array(F.lit("PASS"), F.lit("DEFERRED_CAP"), F.lit("FAILED_REVIEW_REQUIRED"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    q = o.select(
        "o_orderkey", F.struct("o_orderpriority", "o_orderdate", "o_orderkey").alias("pos"), (F.col("o_custkey") % 10 != 0).alias("exists"), key(F.col("o_orderstatus")).alias("fingerprint"),
        key(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("x")).alias("previous_fingerprint"), status.alias("previous_status"), (F.col("o_orderstatus") != "P").alias("eligible"),
    )
    return queue.plan_batch(q, 5, key="o_orderkey").select("o_orderkey", "action")


@query("SELECT o_custkey, count(*) AS n, sha256(string_agg(o_orderkey || '|' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS fingerprint FROM orders GROUP BY o_custkey")
def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.group_fingerprint(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""SELECT l_orderkey AS doc_id, count(*) AS n_unknown, array_to_string(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), ',') AS unknown FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_orderkey""")
def claims_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size > 10")
    bad = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey"), "p_partkey", "left_anti")
    return bad.groupBy("doc_id").agg(F.count("*").alias("n_unknown"), F.array_join(F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))), ",").alias("unknown"))


@query("""
WITH e AS (SELECT p_partkey, p_name || ' size ' || p_size AS text, CASE WHEN p_partkey % 2 = 0 THEN 'achievement_metric' ELSE 'section' END AS kind, p_size > 5 AS ok FROM part),
c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'grew ' || l_linenumber || '% in ' || CAST(l_quantity AS BIGINT) AS text FROM lineitem WHERE l_returnflag = 'R'),
j AS (SELECT c.*, e.kind, e.ok, e.text AS ev, list_sort(list_distinct(list_filter(regexp_extract_all(c.text, '[0-9]+'), lambda n: NOT list_contains(regexp_extract_all(e.text, '[0-9]+'), n)))) AS extra
      FROM c JOIN e ON e.p_partkey = c.l_partkey)
SELECT code, count(*) AS n, count(DISTINCT detail) AS n_details FROM (
  SELECT 'ineligible_evidence' AS code, CAST(l_partkey AS VARCHAR) AS detail FROM j WHERE NOT ok
  UNION ALL SELECT 'evidence_outside_match', CAST(l_partkey AS VARCHAR) FROM j WHERE l_partkey % 5 = 0
  UNION ALL SELECT 'quantified_claim_without_metric', '' FROM j WHERE kind = 'section'
  UNION ALL SELECT 'metric_value_not_in_evidence', array_to_string(extra, ',') FROM j WHERE kind <> 'section' AND len(extra) > 0) GROUP BY code
""")
def claim_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as claims that cite their part: issues by code."""
    l, p = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), table(spark, sf_dir, "part")
    part = F.col("l_partkey").cast("string")
    text = F.concat(F.lit("grew "), F.col("l_linenumber"), F.lit("% in "), F.col("l_quantity").cast("bigint"))
    where = F.concat_ws(".", F.lit("experience"), F.col("l_linenumber").cast("string"), part, F.col("l_suppkey").cast("string"), F.monotonically_increasing_id().cast("string"))
    claims = l.select(F.col("l_orderkey").alias("doc_id"), where.alias("location"), text.alias("text"), F.array(part).alias("refs"))
    evidence = p.select(
        F.col("p_partkey").cast("string").alias("chunk_id"), F.concat("p_name", F.lit(" size "), F.col("p_size")).alias("text"), F.when(F.col("p_partkey") % 2 == 0, "achievement_metric").otherwise("section").alias("chunk_type"),
        F.lit(None).cast("string").alias("proficiency"), F.array().cast("array<string>").alias("constraints"), (F.col("p_size") > 5).alias("cv_eligible"),
    )
    allowed = l.filter("l_partkey % 5 <> 0").select(F.col("l_orderkey").alias("doc_id"), part.alias("chunk_id"))
    return validators.claim_issues(claims, evidence, allowed).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("detail").alias("n_details"))


@query(r"""
WITH t AS (SELECT conv_id, role, list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), lambda x: replace(x, ',', '.')) AS ns FROM conversations),
g AS (SELECT conv_id, list_distinct(flatten(list(ns) FILTER (role = 'assistant'))) AS a, list_distinct(flatten(list(ns) FILTER (role = 'user'))) AS u FROM t GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT coalesce(list_contains(u, x), false))), ',') AS unsupported FROM g
""")
def numbers_not_in_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("ns", numbers(F.col("text")))
    said = lambda role: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == role, F.col("ns")))))
    out = t.groupBy("conv_id").agg(said("assistant").alias("a"), said("user").alias("u"))
    return out.select("conv_id", F.array_join(F.array_sort(F.array_except("a", "u")), ",").alias("unsupported"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN toxic = 1 THEN 'headhunter_decision_not_pass' END, CASE WHEN 80 + doc_id % 20 < 92 THEN 'overall_score_below_92' END, CASE WHEN 85 + doc_id % 15 < 90 THEN 'vacancy_alignment_below_90' END,
  CASE WHEN 90 + doc_id % 10 < 95 THEN 'evidence_strength_below_95' END, CASE WHEN 92 + doc_id % 8 < 95 THEN 'language_quality_below_95' END, CASE WHEN doc_id % 6 = 0 THEN 'blocking_issues_present' END,
  CASE WHEN quality = 0 THEN 'factual_validation_failed' END], lambda x: x IS NOT NULL), ',') AS reasons,
  toxic = 0 AND 80 + doc_id % 20 >= 92 AND 85 + doc_id % 15 >= 90 AND 90 + doc_id % 10 >= 95 AND 92 + doc_id % 8 >= 95 AND doc_id % 6 <> 0 AND quality = 1 AS passed FROM labels
""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    reviews = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "REVISE").otherwise("PASS").alias("decision"), (80 + d % 20).alias("overall_score"), (85 + d % 15).alias("vacancy_alignment"), (90 + d % 10).alias("evidence_strength"),
        (92 + d % 8).alias("language_quality"), F.when(d % 6 == 0, 1).otherwise(0).alias("n_blocking"), F.when(F.col("quality") == 0, "FAIL").otherwise("PASS").alias("factual"), F.lit("PASS").alias("language"), F.lit("PASS").alias("structure"),
    )
    return validators.quality_gate(reviews).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("""
WITH c AS (SELECT user_id, event_type AS model, CAST(floor(value * 100) AS BIGINT) AS p FROM events),
r AS (SELECT * FROM (VALUES ('view', 1.0::DOUBLE, 0.1::DOUBLE, 6.0::DOUBLE), ('click', 2.5, 0.25, 15.0), ('purchase', 5.0, 0.5, 30.0), ('signup', 5.0, 0.5, 30.0)) t(model, i, c, o)),
k AS (SELECT c.*, round(((p - p // 4) * i + (p // 4) * r.c + (p // 2 + p // 10) * o) / 1e6, 8) AS usd FROM c LEFT JOIN r USING (model))
SELECT user_id, count(*) AS call_count, CAST(sum(p) AS BIGINT) AS prompt_tokens, CASE WHEN count(*) = count(usd) THEN round(sum(usd), 4) END AS estimated_cost_usd, round(coalesce(sum(usd), 0), 4) AS known_estimated_cost_usd,
       array_to_string(list_sort(list_distinct(coalesce(list(model) FILTER (usd IS NULL), []))), ',') AS unpriced_models FROM k GROUP BY user_id
""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls; errors are a model without a price."""
    n = F.floor(F.col("value") * 100)
    part = lambda k: F.floor(n / k)
    calls = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("model"), n.alias("prompt_tokens"), part(4).alias("cached_input_tokens"), part(2).alias("candidate_tokens"), part(10).alias("reasoning_tokens"), n.alias("total_tokens")
    )
    prices = spark.createDataFrame([("view", 1.0, 0.1, 6.0), ("click", 2.5, 0.25, 15.0), ("purchase", 5.0, 0.5, 30.0), ("signup", 5.0, 0.5, 30.0)], "model string, input double, cached_input double, output double")
    out = telemetry.usage(telemetry.cost(calls, prices), "user_id")
    return out.select("user_id", "call_count", "prompt_tokens", F.round("estimated_cost_usd", 4).alias("estimated_cost_usd"), F.round("known_estimated_cost_usd", 4).alias("known_estimated_cost_usd"), F.array_join("unpriced_models", ",").alias("unpriced_models"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END DESC, c_name) AS pos FROM customer""")
def feed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment as a feed: balance, a negative one counting as none, then name."""
    score = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(0.0))
    order = Window.partitionBy("c_mktsegment").orderBy(score.desc(), F.coalesce("c_name", F.lit("")))
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(order).cast("bigint").alias("pos"))


@query("""SELECT doc_id, 1 + CAST(sum(ceil(greatest(length(trim(l)), 1) / 96.0::DOUBLE)) AS BIGINT) AS line_units FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", F.lit("body").alias("section"), F.explode(F.split("text", "\n")).alias("text"), F.lit(False).alias("bullet"))
    return fitting.line_units(items, "doc_id")


@query("""
WITH RECURSIVE i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, CAST(ceil(greatest(length(trim(text)), 1) / 96.0::DOUBLE) AS BIGINT) AS n FROM conversations),
r AS (SELECT conv_id, pos, 1 AS page, 6 + n AS used FROM i WHERE pos = 1
      UNION ALL SELECT i.conv_id, i.pos, CASE WHEN r.used + i.n <= 20 THEN 1 ELSE 2 END, r.used + CASE WHEN r.used + i.n <= 20 THEN i.n ELSE 0 END FROM r JOIN i ON i.conv_id = r.conv_id AND i.pos = r.pos + 1)
SELECT conv_id, pos, page FROM r
""")
def page_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation packed to a first page of 20 lines, 6 of which are taken."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    items = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(order).cast("bigint").alias("pos"), fitting.text_lines(F.col("text"), 96).alias("n"))
    return fitting.pack_first_page(items, "conv_id", "pos", "n", 6, 20)


@query("""
WITH RECURSIVE i AS (SELECT conv_id, turn, role, ['summary', 'experience', 'projects', 'skills', 'certifications'][turn % 5 + 1] AS section, turn % 3 = 0 AS sticky, text, CAST(ceil(greatest(length(trim(text)), 1) / 48.0::DOUBLE) AS BIGINT) AS n FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY list_position(['certifications', 'skills', 'projects', 'experience', 'summary'], section), turn DESC, text DESC) AS seq, count(*) OVER (PARTITION BY conv_id, section) AS size,
             sum(n) OVER (PARTITION BY conv_id) AS total FROM i),
t AS (SELECT conv_id, max(total) + count(DISTINCT section) AS used FROM o GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS seq, CAST(used AS BIGINT) AS used, '' AS section, CAST(0 AS BIGINT) AS remains, false AS omitted FROM t
  UNION ALL SELECT conv_id, seq, CAST(used - CASE WHEN go THEN n + (remains = 1)::INT ELSE 0 END AS BIGINT), section, remains - go::INT, go FROM (
    SELECT *, NOT sticky AND section <> 'summary' AND used > 12 AND remains > CASE WHEN section = 'experience' THEN 1 ELSE 0 END AS go FROM (
      SELECT o.conv_id, o.seq, o.n, o.sticky, w.used, o.section, CASE WHEN w.section = o.section THEN w.remains ELSE o.size END AS remains FROM w JOIN o ON o.conv_id = w.conv_id AND o.seq = w.seq + 1)))
SELECT o.conv_id, o.turn, o.section, omitted, CASE WHEN omitted THEN o.section || ' cut to fit the budget' END AS reason FROM w JOIN o USING (conv_id, seq)
""")
def tail_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as items of five sections, cut to twelve lines; every third turn is sticky and one of experience stays."""
    names = F.array(*[F.lit(x) for x in ("summary", "experience", "projects", "skills", "certifications")])
    items = table(spark, sf_dir, "conversations").select("conv_id", F.element_at(names, (F.col("turn") % 5 + 1).cast("int")).alias("section"), F.col("turn").alias("pos"), "text", (F.col("turn") % 3 == 0).alias("sticky"))
    out = fitting.prune(items, "conv_id", 12, {"experience": 1}, 48)
    return out.select("conv_id", F.col("pos").alias("turn"), "section", "omitted", "reason")


@query("""
WITH b AS (SELECT p_partkey AS brand_id, printf('#%06x', (p_partkey * 7919) % 16777216) AS c FROM part),
l AS (SELECT brand_id, c, list_transform([2, 4, 6], lambda i: ('0x' || substr(c, i, 2))::INT / 255.0::DOUBLE) AS v FROM b),
y AS (SELECT brand_id, c, list_transform(v, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS w FROM l),
z AS (SELECT brand_id, c, 0.2126 * w[1] + 0.7152 * w[2] + 0.0722 * w[3] AS lum FROM y),
k AS (SELECT brand_id, round_even(1.05 / (lum + 0.05), 2) AS ratio FROM z)
SELECT brand_id, ratio, use, ratio >= t AS passed FROM k, (VALUES ('light text on primary areas', 4.5::DOUBLE), ('large/accent graphics on surface', 3.0)) u(use, t)
""")
def contrast_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up colour for each part, on white."""
    c = F.format_string("#%06x", F.col("p_partkey") * 7919 % 16777216)
    white = F.lit("#ffffff")
    tokens_ = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("brand_id"), c.alias("primary"), c.alias("secondary"), c.alias("accent"), white.alias("surface"), F.lit("#000000").alias("text"), F.lit("#333333").alias("muted"))
    out = fitting.contrast_checks(tokens_)
    return out.filter(F.col("use").isin("light text on primary areas", "large/accent graphics on surface")).select("brand_id", "ratio", "use", "passed")


@query("""SELECT p_partkey, regexp_replace(regexp_replace(printf('%.6f', round(p_retailprice, 2)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS price FROM part""")
def plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, of at most six significant digits, without closing zeros."""
    return table(spark, sf_dir, "part").select("p_partkey", plain_number(F.round("p_retailprice", 2)).alias("price"))


@query("SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def stream_incremental_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a file stream into a table, twice with one checkpoint: the second run must add nothing."""
    work = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parque[t]")
        run = stream.select("lang", "n_chars").writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start(f"{work}/out")
        run.awaitTermination()
    out = spark.read.schema("lang string, n_chars bigint").parquet(f"{work}/out")
    return out.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
