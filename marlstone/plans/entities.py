"""Queries on identity, merging, snapshots, quarantine and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.hashing import stable_identity
from ..operators import diff, fidelity, language
from .registry import registry
from .sqlkit import fold, in_list, norm_key, squeeze, table

QUERIES, SQL, query = registry()


@query(r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', ['scheme', 'host', 'path']) AS x,
                  list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
                    lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('trk', 'trackingid', 'ref', 'refid')) AS q FROM pages)
SELECT page_id, lower(x.scheme) || '://' || lower(x.host) || CASE WHEN rtrim(x.path, '/') = '' THEN '/' ELSE rtrim(x.path, '/') END
       || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM u
""")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query(f"""SELECT c_custkey, 'vac-' || substr(k, 1, 16) AS entity_id, k AS identity_key FROM (
SELECT c_custkey, sha256({norm_key('c_name')} || '|' || {norm_key('c_mktsegment')} || '|' || {norm_key('n_name')}) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def norm_key_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    who = stable_identity(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name"), F.lit(None).cast("string"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", who.alias("w")).select("c_custkey", "w.entity_id", "w.identity_key")


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(f"""
WITH k AS (SELECT doc_id, source, lang, n_chars, sha256({norm_key('text')}) AS entity FROM documents)
SELECT entity, count(*) AS n_records, arg_min(doc_id, (-n_chars, source, doc_id)) AS preferred_doc, arg_min(lang, (-n_chars, source, doc_id)) AS lang,
       array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM k GROUP BY entity
""")
def survivorship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(T.norm_key(F.col("text")), 256)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", key.alias("entity"))
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("source").alias("b"), F.col("doc_id").alias("c"))
    return rows.groupBy("entity").agg(
        F.count("*").alias("n_records"), F.min_by("doc_id", order).alias("preferred_doc"), F.min_by("lang", order).alias("lang"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) = 1)
SELECT w.doc_id, coalesce((SELECT string_agg(f.w, ' ' ORDER BY f.i) FROM f WHERE f.doc_id = w.doc_id), '') AS words FROM w
""")
def ordered_distinct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.distinct_by_case(words), " ").alias("words"))


SNAPSHOT_SQL = """
prev AS (SELECT doc_id, source AS entity_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
cur AS (SELECT doc_id, source AS entity_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0),
ch AS (SELECT coalesce(p.doc_id, c.doc_id) AS doc_id,
              CASE WHEN p.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'deleted' WHEN p.h = c.h THEN 'unchanged' ELSE 'modified' END AS change
       FROM prev p FULL OUTER JOIN cur c ON p.doc_id = c.doc_id)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two made-up snapshots of documents: one lacks every seventh file, the other every fifth, and every eleventh differs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("entity_id"), "text")
    previous = docs.filter("doc_id % 7 <> 0").select("doc_id", "entity_id", F.sha2("text", 256).alias("source_hash"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return previous, docs.filter("doc_id % 5 <> 0").select("doc_id", "entity_id", F.sha2(changed, 256).alias("source_hash"))


@query(f"WITH {SNAPSHOT_SQL} SELECT doc_id, change FROM ch")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(spark, sf_dir), path="doc_id")


@query(f"""WITH {SNAPSHOT_SQL}, ids AS (
SELECT DISTINCT entity_id FROM prev JOIN ch USING (doc_id) WHERE change IN ('modified', 'deleted') UNION SELECT entity_id FROM cur JOIN ch USING (doc_id) WHERE change IN ('new', 'modified'))
SELECT doc_id, entity_id, h AS source_hash FROM cur WHERE entity_id IN (SELECT entity_id FROM ids)""")
def impacted_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous, current = _snapshots(spark, sf_dir)
    changes = diff.snapshot_diff(previous, current, path="doc_id")
    ids = diff.impacted(changes, previous, current, path="doc_id")
    return diff.affected_records(current, ids).select("doc_id", "entity_id", "source_hash")


def _count_sql(lang: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower(text), '[a-záéíóúñü]+'), lambda w: w IN {in_list(language.MARKERS[lang])}))"


def _title_sql(lang: str) -> str:
    title = fold("split_part(text, chr(10), 1)")
    terms = [t if lang == "en" else None for t in language.TITLE_TERMS[lang]]
    return " + ".join(f"contains({title}, {fold(chr(39) + t + chr(39)) if plain is None else chr(39) + t + chr(39)})::INT" for t, plain in zip(language.TITLE_TERMS[lang], terms, strict=True))


@query(f"""
WITH c AS (SELECT doc_id, {_count_sql('en')} AS en, {_count_sql('es')} AS es, {_title_sql('en')} AS ten, {_title_sql('es')} AS tes FROM documents)
SELECT doc_id,
  CASE WHEN en >= greatest(3, es + 2) THEN 'en' WHEN es >= greatest(3, en + 2) THEN 'es' WHEN ten > tes THEN 'en' WHEN tes > ten THEN 'es' ELSE 'und' END AS lang,
  round(CASE WHEN en >= greatest(3, es + 2) THEN least(0.98, 0.72 + 0.03 * en) WHEN es >= greatest(3, en + 2) THEN least(0.98, 0.72 + 0.03 * es)
             WHEN ten > tes THEN 0.86 WHEN tes > ten THEN 0.9 ELSE 0 END::DOUBLE, 6) AS confidence,
  CASE WHEN en >= greatest(3, es + 2) OR es >= greatest(3, en + 2) THEN 'vacancy_text' WHEN ten <> tes THEN 'role_title' ELSE 'undetermined' END AS source FROM c
""")
def language_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = language.infer_language(F.substring_index("text", "\n", 1), F.col("text"), F.lit(None).cast("string"))
    out = table(spark, sf_dir, "documents").select("doc_id", said.alias("x"))
    return out.select("doc_id", "x.lang", F.round("x.confidence", 6).alias("confidence"), "x.source")


@query(f"""
WITH c AS (SELECT doc_id, length({squeeze('text')}) AS chars, len(list_filter(string_split(text, chr(10)), lambda l: length({squeeze('l')}) >= 24)) AS items FROM documents),
d AS (SELECT *, CAST(CAST(least(chars / 1200.0::DOUBLE, 1) * 60 + least(items / 8.0::DOUBLE, 1) * 40 AS VARCHAR) AS DECIMAL(30, 18)) * 10 AS x FROM c),
s AS (SELECT *, CAST(floor(x) + CASE WHEN x - floor(x) > 0.5 OR (x - floor(x) = 0.5 AND floor(x) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10 AS score FROM d)
SELECT doc_id, CASE WHEN chars >= 1200 OR items >= 10 OR (chars >= 600 AND items >= 3 AND score >= 70) THEN 'full' WHEN chars >= 300 OR items >= 3 OR score >= 30 THEN 'partial' ELSE 'sparse' END AS fidelity,
       score, chars >= 300 OR items >= 3 OR score >= 30 AS eligible, chars AS description_chars, items AS n_requirements FROM s
""")
def fidelity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    jd = fidelity.assess(F.col("text"), F.split("text", "\n"), F.array().cast("array<string>"))
    out = table(spark, sf_dir, "documents").select("doc_id", jd.alias("x"))
    return out.select("doc_id", "x.fidelity", "x.score", "x.eligible", F.col("x.description_chars").cast("bigint").alias("description_chars"), F.col("x.n_requirements").cast("bigint").alias("n_requirements"))


@query("""
WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
bad AS (SELECT user_id, event_id, list_filter([CASE WHEN k > 95 THEN 'k out of range' END, CASE WHEN value < 0.2 THEN 'value too small' END], lambda x: x IS NOT NULL) AS errors FROM e)
SELECT user_id, CAST(sum(len(errors)) AS BIGINT) AS n_errors, count(*) AS n_rows, CASE WHEN sum(len(errors)) > 0 THEN 'quarantined' ELSE 'valid' END AS status FROM bad GROUP BY user_id
""")
def validation_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    errors = F.array_compact(F.array(F.when(k > 95, "k out of range"), F.when(F.col("value") < 0.2, "value too small")))
    rows = table(spark, sf_dir, "events").select("user_id", F.size(errors).alias("n"))
    out = rows.groupBy("user_id").agg(F.sum("n").alias("n_errors"), F.count("*").alias("n_rows"))
    return out.withColumn("status", F.when(F.col("n_errors") > 0, "quarantined").otherwise("valid"))


@query("""SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_exists(props, '$.k') THEN 'feed_a' ELSE 'unknown' END AS source_format,
strftime(ts, '%Y-%m-%d') AS posted_date FROM events""")
def json_adapt(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.parse_json("props")
    shape = F.when(F.contains(F.schema_of_variant(doc), F.lit("k:")), "feed_a").otherwise("unknown")
    day = T.posted_date(F.date_format("ts", "yyyy-MM-dd"))["iso"]
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.try_variant_get(doc, "$.k", "bigint").alias("k"), shape.alias("source_format"), day.alias("posted_date"))


@query("SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS n_orders, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS price_rank FROM orders")
def relational_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanity of the engine's own built-ins: window functions."""
    w = Window.partitionBy("o_custkey")
    rank = F.rank().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.count("*").over(w).alias("n_orders"), rank.alias("price_rank"))


@query("""SELECT r_name, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag <> 'R' GROUP BY ALL""")
def relational_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanity of the engine's own built-ins: joins and aggregation."""
    l, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    j = l.filter("l_returnflag <> 'R'").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def relational_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanity of the engine's own built-ins: semi and anti joins and a union."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))
