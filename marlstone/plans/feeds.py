"""Queries on feeds: files made of customers are checked, adapted, merged, chunked and ingested by the engine's own operators.

A customer is a file with one entry. Its shape, and what is wrong with it, follow from its key, so that SQL can say what must come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, lexical, merge
from ..sources import feeds
from ..sources.state import StateStore, work_dir
from ..streaming import ingest
from .registry import registry
from .sqlkit import norm_key, table

QUERIES, SQL, query = registry()


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_path, source_hash, text, c_custkey)``: odd keys give the second shape; some files have errors."""
    # Rows are few bytes and become long texts: a table of one small file would be one task's work.
    dealt = table(spark, sf_dir, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    c = dealt.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    role = F.when(k % 29 == 0, "").otherwise(F.col("c_mktsegment"))
    stack = F.when(k % 23 == 0, _quoted(F.lit("one"))).otherwise(F.concat(F.lit('["SQL", "sql", "'), F.col("c_mktsegment"), F.lit('"]')))
    score = F.when(k % 5 == 0, "null").otherwise(F.format_string("%d", F.floor(F.col("c_acctbal") / 100)))
    count = F.when(k % 31 == 0, "2").otherwise("1")
    salary = F.when(k % 3 == 0, _quoted(k.cast("string"))).otherwise("null")
    url = F.concat(F.lit('"see https://Ex.com/c/'), k.cast("string"), F.lit('/?utm_x=1&id='), k.cast("string"), F.lit('#top"'))
    model = F.when(k % 3 == 0, "Remoto").when(k % 3 == 1, "on-site").otherwise("office")
    first = F.concat(
        F.lit('{"last_updated": "2026-01-01", "total_results": '), count, F.lit(', "vacancies": [{"company": "'), F.col("n_name"), F.lit(' ", "role_title": "'), role, F.lit('", "location": {"city": "Town", "work_model": "'), model,
        F.lit('"}, "language": "Spanish", "posted_date": "2026-01-02", "url": '), url, F.lit(', "salary": '), salary, F.lit(', "fit_score": '), score, F.lit(', "tech_stack": '), stack, F.lit("}]}"),
    )
    second = F.concat(
        F.lit('{"metadata": {"total_vacantes_encontradas": '), count, F.lit('}, "vacantes": [{"empresa": "'), F.col("n_name"), F.lit('", "puesto": "'), role, F.lit('", "ubicacion": "Town", "modalidad": "'), model,
        F.lit('", "idioma_postulacion": "es-MX", "fecha_publicacion": "soon", "url_postulacion": '), url, F.lit(', "rango_salarial": '), salary, F.lit(', "porcentaje_ajuste": '), score, F.lit(', "stack_clave_detectado": '), stack, F.lit("}]}"),
    )
    text = F.when(k % 37 == 0, "{").when(k % 41 == 0, '{"other": []}').when(k % 2 == 1, second).otherwise(first)
    path = F.concat(F.lit("in/"), F.lpad(k.cast("string"), 9, "0"), F.lit(".json"))
    return c.select(path.alias("source_path"), F.sha2(text, 256).alias("source_hash"), text.alias("text"), "c_custkey")


#: What a file must come to: s its shape, e its errors in order, and the fields of its entry.
FILES_SQL = f"""
f AS (SELECT c_custkey AS k, 'in/' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.json' AS path, n_name AS company, c_mktsegment AS segment, CASE WHEN k % 29 = 0 THEN '' ELSE c_mktsegment END AS role,
             CASE WHEN k % 37 = 0 OR k % 41 = 0 THEN 'unknown' WHEN k % 2 = 1 THEN 'feed_b' ELSE 'feed_a' END AS s, CASE WHEN k % 5 <> 0 THEN floor(c_acctbal / 100) END AS score
      FROM (SELECT *, c_custkey AS k FROM customer) JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT *, CASE s WHEN 'feed_a' THEN 'vacancies[0]' ELSE 'vacantes[0]' END AS here FROM f),
h AS (SELECT *, CASE WHEN k % 37 = 0 THEN ['invalid JSON'] WHEN s = 'unknown' THEN ['unsupported JSON envelope; expected vacancies[] or vacantes[]'] ELSE list_filter([
        CASE WHEN k % 31 = 0 THEN CASE s WHEN 'feed_a' THEN 'total_results=2 does not match vacancies length=1' ELSE 'metadata.total_vacantes_encontradas=2 does not match vacantes length=1' END END,
        CASE WHEN role = '' THEN here || CASE s WHEN 'feed_a' THEN '.role_title' ELSE '.puesto' END || ' is required' END,
        CASE WHEN k % 23 = 0 THEN here || CASE s WHEN 'feed_a' THEN '.tech_stack' ELSE '.stack_clave_detectado' END || ' must be an array' END,
        CASE WHEN score < 0 OR score > 100 THEN here || CASE s WHEN 'feed_a' THEN '.fit_score' ELSE '.porcentaje_ajuste' END || ' must be a number between 0 and 100' END], lambda x: x IS NOT NULL) END AS e FROM g),
ok AS (SELECT *, sha256({norm_key('company')} || '|' || {norm_key('role')} || '|town') AS digest, ['SQL', segment] AS stack, CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) END AS salary,
              CASE k % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'On-site' ELSE 'office' END AS model FROM h WHERE len(e) = 0)
"""


def _adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.adapt(feeds.check(feeds.envelope(_files(spark, sf_dir))), "c0ffee")


@query(f"WITH {FILES_SQL} SELECT k AS c_custkey, s AS source_format, array_to_string(e, '; ') AS errors FROM h")
def feed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and errors of each file."""
    return feeds.check(feeds.envelope(_files(spark, sf_dir))).select("c_custkey", "source_format", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {FILES_SQL} SELECT path AS source_path, s AS source_format, len(e) AS n_errors FROM h WHERE len(e) > 0")
def feed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are rejected whole."""
    bad = feeds.quarantine(feeds.check(feeds.envelope(_files(spark, sf_dir))))
    return bad.select("source_path", "source_format", F.size("errors").cast("bigint").alias("n_errors"))


@query(f"""WITH {FILES_SQL} SELECT path AS source_path, 'vac-' || substr(digest, 1, 16) AS vacancy_id, digest AS identity_key, company, role AS role_title, model AS work_model, CASE s WHEN 'feed_a' THEN '2026-01-02' END AS posted_date,
CASE s WHEN 'feed_a' THEN '2026-01-02' ELSE 'soon' END AS posted_date_raw, 'https://ex.com/c/' || k || '?id=' || k AS url, salary, array_to_string(stack, ',') AS tech_stack, 'es' AS application_language, 1.0::DOUBLE AS language_confidence,
'explicit_source' AS language_source, CAST(score AS DOUBLE) AS fit_score, 'sparse' AS jd_fidelity, false AS jd_generation_eligible, 'c0ffee' AS source_commit FROM ok""")
def feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of the files without errors."""
    one = F.get("provenance", 0)
    return _adapted(spark, sf_dir).select(
        one["source_path"].alias("source_path"), "vacancy_id", "identity_key", "company", "role_title", "work_model", "posted_date", "posted_date_raw", "url", "salary", F.array_join("tech_stack", ",").alias("tech_stack"),
        "application_language", "language_confidence", "language_source", "fit_score", "jd_fidelity", "jd_generation_eligible", one["source_commit"].alias("source_commit"),
    )


#: Of each identity: preferred is the record with most filled fields (an ISO date and a salary are all that differ), then the first path.
MERGED_SQL = f"""
{FILES_SQL},
m AS (SELECT 'vac-' || substr(digest, 1, 16) AS vacancy_id, count(*) AS n_sources, arg_min(k, (-(CASE s WHEN 'feed_a' THEN 1 ELSE 0 END + CASE WHEN salary IS NULL THEN 0 ELSE 1 END), path)) AS preferred,
             arg_min(k, (CASE WHEN score IS NULL THEN 1 ELSE 0 END, path)) AS scored, any_value(company) AS company, any_value(role) AS role, any_value(stack) AS stack, min(path) AS first_path FROM ok GROUP BY digest),
w AS (SELECT m.*, p.salary, p.model, p.s, 'https://ex.com/c/' || preferred || '?id=' || preferred AS url, CAST(q.score AS DOUBLE) AS score FROM m JOIN ok p ON p.k = preferred JOIN ok q ON q.k = scored)
"""


@query(f"""WITH {MERGED_SQL} SELECT vacancy_id, n_sources, company, salary, model AS work_model, CASE s WHEN 'feed_a' THEN '2026-01-02' END AS posted_date, url, score AS fit_score, array_to_string(stack, ',') AS tech_stack, first_path,
'es' AS application_language FROM w""")
def records_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an identity: the preferred one's fields, the lists of all, the language and score of those that win by their own rules."""
    m = merge.merge_records(_adapted(spark, sf_dir))
    return m.select(
        "vacancy_id", F.size("provenance").cast("bigint").alias("n_sources"), "company", "salary", "work_model", "posted_date", "url", "fit_score", F.array_join("tech_stack", ",").alias("tech_stack"),
        F.get("provenance", 0)["source_path"].alias("first_path"), "application_language",
    )


CHUNKS_SQL = f"""
{MERGED_SQL},
t AS (SELECT vacancy_id, 'core' AS chunk_type, 'Role: ' || role || chr(10) || 'Company: ' || company || chr(10) || 'Location: Town' || chr(10) || 'Work model: ' || model || chr(10) || 'Application language: es' || chr(10) ||
             'JD fidelity: sparse (0/100)' || chr(10) || 'JD generation eligible: false' AS text FROM w
      UNION ALL SELECT vacancy_id, 'requirements', 'Technologies / capabilities: ' || array_to_string(stack, '; ') FROM w
      UNION ALL SELECT vacancy_id, 'source-fit', 'Source fit score: ' || CAST(score AS BIGINT) || '/100' FROM w WHERE score IS NOT NULL)
"""


@query(f"WITH {CHUNKS_SQL} SELECT vacancy_id || '::' || chunk_type AS chunk_id, vacancy_id, chunk_type, text, sha256(text) AS content_hash FROM t")
def posting_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.posting_chunks(merge.merge_records(_adapted(spark, sf_dir))).select("chunk_id", "vacancy_id", "chunk_type", "text", "content_hash")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_type, count(*) AS n FROM t WHERE chunk_type <> 'source-fit' GROUP BY chunk_type")
def eligible_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that searches take unless others are asked for."""
    found = lexical.eligible(chunks.posting_chunks(merge.merge_records(_adapted(spark, sf_dir))))
    return found.groupBy("chunk_type").agg(F.count("*").alias("n"))


#: Three runs: all files but every seventh; then all but every eleventh, which are edited where divisible by 13; then the same again.
#: An edit is a space, so a record is the same as before where it still comes from the same files.
RUNS_SQL = f"""
{FILES_SQL},
one AS (SELECT k, path, digest, len(e) AS bad FROM h LEFT JOIN (SELECT k, digest FROM ok) USING (k) WHERE k % 7 <> 0),
two AS (SELECT k, path, digest, len(e) AS bad FROM h LEFT JOIN (SELECT k, digest FROM ok) USING (k) WHERE k % 11 <> 0),
ch AS (SELECT coalesce(one.k, two.k) AS k, CASE WHEN one.k IS NULL THEN 'new' WHEN two.k IS NULL THEN 'deleted' WHEN one.k % 13 = 0 THEN 'modified' ELSE 'unchanged' END AS change, one.digest AS old, two.digest AS now,
              coalesce(two.bad, 0) > 0 AS bad FROM one FULL JOIN two ON one.k = two.k),
hit AS (SELECT old AS digest FROM ch WHERE change IN ('modified', 'deleted') AND old IS NOT NULL UNION SELECT now FROM ch WHERE change IN ('new', 'modified') AND now IS NOT NULL),
was AS (SELECT digest, list(path ORDER BY path) AS paths FROM one WHERE digest IS NOT NULL GROUP BY digest),
now AS (SELECT digest, list(path ORDER BY path) AS paths FROM two WHERE digest IS NOT NULL GROUP BY digest),
kept AS (SELECT hit.digest, was.paths IS NOT DISTINCT FROM now.paths AS same FROM hit JOIN now ON now.digest = hit.digest LEFT JOIN was ON was.digest = hit.digest),
c AS (SELECT 'r1' AS run_id, 'new' AS counter, count(*) AS n FROM one UNION ALL SELECT 'r1', 'quarantined', count(*) FROM one WHERE bad > 0 UNION ALL SELECT 'r1', 'active', count(DISTINCT digest) FROM one
      UNION ALL SELECT 'r1', 'impacted', count(DISTINCT digest) FROM one UNION ALL SELECT 'r1', 'reindexed', count(DISTINCT digest) FROM one UNION ALL SELECT 'r1', 'discovered', count(*) FROM one
      UNION ALL SELECT 'r2', change, count(*) FROM ch GROUP BY change UNION ALL SELECT 'r2', 'quarantined', count(*) FROM ch WHERE bad AND change IN ('new', 'modified')
      UNION ALL SELECT 'r2', 'active', count(DISTINCT digest) FROM two UNION ALL SELECT 'r2', 'impacted', count(*) FROM hit UNION ALL SELECT 'r2', 'discovered', count(*) FROM two
      UNION ALL SELECT 'r2', CASE WHEN same THEN 'semantic_unchanged' ELSE 'reindexed' END, count(*) FROM kept GROUP BY same
      UNION ALL SELECT 'r2', 'deleted_entities', count(*) FROM hit WHERE digest NOT IN (SELECT digest FROM two WHERE digest IS NOT NULL)
      UNION ALL SELECT 'r3', 'unchanged', count(*) FROM two UNION ALL SELECT 'r3', 'active', count(DISTINCT digest) FROM two UNION ALL SELECT 'r3', 'discovered', count(*) FROM two)
"""


def _two_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sf_dir)
    edited = F.when(F.col("c_custkey") % 13 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    then = files.filter("c_custkey % 11 <> 0").withColumn("text", edited).withColumn("source_hash", F.sha2("text", 256))
    return files.filter("c_custkey % 7 <> 0").drop("c_custkey"), then.drop("c_custkey")


def _counters(store: StateStore) -> DataFrame:
    return store.log("runs", ingest.RUNS).select("run_id", F.explode("counts").alias("counter", "n")).filter("n > 0")


@query(f"WITH {RUNS_SQL} SELECT run_id, counter, n FROM c WHERE n > 0")
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of three ingest runs over one state that are not zero: a first one, one with changes of every kind, and one without any."""
    store = StateStore(spark, f"{work_dir(spark)}/runs-{uuid.uuid4().hex}", buckets=8)
    first, then = _two_states(spark, sf_dir)
    for n, given in enumerate((first, then, then), 1):
        ingest.run_batch(spark, store, given, f"r{n}")
    return _counters(store)


#: Two batches of a stream: all files but every seventh; then, of the others' and the edited ones, all but every eleventh. Nothing is deleted.
STREAM_SQL = f"""
{FILES_SQL},
one AS (SELECT k, path, digest, len(e) AS bad FROM h LEFT JOIN (SELECT k, digest FROM ok) USING (k) WHERE k % 7 <> 0),
two AS (SELECT k, path, digest, len(e) AS bad, k % 7 = 0 AS new FROM h LEFT JOIN (SELECT k, digest FROM ok) USING (k) WHERE k % 11 <> 0 AND (k % 7 = 0 OR k % 13 = 0)),
f2 AS (SELECT digest, bool_or(new) AS more FROM two WHERE digest IS NOT NULL GROUP BY digest),
terms AS (SELECT digest, lower(segment) AS term FROM (SELECT * FROM ok WHERE k % 7 <> 0 OR k % 11 <> 0)),
c AS (SELECT 'feed-0' AS run_id, 'new' AS counter, count(*) AS n FROM one UNION ALL SELECT 'feed-0', 'discovered', count(*) FROM one UNION ALL SELECT 'feed-0', 'quarantined', count(*) FROM one WHERE bad > 0
      UNION ALL SELECT 'feed-0', x, count(DISTINCT digest) FROM one, (VALUES ('active'), ('impacted'), ('reindexed')) t(x) GROUP BY x
      UNION ALL SELECT 'feed-1', CASE WHEN new THEN 'new' ELSE 'modified' END, count(*) FROM two GROUP BY 2 UNION ALL SELECT 'feed-1', 'discovered', count(*) FROM two UNION ALL SELECT 'feed-1', 'quarantined', count(*) FROM two WHERE bad > 0
      UNION ALL SELECT 'feed-1', 'impacted', count(*) FROM f2 UNION ALL SELECT 'feed-1', CASE WHEN more THEN 'reindexed' ELSE 'semantic_unchanged' END, count(*) FROM f2 GROUP BY 2
      UNION ALL SELECT 'feed-1', 'active', count(DISTINCT digest) FROM terms
      UNION ALL SELECT 'indexed', term, 2 * count(DISTINCT digest) FROM terms GROUP BY term)
"""


@query(f"WITH {STREAM_SQL} SELECT run_id, counter, n FROM c WHERE n > 0")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the runs that a stream of files feeds, in two batches and a start with nothing new, and document frequencies of the segments (a record's role and its technologies, a chunk each), as differences kept them."""
    root = f"{work_dir(spark)}/follow-{uuid.uuid4().hex}"
    store = StateStore(spark, f"{root}/state", buckets=8)
    first, then = _two_states(spark, sf_dir)
    key = F.substring("source_path", 4, 9).cast("int")
    for batch in (first, then.filter((key % 7 == 0) | (key % 13 == 0)), None):
        if batch is not None:
            batch.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(first.schema).parquet(f"{root}/in")
        ingest.follow(spark, store, stream, f"{root}/checkpoint").awaitTermination()
    counts = ingest.frequencies(store.current("frequencies"))
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("term")).distinct()
    return _counters(store).unionByName(counts.join(segments, "term", "left_semi").select(F.lit("indexed").alias("run_id"), F.col("term").alias("counter"), F.col("df").alias("n")))
