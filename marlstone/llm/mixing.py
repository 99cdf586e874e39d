"""Mixing sources to target weights.

Sources, in code-point order with null last, weigh by a repeating pattern and share all words. A target stops at
``most`` times its source's size; what is over goes to the others by weight until none is above. The closed form: with
sources by rising cap a weight, the first k are capped, and the rest get the remaining words by weight.

Each document gets a hash-random key, of its id and its text, so that null or equal ids do not meet in one bucket. Whole epochs take a document as often; the last, partial epoch takes documents in
key order up to the budget, cutting the one at the border. The prefix sums are distributed: within a source the key
range is cut in buckets of about ``bucket_rows`` documents (keys are uniform, so buckets are alike), buckets are summed,
their offsets come from two levels of running sums, and only then are documents of one bucket put in order. A source
with a third of all rows is so spread over many tasks, and the order depends on nothing but keys.

Cases: a null text has size 0; null, repeated ids and rows repeated whole are ordered by (key, id, size), which leaves
only rows alike in id and text exchangeable (they lie in one bucket); a null source is a source of its own; an empty table gives no rows; a
source of size 0 has target 0; other columns are carried along unless their names clash with a column made here,
which then wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, running_totals, written

KEY_BITS = 52


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``(source, source_size, n_docs)`` to the same with ``target``. Sources are ranked and summed by running totals over
    ranges of them, so there may be millions; only two totals and one rate come to the driver."""
    ranked = running_totals(sizes, ["source"], {"rank": F.lit(1)}, nulls_last=True)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most).withColumn("turn", F.col("cap") / F.col("weight"))
    w = running_totals(w, ["turn", "source"], {"caps": F.col("cap"), "weights": F.col("weight")}, nulls_last=True)
    total, everything = w.agg(F.sum("source_size"), F.sum("weight")).first()
    rate = F.lit(total or 0).cast("long") - F.col("caps")
    w = w.withColumn("rate", rate.cast("double") / (F.lit(everything or 0).cast("long") - F.col("weights")).cast("double"))
    # The first source whose cap is above its share at the rate left by those before it: it and all after share at that rate.
    free = w.filter(F.col("rate") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("turn", "rate")).alias("free")).first()["free"]
    capped = F.col("cap").cast("double")
    target = capped if free is None else F.least(capped, F.lit(free["rate"]) * F.col("weight"))
    return w.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, bucket_rows: int = 256, seed: str = "mix", carry: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, taken (words, repeats counted) and
    epochs (whole times taken). With ``carry`` the other columns too."""
    made = {"source_size", "target", "taken", "size", "epochs", "_key", "_bucket", "_upper", "_source"}
    rest = [F.col(f"`{c}`") for c in docs.columns if carry and c not in made | {doc_id, source}]
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), *rest,
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))), 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("_key"),
    )
    thin = sized if carry else written(sized, "mix-sizes")
    totals = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    totals = written(totals, "mix-targets").withColumnRenamed("source", "_source")
    buckets = F.ceil(F.col("n_docs") / bucket_rows)
    joined = (
        thin.join(totals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_bucket", F.floor(F.col("_key") / F.lit(float(1 << KEY_BITS)) * buckets)).drop("n_docs")
    )
    sums = joined.groupBy("source", "_bucket").agg(F.sum("size").alias("s")).withColumn("_upper", F.floor(F.col("_bucket") / 1024))
    earlier = Window.unboundedPreceding, -1
    upper = sums.groupBy("source", "_upper").agg(F.sum("s").alias("s"))
    upper = upper.select("source", "_upper", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("_upper").rowsBetween(*earlier)), F.lit(0)).alias("o"))
    inner = F.coalesce(F.sum("s").over(Window.partitionBy("source", "_upper").orderBy("_bucket").rowsBetween(*earlier)), F.lit(0))
    lower = sums.select("source", "_upper", "_bucket", inner.alias("i"))
    l, u = lower.alias("l"), upper.alias("u")
    offsets = written(
        l.join(u, F.col("l.source").eqNullSafe(F.col("u.source")) & (F.col("l._upper") == F.col("u._upper")))
        .select(F.col("l.source").alias("_source"), F.col("l._bucket").alias("_b"), (F.col("i") + F.col("o")).alias("offset")), "mix-offsets",
    )
    order = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size")
    run = joined.withColumn("within", F.coalesce(F.sum("size").over(order.rowsBetween(*earlier)), F.lit(0)))
    at = run.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("offset") - F.col("within")))
    out = at.withColumn("epochs", epochs).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return out.select("doc_id", "source", *rest, "size", "source_size", "target", "epochs", "taken")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: all documents at weights 5, 2, 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) AS k
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals),
rated AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS rate
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(rate, cap / weight) FROM rated WHERE rate * weight <= cap) * weight, CAST(cap AS DOUBLE))) AS target
  FROM rated),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""
