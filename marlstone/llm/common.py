"""Shared plumbing: the cluster's shared folder, cut lineage, hold-out rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Code points that separate words: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is absent and the master is local (as in tests) a temporary folder is made and set; on a
    cluster its absence is an error, as executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set: on {master} it has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of the tables of the innermost ``scratch``, None outside of any; and Spark's setting that drops a query's shuffle files when it ends.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut there and survives lost executors.

    Shuffle files of the query are dropped once the table is there, not only when the driver's garbage is collected."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    if not keep and (passing := _PASSING.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes within, but for those to ``keep``, are deleted at the end: nothing that is returned may read them."""
    token = _PASSING.set([])
    try:
        yield
    finally:
        paths = _PASSING.get()
        _PASSING.reset(token)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def running_totals(df: DataFrame, order: list[str], sums: dict[str, Column], nulls_last: bool = False) -> DataFrame:
    """``df`` with, for each of ``sums``, the total of that expression (a whole number) over all rows before this one.

    Rows are dealt to ranges of ``order`` and written; each range is summed, the ranges' totals are added up in turn (a row a
    range), and rows are put in order within their range only. Rows alike in ``order`` are in an order of their own.
    """
    keys = [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc() for c in order]
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt.select("*", *(e.cast("long").alias(f"_of_{name}") for name, e in sums.items())), "ranges")
    ranges = dealt.groupBy("_range").agg(*(F.sum(f"_of_{name}").alias(f"_all_{name}") for name in sums))
    earlier = (Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(*earlier)
    ranges = ranges.select("_range", *(F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_all_{name}") for name in sums))
    within = Window.partitionBy("_range").orderBy(*keys).rowsBetween(*earlier)
    out = dealt.withColumns({f"_in_{name}": F.coalesce(F.sum(f"_of_{name}").over(within), F.lit(0)) for name in sums}).join(ranges, "_range")
    return out.select(*df.columns, *((F.col(f"_in_{name}") + F.col(f"_all_{name}")).alias(name) for name in sums))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column, used to size shards."""
    row = docs.agg(F.sum(F.octet_length(F.col(text)))).first()
    return int(row[0] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(labelled: DataFrame, key: Column, strata: str, total: int) -> DataFrame:
    """About ``total`` rows, as many of each value of ``strata``, picked by a hash of ``key``; every value takes part.

    Counts are of all rows. The pick is by hash threshold, so it is the same in every run and needs no sort; a stratum
    with fewer rows is taken whole, and of each the rows of the least hash are taken, so that none is left out where
    there are more values than ``total``. The table of thresholds has a row a value: callers fit a model with a class a value.
    """
    space = 1 << 30
    drawn = labelled.withColumn("_draw", F.pmod(F.xxhash64(key.cast("string"), F.lit("draw")), F.lit(space)))
    counts = drawn.groupBy(F.col(strata).alias("_stratum")).agg(F.count("*").alias("n"), F.min("_draw").alias("least")).collect()
    each = total / max(1, len(counts))
    kind = labelled.schema[strata].dataType.simpleString()
    limits = labelled.sparkSession.createDataFrame([(r["_stratum"], max(min(space, int(space * each / r["n"])), r["least"] + 1)) for r in counts], f"_stratum {kind}, _below long")
    return drawn.join(F.broadcast(limits), F.col(strata) == F.col("_stratum")).filter("_draw < _below").select(*(F.col(f"`{c}`") for c in labelled.columns))
