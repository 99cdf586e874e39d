"""Entity resolution by key: who survives, whose language and score count, and what is united.

Records are rows with ``vacancy_id``, the scalar and list columns below, and ``provenance``, an array of structs that
begins with ``source_path``. One aggregation a key: survivors are picked with ``min_by`` on a sort key, which combines
before the shuffle; lists are united from ordered arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import semantic_hash
from ..functions.text import distinct_by_case
from .fidelity import assess

SCALARS = ("seniority", "company_category", "location_raw", "city", "work_model", "posted_date", "posted_date_raw", "url", "salary", "description", "fit_summary")
LISTS = ("tech_stack", "requirements", "responsibilities", "fit_strengths", "fit_gaps")
LANGUAGE = ("application_language", "language_confidence", "language_source")
FIT = ("fit_score", "fit_summary")


def _filled(c: Column) -> Column:
    return (F.coalesce(c.cast("string"), F.lit("")) != "").cast("int")


def _path() -> Column:
    return F.coalesce(F.get(F.col("provenance"), 0)["source_path"], F.lit(""))


def preference() -> Column:
    """Sort key of the preferred record: more scalars, more list items, more detail, surer language, then path."""
    scalars = sum((_filled(F.col(c)) for c in SCALARS), F.lit(0))
    items = sum((F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in LISTS), F.lit(0))
    return F.struct((-scalars).alias("a"), (-items).alias("b"), (-F.col("jd_fidelity_score")).alias("c"), (-F.col("language_confidence")).alias("d"), _path().alias("e"))


def fit_preference() -> Column:
    """Sort key of the record whose score counts: has a score, more detail, then path."""
    none = F.array().cast("array<string>")
    detail = _filled(F.col("fit_summary")) + F.size(F.coalesce("fit_strengths", none)) + F.size(F.coalesce("fit_gaps", none))
    return F.struct((-F.col("fit_score").isNotNull().cast("int")).alias("a"), (-detail).alias("b"), _path().alias("c"))


def united(column: str) -> Column:
    """All lists of a key in path order, as one list, case-insensitively distinct."""
    parts = F.array_sort(F.collect_list(F.struct(_path().alias("p"), F.coalesce(column, F.array().cast("array<string>")).alias("v"))))
    return distinct_by_case(F.flatten(F.transform(parts, lambda x: x["v"])))


def distinct_sources(refs: Column) -> Column:
    """References in order, the first of each path and entry; a null path or entry is a value. Sorted by key and place, so a long list takes n log n; a null list is null."""
    same = lambda x, y: x["p"].eqNullSafe(y["p"]) & x["e"].eqNullSafe(y["e"])

    def kept(all_: Column) -> Column:
        keyed = F.array_sort(F.transform(all_, lambda x, i: F.struct(x["source_path"].alias("p"), x["source_entry_index"].alias("e"), i.alias("i"))))
        firsts = F.get(F.transform(F.array(keyed), lambda s: F.filter(s, lambda x, i: (i == 0) | ~same(F.get(s, i - 1), x))), 0)
        return F.transform(F.array_sort(F.transform(firsts, lambda x: x["i"])), lambda i: F.get(all_, i))

    # The list and the sorted one are bound once, as the element of an array of one: within a lambda they would be made again for each element.
    return F.get(F.transform(F.array(refs), kept), 0)


def merge_records(records: DataFrame) -> DataFrame:
    """One row a ``vacancy_id``. Lists follow the path of their record."""
    everything = F.struct(*[F.col(c) for c in records.columns])
    refs = F.array_sort(F.collect_list(F.struct(_path().alias("p"), F.col("provenance").alias("v"))))
    once = distinct_sources(F.flatten(F.transform(refs, lambda x: x["v"])))
    grouped = records.groupBy("vacancy_id").agg(
        F.min_by(everything, preference()).alias("best"),
        F.min_by(F.struct(*LANGUAGE), F.struct((-F.col("language_confidence")).alias("c"), _path().alias("p"))).alias("said"),
        F.min_by(F.struct(*FIT), fit_preference()).alias("fit"),
        *[united(c).alias(c) for c in LISTS], once.alias("provenance"),
    )
    seen = assess(F.col("best.description"), F.col("requirements"), F.col("responsibilities"))
    new = {c: F.col(c) for c in LISTS} | {c: F.col(f"said.{c}") for c in LANGUAGE} | {c: F.col(f"fit.{c}") for c in FIT}
    new |= {"jd_fidelity": F.col("seen.fidelity"), "jd_fidelity_score": F.col("seen.score"), "jd_fidelity_reasons": F.col("seen.reasons"), "jd_generation_eligible": F.col("seen.eligible"), "provenance": F.col("provenance"), "vacancy_id": F.col("vacancy_id")}
    out = grouped.withColumn("seen", seen).select(*[new.get(c, F.col(f"best.{c}")).alias(c) for c in records.columns if c != "content_hash"])
    hashed = sorted(c for c in out.columns if c != "provenance")
    return out.withColumn("content_hash", semantic_hash(*hashed))
