"""Feeds of postings: JSON files of two shapes to canonical records, whole files accepted or rejected.

A file is read as bytes with its digest; its envelope is told by shape. Values are kept as VARIANT until they are checked, so
wrong types are reported instead of lost. Any error rejects the whole file: its rows go to quarantine with the errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import semantic_hash, stable_identity
from ..functions.text import canonical_url, clean_list, clean_string, posted_date, work_model
from ..operators.fidelity import assess
from ..operators.language import infer_language

#: For each shape the key of its list, of its declared count, and of the fields of an entry.
SHAPES = {
    "feed_a": {
        "list": "vacancies", "count": "total_results", "company": "company", "role_title": "role_title", "location": None, "city": "location.city", "work_model": "location.work_model",
        "objects": ("location",), "lists": ("tech_stack",), "score": "fit_score", "language": ("application_language", "language"), "seniority": "seniority", "category": "company_category",
        "posted": "posted_date", "url": "url", "salary": "salary", "stack": "tech_stack", "summary": "fit_evaluation", "strengths": "fit_strengths", "gaps": "fit_gaps", "native": "id", "updated": "last_updated", "searched": None,
    },
    "feed_b": {
        "list": "vacantes", "count": "metadata.total_vacantes_encontradas", "company": "empresa", "role_title": "puesto", "location": "ubicacion", "city": "ubicacion", "work_model": "modalidad",
        "objects": ("razon_ajuste",), "lists": ("stack_clave_detectado",), "score": "porcentaje_ajuste", "language": ("idioma_postulacion", "application_language"), "seniority": "seniority", "category": "categoria_empresa",
        "posted": "fecha_publicacion", "url": "url_postulacion", "salary": "rango_salarial", "stack": "stack_clave_detectado", "summary": "razon_ajuste.resumen", "strengths": "razon_ajuste.puntos_fuertes",
        "gaps": "razon_ajuste.posibles_gaps", "native": "id_vacante", "updated": None, "searched": "metadata.fecha_busqueda",
    },
}


def read_files(spark: SparkSession, root: str, *globs: str) -> DataFrame:
    """``named`` rows of the JSON files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load([f"{root}/{g}" for g in globs] or root)
    return named(files, root)


def named(files: DataFrame, root: str) -> DataFrame:
    """``(source_path, source_hash, text, content)`` of binary files; paths are relative to ``root``, text is null unless UTF-8."""
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.regexp_replace("path", "^.*" + "".join("\\" + c if c in ".+()[]{}^$|" else c for c in base), "")
    return files.select(path.alias("source_path"), F.sha2("content", 256).alias("source_hash"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), "content")


def _is_list(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")).startswith("ARRAY"), F.lit(False))


def _once(c: Column) -> Column:
    """A value worked out once a row, as the element of an array of one: a filter on it is else put in its place, and works it out again wherever it is named."""
    return F.explode(F.array(c))


def envelope(files: DataFrame) -> DataFrame:
    """Adds ``doc`` (VARIANT, null if the text is no JSON) and ``source_format`` (a shape or ``unknown``)."""
    parsed = files.select("*", _once(F.try_parse_json("text")).alias("doc"))
    kind = F.lit("unknown")
    for name, s in reversed(SHAPES.items()):
        kind = F.when(_is_list(F.col("doc"), s["list"]), name).otherwise(kind)
    return parsed.withColumn("source_format", kind)


def _text(v: Column, path: str) -> Column:
    return clean_string(F.try_variant_get(v, f"$.{path}", "string"))


def _kind(v: Column, path: str) -> Column:
    """Type of a field: null where absent, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def _wrong(v: Column, path: str, *kinds: str) -> Column:
    k = _kind(v, path)
    return k.isNotNull() & (k != "VOID") & ~F.regexp_extract(k, "^([A-Z]+)", 1).isin(*kinds)


def entry_errors(shape: str, item: Column, at: Column) -> Column:
    """Messages about one entry; empty if it is fine."""
    s = SHAPES[shape]
    where = F.concat(F.lit(s["list"] + "["), at.cast("string"), F.lit("]"))
    said = lambda test, what: F.when(test, F.concat(where, F.lit(what)))
    score = F.try_variant_get(item, f"$.{s['score']}", "double")
    number = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")
    bad_score = _wrong(item, s["score"], *number) | (score < 0) | (score > 100)
    checks = [said(_text(item, s[k]).isNull(), f".{s[k]} is required") for k in ("company", "role_title")]
    checks += [said(_wrong(item, k, "ARRAY"), f".{k} must be an array") for k in s["lists"]]
    checks += [said(_wrong(item, k, "OBJECT"), f".{k} must be an object") for k in s["objects"]]
    first = F.coalesce(_kind(item, s["language"][0]), _kind(item, s["language"][1]))
    checks += [said(bad_score, f".{s['score']} must be a number between 0 and 100"), said(~first.isin("STRING", "VOID"), f".{s['language'][0]} must be a string when provided")]
    return F.when(_whole(item).startswith("OBJECT"), F.array_compact(F.array(*checks))).otherwise(F.array(F.concat(where, F.lit(" must be an object"))))


def _errors_of(shape: str):
    return lambda item, at: entry_errors(shape, item, at)


def _whole(item: Column) -> Column:
    return F.schema_of_variant(item)


def check(files: DataFrame) -> DataFrame:
    """Adds ``errors`` to ``envelope`` rows: all messages about a file, in the order of its entries."""
    out = F.array(F.when(F.col("text").isNull(), "file is not UTF-8").when(F.col("doc").isNull(), "invalid JSON").otherwise("unsupported JSON envelope; expected vacancies[] or vacantes[]"))
    for name, s in SHAPES.items():
        items = F.coalesce(F.try_variant_get("doc", f"$.{s['list']}", "array<variant>"), F.array().cast("array<variant>"))
        declared = F.try_variant_get("doc", f"$.{s['count']}", "bigint")
        count = F.when(declared != F.size(items), F.concat(F.lit(s["count"] + "="), declared.cast("string"), F.lit(f" does not match {s['list']} length="), F.size(items).cast("string")))
        errors = F.flatten(F.transform(items, _errors_of(name)))
        out = F.when(F.col("source_format") == name, F.concat(F.array_compact(F.array(count)), errors)).otherwise(out)
    return files.select("*", _once(out).alias("errors"))


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0).select("source_path", "source_hash", "source_format", "text", "errors")


def adapt(checked: DataFrame, commit: str | None = None) -> DataFrame:
    """Canonical records of the files without errors, a row for each entry."""
    fine = checked.filter(F.size("errors") == 0)
    out = None
    for name in SHAPES:
        part = _adapted(fine.filter(F.col("source_format") == name), name, commit)
        out = part if out is None else out.unionByName(part)
    return out


def _adapted(files: DataFrame, name: str, commit: str | None) -> DataFrame:
    s = SHAPES[name]
    entries = files.select("source_path", "source_hash", "source_format", "doc", F.posexplode(F.try_variant_get("doc", f"$.{s['list']}", "array<variant>")).alias("idx", "item"))
    item, doc = F.col("item"), F.col("doc")
    text = lambda key: _text(item, s[key]) if s[key] else F.lit(None).cast("string")
    many = lambda path: clean_list(F.try_variant_get(item, f"$.{path}", "array<string>"))
    head = lambda key: _text(doc, s[key]) if s[key] else F.lit(None).cast("string")
    spoken = F.coalesce(*[F.when(_kind(item, p).isNotNull(), F.coalesce(_text(item, p), F.lit(""))) for p in s["language"]])
    # Fields, then what is told from them, are each worked out once: put together they are one expression too large to be compiled.
    r = entries.select(_once(F.struct(
        "source_path", "source_hash", "source_format", "idx", F.coalesce(text("company"), F.lit("")).alias("company"), F.coalesce(text("role_title"), F.lit("")).alias("role_title"),
        text("seniority").alias("seniority"), text("category").alias("company_category"), (text("location") if s["location"] else text("city")).alias("location_raw"), text("city").alias("city"),
        work_model(text("work_model")).alias("work_model"), posted_date(text("posted")).alias("p"), canonical_url(text("url")).alias("url"), text("salary").alias("salary"), many(s["stack"]).alias("tech_stack"),
        many("requirements").alias("requirements"), many("responsibilities").alias("responsibilities"), _text(item, "description").alias("description"), spoken.alias("spoken"),
        F.try_variant_get(item, f"$.{s['score']}", "double").alias("fit_score"), text("summary").alias("fit_summary"), many(s["strengths"]).alias("fit_strengths"), many(s["gaps"]).alias("fit_gaps"),
        text("native").alias("native"), head("updated").alias("updated"), head("searched").alias("searched"),
    )).alias("r")).select("r.*")
    c = F.col
    body = F.concat_ws(" ", "description", "requirements", "responsibilities")
    told = (infer_language(c("role_title"), body, c("spoken")).alias("lang"), stable_identity(c("company"), c("role_title"), c("location_raw"), c("url")).alias("id"), assess(c("description"), c("requirements"), c("responsibilities")).alias("jd"))
    for t, name in zip(told, ("lang", "id", "jd"), strict=True):
        r = r.select("*", _once(t).alias(name))
    provenance = F.struct(
        "source_path", "source_hash", "source_format", c("idx").alias("source_entry_index"), c("native").alias("source_native_id"), F.lit(commit).cast("string").alias("source_commit"),
        c("updated").alias("source_updated_at"), c("searched").alias("source_search_date"),
    )
    out = r.select(
        F.lit(2).alias("schema_version"), c("id.entity_id").alias("vacancy_id"), "company", "role_title", "seniority", "company_category", "location_raw", "city", "work_model", c("p.iso").alias("posted_date"),
        c("p.raw").alias("posted_date_raw"), "url", "salary", "tech_stack", "requirements", "responsibilities", "description", c("lang.lang").alias("application_language"), c("lang.confidence").alias("language_confidence"),
        c("lang.source").alias("language_source"), "fit_score", "fit_summary", "fit_strengths", "fit_gaps", c("id.identity_key").alias("identity_key"), F.array(provenance).alias("provenance"), c("jd.fidelity").alias("jd_fidelity"),
        c("jd.score").alias("jd_fidelity_score"), c("jd.reasons").alias("jd_fidelity_reasons"), c("jd.eligible").alias("jd_generation_eligible"),
    )
    hashed = sorted(x for x in out.columns if x != "provenance" and not x.startswith("jd_"))
    return out.withColumn("content_hash", semantic_hash(*hashed))
