"""Language of a posting: what the source says, then marker words of the body, then terms of the title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import body_words, fold, strip

# Codes, aliases, marker words and title terms.
SUPPORTED = ("en", "es", "fr")
ALIASES = {
    "english": "en", "ingles": "en", "inglés": "en", "en-us": "en", "en-gb": "en",
    "spanish": "es", "espanol": "es", "español": "es", "es-mx": "es",
    "french": "fr", "frances": "fr", "francés": "fr",
}
MARKERS = {
    "en": (
        "the", "and", "with", "for", "you", "your", "will", "experience", "requirements", "responsibilities",
        "build", "develop", "design", "production", "team", "business", "data", "models", "role", "skills",
    ),
    "es": (
        "el", "la", "los", "las", "y", "con", "para", "tu", "usted", "experiencia", "requisitos", "responsabilidades",
        "desarrollar", "diseñar", "produccion", "producción", "equipo", "negocio", "datos", "modelos", "puesto", "habilidades",
    ),
}
TITLE_TERMS = {
    "en": (
        "data scientist", "machine learning", "engineer", "scientist", "head of", "director", "lead", "manager",
        "analytics", "artificial intelligence", "ai ", "ml ", "researcher", "decision scientist",
    ),
    "es": (
        "cientifico de datos", "científica de datos", "cientifico", "ingeniero", "ingeniera", "jefe de", "director de",
        "directora de", "lider", "líder", "analitica", "analítica", "inteligencia artificial", "aprendizaje automatico",
        "aprendizaje automático",
    ),
}
TITLE_CONFIDENCE = {"en": 0.86, "es": 0.9}


def explicit_language(value: Column) -> Column:
    """Code that the source states, null if none or not supported; a region is cut off."""
    key = F.replace(F.lower(strip(value)), F.lit("_"), F.lit("-"))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    code = F.coalesce(F.try_element_at(alias, key), F.substring_index(key, "-", 1))
    return F.when((F.coalesce(value, F.lit("")) != "") & code.isin(*SUPPORTED), code)


def marker_count(words: Column, lang: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*MARKERS[lang])))


def title_count(title: Column, lang: str) -> Column:
    """Terms found in the folded title. Each listed spelling counts, also those that fold to the same."""
    folded = fold(F.coalesce(title, F.lit("")))
    terms = [F.lit(t) for t in TITLE_TERMS[lang]]
    return sum((F.contains(folded, fold(t) if lang == "es" else t).cast("int") for t in terms), F.lit(0))


def infer_language(title: Column, body: Column, explicit: Column) -> Column:
    """``struct(lang, confidence, source)``.

    Words, then counts, are bound once each, as the element of an array of one: the cases below use them several times."""
    said, t_en, t_es = explicit_language(explicit), title_count(title, "en"), title_count(title, "es")
    counts = F.transform(F.array(body_words(body)), lambda w: F.struct(*[marker_count(w, lang).alias(lang) for lang in MARKERS], t_en.alias("t_en"), t_es.alias("t_es"), said.alias("said")))
    return F.get(F.transform(counts, _choose), 0)


def _choose(c: Column) -> Column:
    en, es = c["en"], c["es"]
    sure = lambda n: F.least(F.lit(0.98), F.lit(0.72) + F.lit(0.03) * n)
    cases = [
        (c["said"].isNotNull(), c["said"], F.lit(1.0), "explicit_source"),
        (en >= F.greatest(F.lit(3), es + 2), F.lit("en"), sure(en), "vacancy_text"),
        (es >= F.greatest(F.lit(3), en + 2), F.lit("es"), sure(es), "vacancy_text"),
        (c["t_en"] > c["t_es"], F.lit("en"), F.lit(TITLE_CONFIDENCE["en"]), "role_title"),
        (c["t_es"] > c["t_en"], F.lit("es"), F.lit(TITLE_CONFIDENCE["es"]), "role_title"),
    ]
    out = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("undetermined").alias("source"))
    for test, lang, confidence, source in reversed(cases):
        out = F.when(test, F.struct(lang.alias("lang"), confidence.alias("confidence"), F.lit(source).alias("source"))).otherwise(out)
    return out
