"""What a document is written from: stable backbone, editorial anchors and matched evidence; and the editorial gate.

Which records are stable, which anchors stick and which markers are wanted is configuration: small tables of rules, joined or compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queue import ordered_union


@dataclass(frozen=True)
class Backbone:
    """Stable records in the order they are listed: titles that count, and headings below which everything does."""

    record_id: str
    titles: tuple[str, ...] = ()
    headings: tuple[str, ...] = ()


@dataclass(frozen=True)
class Anchors:
    """Evidence that always takes part, by title, by record, or by a text marker within a record."""

    titles: tuple[str, ...] = ()
    records: tuple[str, ...] = ()
    markers: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Editorial:
    """Limits and markers of the editorial gate. ``order`` lists organisations that must be there, newest first; ``progression`` names those that must
    show at least two stages, told by two titles or by two of ``stages`` in one entry."""

    identities: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    progression: tuple[str, ...] = ()
    stages: tuple[str, ...] = ("expert", "associate", "analyst", "senior")
    wanted_skill: tuple[str, ...] = ()
    wanted_certifications: dict[str, tuple[str, ...]] = field(default_factory=dict)
    forbidden: tuple[str, ...] = ("evidence unavailable", "evidence not available", "not provided in supplied evidence", "information unavailable")
    most: dict[str, int] = field(default_factory=lambda: {"projects": 2, "skills": 15, "certifications": 5})
    required: tuple[str, ...] = ("education", "skills", "certifications")


def public(chunks: DataFrame) -> DataFrame:
    """Chunks that may be cited and shown."""
    return chunks.filter("cv_eligible AND public_safe")


def backbone(chunks: DataFrame, rules: tuple[Backbone, ...]) -> DataFrame:
    """``(chunk_id, pos)`` of the stable chunks: by record, listed titles in their order, then those below a heading."""
    place = F.lit(None).cast("struct<r:int,t:int>")
    for n, rule in reversed(list(enumerate(rules))):
        own = F.col("record_id") == rule.record_id
        for i, h in reversed(list(enumerate(rule.headings))):
            place = F.when(own & F.array_contains("heading_path", h), F.struct(F.lit(n).alias("r"), F.lit(len(rule.titles) + i).alias("t"))).otherwise(place)
        for i, t in reversed(list(enumerate(rule.titles))):
            place = F.when(own & (F.col("title") == t), F.struct(F.lit(n).alias("r"), F.lit(i).alias("t"))).otherwise(place)
    placed = public(chunks).select("chunk_id", place.alias("p")).filter("p is not null").withColumn("at", F.struct("p.r", "p.t", "chunk_id"))
    return ordered_union(placed, key="chunk_id", order="at")


def editorial_anchors(chunks: DataFrame, rules: Anchors) -> DataFrame:
    """``(chunk_id, pos)`` of the sticky chunks, by record and id."""
    test = F.col("title").isin(*rules.titles) | F.col("record_id").isin(*rules.records) if rules.titles or rules.records else F.lit(False)
    for record, marker in rules.markers:
        test = test | ((F.col("record_id") == record) & F.contains("text", F.lit(marker)))
    picked = public(chunks).filter(test).withColumn("at", F.struct("record_id", "chunk_id"))
    return ordered_union(picked, key="chunk_id", order="at")


def assemble(chunks: DataFrame, stable: DataFrame, sticky: DataFrame, matched: DataFrame) -> DataFrame:
    """``(chunk_id, pos)``: backbone, then anchors, then matched evidence that may be cited; each chunk once.

    ``matched(chunk_id, pos)``."""
    usable = matched.join(chunks.filter("cv_eligible").select("chunk_id"), "chunk_id", "left_semi")
    return ordered_union(stable, sticky, usable, key="chunk_id", order="pos")


def ready(records: DataFrame, allow_sparse: bool = False) -> DataFrame:
    """Adds ``blocked``: why a document must not be written yet, null if it may."""
    sparse = F.lit(not allow_sparse) & ~F.coalesce("jd_generation_eligible", F.lit(False))
    detail = F.concat(F.lit("jd_fidelity="), F.coalesce("jd_fidelity", F.lit("unknown")), F.lit(" score="), F.coalesce(F.col("jd_fidelity_score").cast("string"), F.lit("unknown")))
    why = F.when(F.col("application_language") == "und", F.lit("undetermined application_language")).when(sparse, F.concat(F.lit("not eligible: "), detail))
    return records.withColumn("blocked", why)


LINE = "struct<text:string,evidence_refs:array<string>>"
DOCUMENT = (
    f"doc_id string, language string, target_role string, headline {LINE}, summary {LINE}, "
    f"experience array<struct<organization:string,title:string,period:string,evidence_refs:array<string>,bullets:array<{LINE}>>>, "
    f"projects array<struct<name:string,evidence_refs:array<string>,bullets:array<{LINE}>>>, skills array<{LINE}>, education array<{LINE}>, certifications array<{LINE}>"
)


def claims(docs: DataFrame) -> DataFrame:
    """Every line of ``docs`` (of schema DOCUMENT) that must cite evidence: (doc_id, location, text, refs)."""
    at = lambda name, i: F.concat(F.lit(name + "["), i.cast("string"), F.lit("]"))
    row = lambda where, text, refs: F.struct(where.alias("location"), text.alias("text"), refs.alias("refs"))
    single = [F.array(row(F.lit(c), F.col(c)["text"], F.col(c)["evidence_refs"])) for c in ("headline", "summary")]

    def items(name: str, text) -> Column:
        def one(x: Column, i: Column) -> Column:
            bullets = F.transform(x["bullets"], lambda b, j: row(F.concat(at(name, i), F.lit(".bullets["), j.cast("string"), F.lit("]")), b["text"], b["evidence_refs"]))
            return F.concat(F.array(row(F.concat(at(name, i), F.lit(".identity")), text(x), x["evidence_refs"])), bullets)

        return F.flatten(F.transform(F.col(name), one))

    groups = [items("experience", lambda x: F.concat_ws(" ", x["organization"], x["title"], x["period"])), items("projects", lambda x: x["name"])]
    lines = [F.transform(F.col(n), _line(n)) for n in ("skills", "education", "certifications")]
    empty = F.array().cast("array<struct<location:string,text:string,refs:array<string>>>")
    return docs.select("doc_id", F.inline(F.concat(*[F.coalesce(x, empty) for x in (*single, *groups, *lines)])))


def _line(name: str):
    return lambda x, i: F.struct(F.concat(F.lit(name + "["), i.cast("string"), F.lit("]")).alias("location"), x["text"].alias("text"), x["evidence_refs"].alias("refs"))


def cited_refs(docs: DataFrame) -> DataFrame:
    """Distinct references of each document."""
    return claims(docs).select("doc_id", F.explode("refs").alias("ref")).distinct()


def editorial_issues(docs: DataFrame, rules: Editorial) -> DataFrame:
    """``(doc_id, code, location)`` of documents of schema DOCUMENT against the rules."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    squeeze = lambda c: F.trim(F.regexp_replace(low(c), r"\s+", " "))
    has = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(True)
    joined = lambda c: low(F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{LINE}>")), lambda x: x["text"]), " "))
    orgs = F.transform("experience", lambda x: squeeze(x["organization"]))
    places = lambda name: F.filter(F.sequence(F.lit(0), F.size("experience") - 1), lambda i: F.contains(F.get(orgs, i), F.lit(name)))
    checks: list[tuple[Column, str, str]] = []
    if rules.identities:
        checks.append((~has(squeeze(F.concat_ws(" ", "target_role", "headline.text")), rules.identities), "identity_outside_canonical_family", "headline"))
    some = F.size("experience") > 0
    for name in rules.order:
        checks.append((~some | (F.size(places(name)) == 0), f"{name}_missing", "experience"))
    for newer, older in zip(rules.order, rules.order[1:], strict=False):
        checks.append((some & (F.size(places(newer)) > 0) & (F.size(places(older)) > 0) & (F.array_min(places(older)) <= F.array_max(places(newer))), f"{older}_order", "experience"))
    for name in rules.progression:
        own = F.filter(F.col("experience"), _of(name))
        titles = F.size(F.array_distinct(F.transform(own, lambda x: squeeze(x["title"]))))
        text = low(F.concat_ws(" ", F.get(own, 0)["title"], F.array_join(F.transform(F.get(own, 0)["bullets"], lambda b: b["text"]), " ")))
        stages = _count(rules.stages, text)
        flat = F.when(F.size(own) >= 2, titles < 2).otherwise(stages < 2)
        checks.append((some & (F.size(own) > 0) & flat, f"{name}_progression_missing", "experience"))
    checks += [(F.coalesce(F.size(c), F.lit(0)) > n, f"too_many_{c}", c) for c, n in rules.most.items()]
    checks += [(F.coalesce(F.size(c), F.lit(0)) <= 0, f"{c}_missing", c) for c in rules.required]
    if rules.wanted_skill:
        checks.append((~has(joined("skills"), rules.wanted_skill), "wanted_skill_missing", "skills"))
    checks += [(~has(joined("certifications"), words), f"mandatory_certification_missing_{k}", "certifications") for k, words in rules.wanted_certifications.items()]
    whole = F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(w).alias("location"))) for t, c, w in checks])
    out = docs.select("doc_id", F.inline(F.array_compact(whole)))
    lines = claims(docs).withColumn("t", low(F.col("text")))
    code = F.when(F.trim("t") == "", "empty_employer_facing_field").when(has(F.col("t"), rules.forbidden) if rules.forbidden else F.lit(False), "diagnostic_language_exposed")
    return out.unionByName(lines.select("doc_id", code.alias("code"), "location").filter("code is not null"))


def _of(name: str):
    return lambda x: F.contains(F.lower(x["organization"]), F.lit(name))


def _count(words: tuple[str, ...], text: Column) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
