"""Hashes that identify content and entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_key


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def semantic_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON; callers pass them in alphabetical order. Nulls are written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def identity_base(company: Column, role: Column, location: Column, url: Column) -> Column:
    """Normalised keys joined by a bar; the URL takes part only where the location is blank."""
    base = F.concat_ws("|", norm_key(company), norm_key(role), norm_key(location))
    alone = (norm_key(location) == "") & (F.coalesce(url, F.lit("")) != "")
    return F.when(alone, F.concat_ws("|", base, norm_key(url))).otherwise(base)


def stable_identity(company: Column, role: Column, location: Column, url: Column) -> Column:
    """``struct(entity_id, identity_key)``: a prefix with 16 hex digits, and all digits."""
    digest = F.sha2(identity_base(company, role, location, url), 256)
    return F.struct(F.concat(F.lit("vac-"), F.substring(digest, 1, 16)).alias("entity_id"), digest.alias("identity_key"))


def source_key(path: Column) -> Column:
    """A file name for a path: 80 safe signs, two hyphens, 16 hex digits of the path."""
    safe = F.regexp_replace(F.regexp_replace(path, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.substring(safe, 1, 80), F.lit("--"), F.substring(F.sha2(path, 256), 1, 16))
