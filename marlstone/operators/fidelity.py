"""How much of a posting's own detail is there: a score, a class, and whether it suffices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import squeeze

# Least signs of an item that counts, full description and item count, thresholds.
ITEM_CHARS, FULL_CHARS, FULL_ITEMS = 24, 1200, 8
FULL_SCORE, PARTIAL_SCORE = 70.0, 30.0


def substantive(items: Column) -> Column:
    """How many items have enough signs once white space is squeezed; null gives 0."""
    return F.size(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.length(squeeze(x)) >= ITEM_CHARS))


def assess(description: Column, requirements: Column, responsibilities: Column) -> Column:
    """``struct(fidelity, score, eligible, description_chars, n_requirements, n_responsibilities, reasons)``."""
    chars = F.length(squeeze(F.coalesce(description, F.lit(""))))
    a, b = substantive(requirements), substantive(responsibilities)
    n = a + b
    score = F.bround(F.least(chars / float(FULL_CHARS), F.lit(1.0)) * 60.0 + F.least(n / float(FULL_ITEMS), F.lit(1.0)) * 40.0, 1)
    full = (chars >= FULL_CHARS) | (n >= 10) | ((chars >= 600) & (n >= 3) & (score >= FULL_SCORE))
    partial = (chars >= 300) | (n >= 3) | (score >= PARTIAL_SCORE)
    name = F.when(full, "full").when(partial, "partial").otherwise("sparse")
    why = (
        F.when(full, "substantive employer-authored JD detail is preserved")
        .when(partial, "usable employer-authored detail exists, but the JD is not fully preserved")
        .otherwise("insufficient original JD detail; source-fit commentary and inferred tech stack do not count toward fidelity")
    )
    reasons = F.array(F.concat(F.lit("description_chars="), chars.cast("string")), F.concat(F.lit("substantive_requirements="), a.cast("string")), F.concat(F.lit("substantive_responsibilities="), b.cast("string")), why)
    return F.struct(
        name.alias("fidelity"), score.alias("score"), (full | partial).alias("eligible"), chars.alias("description_chars"),
        a.alias("n_requirements"), b.alias("n_responsibilities"), reasons.alias("reasons"),
    )
