"""Checked configuration of documents: layout, density, style, models."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

# Sections in their default order, and when each is shown.
SECTIONS = ("summary", "experience", "education", "projects", "skills", "certifications")
MODES = ("always", "auto", "never")


@dataclass(frozen=True)
class Layout:
    order: tuple[str, ...] = SECTIONS
    modes: Mapping[str, str] = field(default_factory=lambda: dict.fromkeys(SECTIONS, "auto") | {"summary": "always", "experience": "always"})

    def __post_init__(self) -> None:
        if sorted(self.order) != sorted(SECTIONS):
            raise ValueError("order must hold every section exactly once")
        if set(self.modes) != set(SECTIONS) or not set(self.modes.values()) <= set(MODES):
            raise ValueError("modes must give every section one of " + ", ".join(MODES))
        if "never" in (self.modes["summary"], self.modes["experience"]):
            raise ValueError("summary and experience can't be turned off")


@dataclass(frozen=True)
class Density:
    max_summary_words: int = 70
    max_role_bullets: int = 4
    min_role_bullets: int = 1
    max_projects: int = 2
    max_project_bullets: int = 2
    min_project_bullets: int = 1
    max_skills: int = 15
    min_skills: int = 8
    max_education: int = 2
    max_certifications: int = 5
    chars_per_line: int = 92
    lines_per_page: int = 50

    # Least and greatest of each.
    BOUNDS = {
        "max_summary_words": (30, 140), "max_role_bullets": (1, 8), "min_role_bullets": (1, 4), "max_projects": (0, 2), "max_project_bullets": (1, 4), "min_project_bullets": (1, 2), "max_skills": (10, 15), "min_skills": (1, 15),
        "max_education": (1, 2), "max_certifications": (3, 5), "chars_per_line": (60, 130), "lines_per_page": (35, 70),
    }

    def __post_init__(self) -> None:
        for name, (low, high) in self.BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        for what in ("role_bullets", "project_bullets", "skills"):
            if getattr(self, f"min_{what}") > getattr(self, f"max_{what}"):
                raise ValueError(f"min_{what} exceeds max_{what}")


#: Which token takes which token's colour, by the part of the brand and the use that a review allows it.
RESTYLED = {
    ("primary", "accents_only"): {"accent": "primary", "primary": "text"},
    ("secondary", "accents_only"): {"secondary": "muted"},
    ("secondary", "sidebar_background"): {"primary": "secondary"},
}
#: What a review must say before its document is styled.
REVIEWED = {"decision": "PASS", "ats_safe": True, "print_safe": True, "preserve_template": False}


def adapt_style(tokens: Mapping[str, str], review: Mapping[str, object] | None) -> dict[str, str]:
    """Tokens with the exchanges of ``RESTYLED`` that the review calls for, each from the tokens as given; later parts win."""
    if review is None:
        return dict(tokens)
    if wrong := [name for name, value in REVIEWED.items() if (review.get(name) or False) != value]:
        raise ValueError(f"a review that can't style a document: {', '.join(wrong)}")
    taken = {to: source for (part, use), moves in RESTYLED.items() if review.get(f"{part}_usage") == use for to, source in moves.items()}
    return {name: tokens[taken.get(name, name)] for name in {**tokens, **taken}}


def render_gate(locked: bool, contrast_passed: bool, brand_verified: bool, live_review: bool) -> None:
    """Raises where a document must not be rendered: unsafe contrast, or a verified brand without a live review. Locked templates pass."""
    if locked:
        return
    if not contrast_passed:
        raise ValueError("tokens fail the contrast checks; a review can't override that")
    if brand_verified and not live_review:
        raise ValueError("a verified brand needs a live design review")


def check_review(review: Mapping[str, object], contrast_passed: bool) -> Mapping[str, object]:
    """A reviewer's answer, refused where it passes tokens that fail the contrast checks."""
    if review.get("decision") == "PASS" and not contrast_passed:
        raise ValueError("a reviewer can't pass tokens that fail the contrast checks")
    return review


def model_ids(env: Mapping[str, str], defaults: Mapping[str, str], allowed: str) -> dict[str, str]:
    """Model of each tier: ``MODEL_<TIER>`` in the environment before the default; ids must match the pattern ``allowed``."""
    out = {tier: (env.get(f"MODEL_{tier.upper()}") or default).strip() for tier, default in defaults.items()}
    if bad := sorted(m for m in out.values() if not re.fullmatch(allowed, m)):
        raise ValueError(f"model ids that are not allowed: {bad}")
    return out
