"""Rules over the credential-tweaking measurements of an attempt.

Each measurement is ``[edit distance, strength-meter score, rank]``; any of the
three may be NULL. Element 0 compares with the user's valid password, the rest
with breached passwords.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT, STRENGTH, RANK = 0, 1, 2


@dataclass(frozen=True)
class TweakRule:
    """An element matches when one of the given bounds holds for it."""

    edit_min: float = 0
    edit_max: float | None = None
    strength_max: float | None = None
    rank_max: float | None = None
    skip_exact: bool = False  # an element with edit distance 0 never matches


# fixed values: thresholds of the single rules
ATTEMPT_RULE = TweakRule(edit_min=1, edit_max=3, strength_max=0, rank_max=1000)
INTERESTING_RULE = TweakRule(edit_max=3, strength_max=0, rank_max=99, skip_exact=True)
INTERESTING_WITH_EXACT_RULE = TweakRule(edit_max=3, strength_max=0, rank_max=99)
USER_RULE = TweakRule(edit_max=3, strength_max=0, rank_max=0)
HEURISTIC_EDIT = TweakRule(edit_max=2)
HEURISTIC_STRENGTH = TweakRule(strength_max=0)
HEURISTIC_RANK = TweakRule(rank_max=0)


def part(element: Column, which: int) -> Column:
    return F.get(element, F.lit(which))


def matches(element: Column, rule: TweakRule) -> Column:
    tests = []
    if rule.edit_max is not None:
        tests.append(part(element, EDIT).between(rule.edit_min, rule.edit_max))
    if rule.strength_max is not None:
        tests.append(part(element, STRENGTH) <= rule.strength_max)
    if rule.rank_max is not None:
        tests.append(part(element, RANK) <= rule.rank_max)
    hit = F.lit(False)
    for t in tests:
        hit = hit | F.coalesce(t, F.lit(False))
    if rule.skip_exact:
        hit = hit & ~is_exact(element)
    return hit


def is_exact(element: Column) -> Column:
    return F.coalesce(part(element, EDIT) == 0, F.lit(False))


def has_breached(ctm) -> Column:
    """There is at least one breached password to compare with."""
    c = F.col(ctm) if isinstance(ctm, str) else ctm
    return F.coalesce(F.size(c) > 1, F.lit(False))


def breached_part(ctm) -> Column:
    """The measurements against breached passwords, without element 0."""
    c = F.col(ctm) if isinstance(ctm, str) else ctm
    return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))


def any_match(ctm, rule: TweakRule) -> Column:
    c = F.col(ctm) if isinstance(ctm, str) else ctm
    return has_breached(c) & F.coalesce(F.exists(c, lambda e: matches(e, rule)), F.lit(False))


def num_matches(ctm, rule: TweakRule) -> Column:
    c = F.col(ctm) if isinstance(ctm, str) else ctm
    return F.when(
        has_breached(c), F.size(F.filter(c, lambda e: matches(e, rule)))
    ).otherwise(0)


def is_tweaked(ctm) -> Column:
    """Close to a breached password without being one of the compared passwords."""
    c = F.col(ctm) if isinstance(ctm, str) else ctm
    exact = F.coalesce(F.exists(c, is_exact), F.lit(False))
    return any_match(c, ATTEMPT_RULE) & ~exact


def is_tweaking_attempt(ctm) -> Column:
    """Edit distance at most 3, or a known edit distance and a strength score at
    most 1, against some breached password."""

    def near(e):
        edit, strength = part(e, EDIT), part(e, STRENGTH)
        return edit.isNotNull() & F.coalesce((edit <= 3) | (strength <= 1), F.lit(False))

    return has_breached(ctm) & F.coalesce(F.exists(breached_part(ctm), near), F.lit(False))


def parse_measurements(text) -> Column:
    """JSON text with nulls to a nested array."""
    c = F.col(text) if isinstance(text, str) else text
    return F.from_json(c, "array<array<double>>")
