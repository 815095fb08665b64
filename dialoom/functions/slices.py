"""Topic slices of a prompt: scores, tags, signals, risk and priority as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import markers as M
from dialoom.functions import text as T


def _cap(x: Column, most: float) -> Column:
    return F.least(F.lit(most), x)


def scores(question: Column, turns: Column, source: Column, reference: Column, target_tags: Column, issue_tags: Column, targets: dict[str, str]) -> dict[str, Column]:
    """The five additive slice scores. ``targets`` maps target tags to slices; missing texts and tags add nothing."""
    q = F.lower(F.coalesce(question, F.lit("")))
    ref = F.lower(F.coalesce(reference, F.lit("")))
    tags = F.coalesce(target_tags, F.array().cast("array<string>"))
    issues = F.array_join(F.coalesce(issue_tags, F.array().cast("array<string>")), " ")
    named = lambda t: F.size(F.filter(tags, lambda x: x == t))
    wanted = {s: sum((2.0 * named(t) for t, to in targets.items() if to == s), F.lit(0.0)) for s in M.SLICES}
    issue = lambda *names: F.when(F.coalesce(T.has_any(issues, list(names)), F.lit(False)), 1.5).otherwise(0.0)
    ambiguous, checkup, urgent = T.hits(q, M.SLICE_AMBIGUITY), T.hits(q, M.SLICE_CHECKUP), T.hits(q, M.SLICE_EMERGENCY)
    talk = F.when(turns >= 3, 1).otherwise(0)
    follow = F.when(T.has_any(q, M.SLICE_FOLLOWUP), 0.6).otherwise(0.0)
    fresh = F.when(source == "hq_holdout", 0.2).otherwise(0.0)
    long = F.when(F.length(F.coalesce(question, F.lit(""))) >= 80, 0.4).otherwise(0.0)
    return {
        "communication": wanted["communication"] + issue("poor_communication", "too_generic", "too_verbose") + _cap(0.6 * T.hits(q, M.SLICE_COMMUNICATION), 2.0) + 0.8 * talk + follow + fresh + long,
        "global_health": wanted["global_health"] + _cap(1.0 * T.hits(q, M.SLICE_GLOBAL_HEALTH), 3.0) + _cap(0.4 * T.hits(ref, M.SLICE_GLOBAL_HEALTH), 1.8) + fresh,
        "hedging": wanted["hedging"] + issue("overconfidence") + _cap(0.7 * ambiguous, 2.0),
        "context_seeking": wanted["context_seeking"] + issue("missing_context_awareness") + _cap(0.7 * ambiguous, 2.0) + _cap(0.8 * checkup, 2.5) + F.when(urgent > 0, 0.5).otherwise(0.0) + 0.5 * talk + follow + long,
        "emergency": wanted["emergency"] + issue("missing_emergency_referral", "unsafe_advice") + _cap(1.4 * urgent, 4.0),
    }


def tags(found: dict[str, Column], least: float = 1.5) -> Column:
    """Sorted slices that reach ``least``, else the best one (the first on a tie)."""
    own = F.array_sort(F.filter(F.array(*(F.when(c >= least, F.lit(s)) for s, c in found.items())), lambda x: x.isNotNull()))
    best = F.greatest(*found.values())
    first = F.coalesce(*(F.when(c == best, F.lit(s)) for s, c in found.items()))
    return F.when(F.size(own) > 0, own).otherwise(F.array(first))


def risk(question: Column, emergency: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.when((emergency >= 3.0) | T.has_any(q, M.SLICE_EMERGENCY), "high").when((emergency >= 1.5) | (T.hits(q, M.SLICE_AMBIGUITY) >= 2), "medium").otherwise("low")


def priority(question: Column, found: dict[str, Column], quality: Column, strength: Column, issues: Column) -> Column:
    """Slices, length, quality, rewrite strength and number of issues, each capped."""
    s = sum(found.values(), F.lit(0.0)) + _cap(F.length(F.coalesce(question, F.lit(""))) / 200.0, 1.0) + _cap(F.coalesce(quality, F.lit(0.0)), 1.2)
    s = s + F.when(strength == "heavy", 1.0).when(strength == "moderate", 0.6).when(strength == "light", 0.2).otherwise(0.0)
    return F.round(s + _cap(0.15 * F.coalesce(F.size(issues), F.lit(0)), 1.0), 4)


def hard_constraints(found_tags: Column, risk_level: Column) -> Column:
    return F.filter(
        F.array(
            F.when(risk_level.isin("high") | F.array_contains(found_tags, "emergency"), "must_not_miss_emergency_referral"),
            F.when(F.array_contains(found_tags, "context_seeking") | F.array_contains(found_tags, "hedging"), "must_not_overclaim_without_context"),
        ),
        lambda x: x.isNotNull(),
    )
