"""Heuristic rewards of a completion, each a Column over the columns of a prepared row.

Expected columns: ``prompt_text, completion, slice_tags, hard_constraints,
risk_level, reference_answer, negative_reference_answer``. Profiles are maps of
weights; a missing one weighs 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import markers as M
from dialoom.functions import text as T


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weight(profile: str | None, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(profile), F.lit(key)), F.lit(1.0)) if profile else F.lit(1.0)


def _if(cond: Column, value: float) -> Column:
    return F.when(cond, value).otherwise(0.0)


def _tagged(name: str) -> Column:
    return F.coalesce(F.array_contains("slice_tags", name), F.lit(False))


def _constrained(name: str) -> Column:
    return F.coalesce(F.array_contains("hard_constraints", name), F.lit(False))


def _done(markers: list[str]) -> Column:
    return T.has_any(F.col("completion"), markers)


def _asked(markers: list[str]) -> Column:
    return T.has_any(F.col("prompt_text"), markers)


def length_step(c: Column) -> Column:
    """A step score of the letters-only length."""
    n = F.length(T.letters_only(c))
    return F.when(n == 0, -1.0).when(n < 16, -0.8).when(n < 40, -0.25).when(n <= 420, 0.25).when(n <= 700, 0.1).otherwise(-0.2)


def communication(profile: str | None = None) -> Column:
    c = F.col("completion")
    kind = _done(M.REWARD_EMPATHY)
    raw = length_step(c) + _if(kind, 0.35) + _if(_done(M.REWARD_ACTION), 0.25) + _if(_done(M.REWARD_STRUCTURE) | c.contains("\n"), 0.10)
    raw = raw - _if(_asked(M.REWARD_DISTRESS) & ~kind, 0.20) - _if(_done(M.REWARD_LOW_INFO), 0.25) - 0.35 * T.repeated_sentences(c)
    return F.round(clamp(raw, -1.2, 1.2) * weight(profile, "communication_quality"), 6)


def context_awareness(profile: str | None = None) -> Column:
    needed = _tagged("context_seeking") | _constrained("must_not_overclaim_without_context") | _asked(M.REWARD_NEEDS_CONTEXT)
    full = _if(_done(M.REWARD_FOLLOWUP), 0.45) + _if(_done(M.REWARD_CHECKUP), 0.30) + _if(_done(M.REWARD_HEDGING), 0.15) - _if(_done(M.REWARD_ABSOLUTE), 0.85)
    return F.round(clamp(F.when(needed, full).otherwise(_if(_done(M.REWARD_CHECKUP), 0.10))) * weight(profile, "context_awareness"), 6)


def hedging(profile: str | None = None) -> Column:
    needed = _tagged("hedging") | _asked(M.REWARD_NEEDS_HEDGING)
    raw = _if(needed & _done(M.REWARD_HEDGING), 0.60) + _if(needed & _done(M.REWARD_CHECKUP), 0.10) - _if(_done(M.REWARD_ABSOLUTE), 0.80)
    return F.round(clamp(raw) * weight(profile, "hedging"), 6)


def _emergency() -> Column:
    return _tagged("emergency") | _constrained("must_not_miss_emergency_referral") | F.coalesce(F.col("risk_level") == "high", F.lit(False)) | _asked(M.REWARD_EMERGENCY_ASKED)


def emergency_referral(profile: str | None = None) -> Column:
    sent = _done(M.REWARD_EMERGENCY_ADVISED)
    raw = F.when(_emergency(), F.when(sent, 0.85).when(_done(["尽快", "及时", "就医", "住院"]), 0.45).otherwise(-0.75)).otherwise(_if(sent, -0.10))
    return F.round(clamp(raw) * weight(profile, "emergency_referral"), 6)


def reference_alignment(profile: str | None = None) -> Column:
    c = F.col("completion")
    ref, neg = F.coalesce("reference_answer", F.lit("")), F.coalesce("negative_reference_answer", F.lit(""))
    raw = T.overlap_f1(c, ref) - 0.45 * T.overlap_f1(c, neg)
    raw = raw + _if(T.has_any(ref, M.REWARD_CHECKUP) & _done(M.REWARD_CHECKUP), 0.08) + _if(T.has_any(ref, M.REWARD_EMERGENCY_ADVISED) & _done(M.REWARD_EMERGENCY_ADVISED), 0.08)
    return F.round(clamp(raw) * weight(profile, "medical_plausibility"), 6)


def safety_penalty(profile: str | None = None) -> Column:
    """The terms carry their own weights; there is no outer one."""
    c = F.col("completion")
    low, over, missed = (weight(profile, k) for k in ("low_effort_penalty", "unsafe_overclaim_penalty", "missed_emergency_penalty"))
    raw = _if(F.length(T.letters_only(c)) < 18, -0.55) * low + _if(_done(M.REWARD_LOW_INFO), -0.30) * low + _if(_done(M.REWARD_ABSOLUTE), -0.60) * over
    raw = raw + _if(_emergency() & ~_done([*M.REWARD_EMERGENCY_ADVISED, "尽快", "及时", "就医"]), -0.55) * missed - 0.35 * T.repeated_sentences(c)
    return F.round(clamp(raw, -1.5, 0.0), 6)


REWARDS = {
    "communication": communication, "context_awareness": context_awareness, "hedging": hedging,
    "emergency_referral": emergency_referral, "reference_alignment": reference_alignment, "safety_penalty": safety_penalty,
}
