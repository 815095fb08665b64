"""Conversations as arrays of (from, value): normalising, validating, hashing, quality features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import markers as M
from dialoom.functions import text as T

CONV = "array<struct<from:string,value:string>>"


def lenient(conv: Column) -> Column:
    """Roles lower-cased, values collapsed, turns without a role or a value dropped; null as no turn."""
    turns = F.transform(F.coalesce(conv, F.array().cast(CONV)), lambda x: F.struct(T.name_key(F.coalesce(x["from"], F.lit(""))).alias("from"), T.collapse(x["value"]).alias("value")))
    return F.filter(turns, lambda x: (x["from"] != "") & (x["value"] != ""))


def mapped_role(role: Column) -> Column:
    """One name per speaker: human, gpt, system; null for any other."""
    r = T.name_key(role)
    return F.when(r.isin("user", "human"), "human").when(r.isin("assistant", "bot", "gpt"), "gpt").when(r == "system", "system")


def strict_error(conv: Column) -> Column:
    """Why a conversation is not valid, the first reason in order; null for a valid one.

    Valid: known roles, no empty value, at most one system turn, which is first,
    then human and gpt in turn, at least one of each, gpt last.
    """
    turns = F.transform(F.coalesce(conv, F.array().cast(CONV)), lambda x: F.struct(mapped_role(x["from"]).alias("r"), T.clean(x["value"]).alias("v")))
    led = F.coalesce(F.try_element_at(turns, F.lit(1))["r"] == "system", F.lit(False))
    body = F.slice(turns, F.when(led, 2).otherwise(1), F.greatest(F.size(turns), F.lit(1)))
    order = F.transform(body, lambda x, i: x["r"] == F.when(i % 2 == 0, "human").otherwise("gpt"))
    return (
        F.when(conv.isNull() | (F.size(turns) == 0), "empty conversation")
        .when(F.exists(turns, lambda x: x["r"].isNull()), "unknown role")
        .when(F.exists(turns, lambda x: x["v"] == ""), "empty value")
        .when(F.exists(order, lambda x: ~x), "roles out of order")
        .when((F.size(body) < 2) | (F.size(body) % 2 != 0), "incomplete exchange")
    )


def strict(conv: Column) -> Column:
    """The normalised form of a valid conversation."""
    return F.transform(conv, lambda x: F.struct(mapped_role(x["from"]).alias("from"), T.clean(x["value"]).alias("value")))


def from_instruction(instruction: Column, extra: Column, output: Column) -> Column:
    """Instruction, blank line, input as one human turn, output as the answer; null unless both sides have text."""
    ask = F.array_join(F.filter(F.array(T.clean(instruction), T.clean(extra)), lambda x: x != ""), "\n\n")
    return F.when((ask != "") & (T.clean(output) != ""), F.array(F.struct(F.lit("human").alias("from"), ask.alias("value")), F.struct(F.lit("gpt").alias("from"), T.clean(output).alias("value"))))


def digest(conv: Column) -> Column:
    """SHA-1 over role, unit separator, value, record separator of every turn."""
    return F.sha1(F.array_join(F.transform(conv, lambda x: F.concat(x["from"], F.lit("\x1f"), x["value"], F.lit("\x1e"))), ""))


def last_values(conv: Column) -> tuple[Column, Column]:
    """The question (last turn but one) and the answer (last turn); empty where there is none."""
    q = F.coalesce(F.try_element_at(conv, F.lit(-2))["value"], F.lit(""))
    return q, F.coalesce(F.try_element_at(conv, F.lit(-1))["value"], F.lit(""))


def rule_reasons(conv: Column, *, turns: int = 12, user: tuple = (4, 1500), assistant: tuple = (24, 4000), char_share: float = 0.35, line_share: float = 0.45) -> Column:
    """Sorted reasons to reject a leniently normalised conversation; none for a good one."""
    q, a = last_values(conv)
    order = F.exists(F.transform(conv, lambda x, i: x["from"] != F.when(i % 2 == 0, "human").otherwise("gpt")), lambda x: x)
    rules = {
        "too_many_turns": F.size(conv) > turns, "odd_turn_count": F.size(conv) % 2 != 0, "role_order_invalid": order, "user_too_short": F.length(q) < user[0], "user_too_long": F.length(q) > user[1],
        "assistant_too_short": F.length(a) < assistant[0], "assistant_too_long": F.length(a) > assistant[1], "assistant_low_structure": T.punctuation(a) < 1, "assistant_char_repeat": T.top_char_share(a) > char_share,
        "assistant_line_repeat": T.top_line_share(a) > line_share, "assistant_low_signal": a.isin(M.RULE_LOW_SIGNAL), "assistant_generic_deferral": (F.length(a) < 80) & T.has_any(a, M.RULE_DEFERRAL),
    }
    found = F.array_sort(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull()))
    return F.when(F.size(conv) == 0, F.array(F.lit("empty_conversations"))).when(F.size(conv) < 2, F.array(F.lit("too_few_turns"))).otherwise(found)


def band(value: Column, low: int, high: int, hard_low: int, hard_high: int) -> Column:
    """1 within low..high, falling in a line to 0 at the hard bounds."""
    return (
        F.when((value < hard_low) | (value > hard_high), 0.0)
        .when(value.between(low, high), 1.0)
        .when(value < low, (value - hard_low) / float(max(1, low - hard_low)))
        .otherwise((hard_high - value) / float(max(1, hard_high - high)))
    )


FEATURES = ["length_score", "question_length_score", "structure_score", "referral_score", "hedging_score", "low_signal_penalty", "absolute_penalty", "repetition_penalty", "high_risk_no_referral_penalty"]
# Weights of the nine features in the total.
WEIGHTS = [0.24, 0.08, 0.20, 0.18, 0.12, -0.10, -0.10, -0.08, -0.10]


def quality_features(q: Column, a: Column) -> dict[str, Column]:
    """The nine features of an exchange. Two conditionals bind as in the definition of record: a referral scores 0.6 whatever the risk, and the shortness penalty counts only without a low-signal hit."""
    structure, referral = T.hits(a, M.QUALITY_STRUCTURE), T.hits(a, M.QUALITY_REFERRAL)
    risky = T.has_any(q, M.QUALITY_HIGH_RISK)
    one = F.lit(1.0)
    return {
        "length_score": band(F.length(a), 80, 900, 24, 2200),
        "question_length_score": band(F.length(q), 12, 280, 4, 1200),
        "structure_score": F.least(one, 0.35 * (T.punctuation(a) >= 3).cast("int") + 0.35 * (T.paragraphs(a) >= 2).cast("int") + 0.30 * F.least(structure, F.lit(2))),
        "referral_score": F.when(referral >= 1, 0.6).otherwise(0.0),
        "hedging_score": F.least(one, T.hits(a, M.QUALITY_HEDGING) / 2.0),
        "low_signal_penalty": F.when(T.has_any(a, M.QUALITY_LOW_SIGNAL), 0.55).when(F.length(a) < 48, 0.45).otherwise(0.0),
        "absolute_penalty": F.least(one, T.hits(a, M.QUALITY_ABSOLUTE) / 2.0),
        "repetition_penalty": F.least(one, F.greatest(T.top_char_share(a) - 0.18, F.lit(0.0)) * 2.2 + F.greatest(T.top_line_share(a) - 0.2, F.lit(0.0)) * 2.0),
        "high_risk_no_referral_penalty": F.when(risky & (referral == 0), 1.0).otherwise(0.0),
    }


def quality_total(features: dict[str, Column] | None = None) -> Column:
    """The weighted sum of the features, clamped to 0..1."""
    f = features or {k: F.col(k) for k in FEATURES}
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.lit(w) * f[k] for k, w in zip(FEATURES, WEIGHTS)), F.lit(0.0))))


def quality_bucket(score: Column, high: float = 0.72, low: float = 0.45) -> Column:
    return F.when(score >= high, "high_confidence_keep").when(score < low, "high_risk_drop").otherwise("borderline_review")
