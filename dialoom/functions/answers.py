"""Answers of benchmarks: choices, normalising, token sets, bag alignment, encrypted questions, usage counters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

# Full-width forms and their plain ones; words that do not count.
WIDE = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９．，：；（）"
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,:;()"
ARTICLES = ["a", "an", "the"]
LETTERS = "ABCD"


def permuted(choices: Column, key: Column, seed: str = "0") -> Column:
    """The choices in an order drawn per row from a hash of the key and the choice."""
    return F.transform(F.array_sort(F.transform(choices, lambda c: F.struct(F.md5(F.concat(key, F.lit("|" + seed + "|"), c)).alias("h"), c.alias("c")))), lambda s: s["c"])


def letter_of(choices: Column, right: Column) -> Column:
    return F.substring(F.lit(LETTERS), F.array_position(choices, right).cast("int"), F.lit(1))


def choice_prompt(question: Column, choices: Column) -> Column:
    return F.concat(question, *(F.concat(F.lit(f"\n{x}) "), F.element_at(choices, i + 1)) for i, x in enumerate(LETTERS)))


def plain_response(c: Column) -> Column:
    """Mark-up of emphasis and mathematics dropped, full-width letters, digits and marks made plain."""
    for mark in ("**", "$\\boxed{", "}$", "\\$", "$\\text{", "$", "\\mathrm{", "\\{", "\\text", "\\(", "\\mathbf{", "{", "\\boxed"):
        c = F.replace(c, F.lit(mark), F.lit(""))
    return F.translate(c, WIDE, PLAIN)


def answer_tokens(c: Column) -> Column:
    """Lower-cased tokens between spaces and hyphens without marks (numbers keep their point) and articles; distinct."""
    parts = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[ \\-]+"), lambda x: F.when(x.rlike(r"^[+-]?\d+(\.\d+)?$"), x).otherwise(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.isin(ARTICLES)))


def token_f1(found: Column, wanted: Column) -> Column:
    """F1 of two token sets in per cent; 0 if the wanted one has numbers and they share none."""
    common = F.array_intersect(found, wanted)
    numbers = F.filter(wanted, lambda x: x.rlike(r"^[+-]?\d+(\.\d+)?$"))
    f1 = F.when((F.size(found) == 0) | (F.size(wanted) == 0) | (F.size(common) == 0), F.lit(0.0)).otherwise(200.0 * F.size(common) / (F.size(found) + F.size(wanted)))
    return F.when((F.size(numbers) > 0) & (F.size(F.array_intersect(numbers, found)) == 0), F.lit(0.0)).otherwise(f1)


def loosely_equal(a: Column, b: Column) -> Column:
    """Either normalised text contains the other; empty ones are equal only to each other."""
    x, y = (F.array_join(answer_tokens(c), " ") for c in (a, b))
    return F.when((x == "") | (y == ""), x == y).otherwise(x.contains(y) | y.contains(x))


def all_roles_in(messages: Column, roles: list[str]) -> Column:
    return F.forall(messages, lambda m: m["role"].isin(roles))


def metric_key(c: Column) -> Column:
    """``theme:category:criterion`` keys as a struct; missing parts are null."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^([^:]*)(?::([^:]*))?(?::(.*))?$", i), F.lit(""))
    return F.struct(part(1).alias("theme"), part(2).alias("category"), part(3).alias("criterion"))


def usage(c: Column) -> Column:
    """Token counters of a reply's usage in either layout: prompt and completion, or input and output."""
    j = F.from_json(c, "prompt_tokens long, completion_tokens long, input_tokens long, output_tokens long, total_tokens long, prompt_tokens_details struct<cached_tokens:long>, input_tokens_details struct<cached_tokens:long>, completion_tokens_details struct<reasoning_tokens:long>, output_tokens_details struct<reasoning_tokens:long>")
    given, made = F.coalesce(j["input_tokens"], j["prompt_tokens"]), F.coalesce(j["output_tokens"], j["completion_tokens"])
    return F.struct(
        given.alias("input"), F.coalesce(j["input_tokens_details"]["cached_tokens"], j["prompt_tokens_details"]["cached_tokens"]).alias("cached"), made.alias("output"),
        F.coalesce(j["output_tokens_details"]["reasoning_tokens"], j["completion_tokens_details"]["reasoning_tokens"]).alias("reasoning"), F.coalesce(j["total_tokens"], given + made).alias("total"),
    )


def _key(password: str, n: int) -> np.ndarray:
    raw = np.frombuffer(hashlib.sha256(password.encode()).digest(), np.uint8)
    return np.resize(raw, n)


@F.pandas_udf(t.StringType())
def decrypted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Base64 text XORed with the repeated SHA-256 of a password; null where either is null."""
    for cipher, password in parts:
        yield pd.Series([None if c is None or p is None else bytes(np.frombuffer(raw := base64.b64decode(c), np.uint8) ^ _key(p, len(raw))).decode("utf-8", "replace") for c, p in zip(cipher, password)], dtype=object)


def encrypted(text: str, password: str) -> str:
    raw = np.frombuffer(text.encode(), np.uint8)
    return base64.b64encode(bytes(raw ^ _key(password, len(raw)))).decode()


@F.pandas_udf(t.StringType())
def locked(texts: pd.Series, passwords: pd.Series) -> pd.Series:
    """The counterpart of :func:`decrypted`."""
    return pd.Series([None if x is None or p is None else encrypted(x, p) for x, p in zip(texts, passwords)], dtype=object)


def best_pairing(gain: np.ndarray) -> float:
    """The largest total of a one-to-one pairing (shortest augmenting paths with potentials)."""
    if not gain.size:
        return 0.0
    cost = -(gain if gain.shape[0] <= gain.shape[1] else gain.T)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, via, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            seen[at] = True
            row = owner[at]
            slack = np.where(seen[1:], np.inf, cost[row - 1] - u[row] - v[1:])
            better = slack < least[1:]
            least[1:][better] = slack[better]
            via[1:][better] = at
            free = np.where(seen[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            delta = free[nxt - 1]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[via[at]]
            at = via[at]
    return float(-sum(cost[owner[j] - 1, j - 1] for j in range(1, m + 1) if owner[j]))


@F.pandas_udf(t.DoubleType())
def bags_f1(found: pd.Series, wanted: pd.Series) -> pd.Series:
    """Mean F1 over the best one-to-one pairing of two lists of token sets, in per cent; unpaired ones count 0."""

    def one(a, b) -> float:
        a, b = [set(x) for x in (a if a is not None else [])], [set(x) for x in (b if b is not None else [])]
        if not a or not b:
            return 0.0
        gain = np.array([[2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0 for y in b] for x in a])
        return round(100 * best_pairing(gain) / max(len(a), len(b)), 2)

    return pd.Series([one(a, b) for a, b in zip(found, wanted)], dtype=float)
