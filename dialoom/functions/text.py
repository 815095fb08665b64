"""Text expressions as Columns; all of them stay in the JVM."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: White space as a regex class body: what Unicode, and the four separators U+001C..U+001F, count as blank.
BLANK = r"\s\p{Z}\x0b\x1c-\x1f\x85"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def name_key(c: Column) -> Column:
    """Trimmed and lower-cased, for comparing names."""
    return F.lower(strip(c))


def clean(c: Column) -> Column:
    """Null as empty, no byte order mark, line ends as line feeds, stripped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "﻿", "")
    return strip(F.regexp_replace(c, "\r\n?", "\n"))


def collapse(c: Column) -> Column:
    """Null as empty, every run of white space as one space, stripped."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{BLANK}]+", " "))


def hits(c: Column, markers: list[str]) -> Column:
    """How many of the markers occur (each counts once); case matters."""
    return sum((c.contains(m).cast("int") for m in markers), F.lit(0))


def has_any(c: Column, markers: list[str]) -> Column:
    """Whether any marker occurs; case matters."""
    return F.coalesce(c.rlike("|".join(map(_quoted, markers))), F.lit(False))


def _quoted(m: str) -> str:
    return "".join("\\" + x if x in r".+*?()[]{}^$|\\" else x for x in m)


def punctuation(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[，。！？；：,.!?;:]"))


def _most_frequent(values: Column) -> Column:
    """How often the most frequent value of an array that is not empty stands in it: sorted once, its longest run."""

    def longest(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.array_max(F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda j: F.get(at, j) - F.get(at, j - 1))))

    return let(F.sort_array(values), longest)


def top_char_share(c: Column) -> Column:
    """Share of the most frequent character that is not blank; 1 for a text without any."""
    dense = F.regexp_replace(c, rf"[{BLANK}]+", "")
    return let(dense, lambda d: F.when(d == "", F.lit(1.0)).otherwise(_most_frequent(F.filter(F.split(d, ""), lambda x: x != "")) / F.length(d)))


def top_line_share(c: Column) -> Column:
    """Share of the most frequent line among the lines that are not blank; 0 with at most one of them."""
    lines = F.filter(F.transform(F.split(c, "\r\n|[\r\n]"), strip), lambda x: x != "")
    return let(lines, lambda x: F.when(F.size(x) <= 1, F.lit(0.0)).otherwise(_most_frequent(x) / F.size(x)))


def paragraphs(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "[。！？\n]"), lambda x: strip(x) != ""))


def letters_only(c: Column) -> Column:
    """Lower-cased, Han characters and ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^\\u4e00-\\u9fffA-Za-z0-9]+", "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[。！？!?；;\n]+"), letters_only), lambda x: x != "")


def repeated_sentences(c: Column) -> Column:
    """Share of sentences that only repeat an earlier one; 0 below two sentences."""
    return let(sentences(c), lambda s: F.when(F.size(s) < 2, F.lit(0.0)).otherwise((F.size(s) - F.size(F.array_distinct(s))) / F.size(s)))


def bigrams(c: Column) -> Column:
    """Character pairs of the letters-only text with repetition; single characters of a shorter one."""
    return let(
        letters_only(c),
        lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.length(t) == 1, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))),
    )


def numbered(bag: Column) -> Column:
    """A bag as a set: each repetition of an element gets its own number."""
    return let(F.array_sort(bag), lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit("#"), (i + 1 - F.array_position(s, x)).cast("string"))))


def bag_overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two bags of strings: multiset intersection against both sizes; 0 where one is empty."""
    return let(numbered(a), lambda x: let(numbered(b), lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))))


def letter_pairs(t: str) -> Counter:
    """The pairs of adjacent letters of a text of letters only, a single letter by itself, with their numbers."""
    return Counter(t) if len(t) == 1 else Counter(map(str.__add__, t, t[1:]))


def pairs_f1(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    return 2.0 * sum(min(n, b[g]) for g, n in a.items() if g in b) / (a.total() + b.total())


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of the letter pairs of two texts, as :func:`bag_overlap_f1` of :func:`bigrams`, in linear time over Arrow batches."""

    @F.pandas_udf(t.DoubleType())
    def f1(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([pairs_f1(letter_pairs(p), letter_pairs(q)) for p, q in zip(x, y)], dtype="float64")

    return f1(letters_only(F.coalesce(a, F.lit(""))), letters_only(F.coalesce(b, F.lit(""))))


def slug(c: Column) -> Column:
    """Lower case; letters, digits, - and _ stay, the rest is one hyphen; none at the ends."""
    c = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}\-_]", "-")
    return F.regexp_replace(F.regexp_replace(c, "-+", "-"), "^-+|-+$", "")


def redacted(c: Column) -> Column:
    """Keys and tokens of common services, and values of secret-looking settings, replaced."""
    for pattern, by in ((r"\bwandb_v1_[A-Za-z0-9_]{20,}", "<KEY>"), (r"\bhf_[A-Za-z0-9]{20,}", "<TOKEN>"), (r"((?:API_KEY|SECRET|TOKEN|PASSWORD)\s*=\s*)\S+", "$1<HIDDEN>")):
        c = F.regexp_replace(c, pattern, by)
    return c


def last_number(c: Column) -> Column:
    """The last number of a text, without trailing zeros after the point."""
    found = F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    n = F.try_element_at(found, F.lit(-1))
    return F.when(n.contains("."), F.regexp_replace(F.regexp_replace(n, "0+$", ""), "\\.$", "")).otherwise(n)


def tag_title(c: Column) -> Column:
    """A tag for display: without its prefix, separators as spaces, first letter upper."""
    t = F.translate(F.element_at(F.split(c, ":"), -1), "_-", "  ")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))


def answer_letter(c: Column) -> Column:
    """The letter of a multiple-choice answer: a stated answer first, else a letter in brackets, else the only letter."""
    patterns = (r"(?i)(?:answer|答案)\s*(?:is|是|:|：)?\s*\(?([A-D])\b", r"\(([A-D])\)", r"^\s*([A-D])\s*[.)）]?\s*$")
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns))


def code_block(c: Column) -> Column:
    """The body of the first fenced Python block, else the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "(?s)```python\\n(.*?)```", 1), F.lit("")), c)


def json_object(c: Column) -> Column:
    """The outermost braces of a reply, fences dropped; null without any."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), "(?s)(\\{.*\\})", 1), F.lit(""))
