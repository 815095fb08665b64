"""The SQL of the text expressions, for checking; each function mirrors one of dialoom.functions."""

from __future__ import annotations

from dialoom.functions import markers as M

BLANK = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def key(x: str) -> str:
    return f"lower({strip(x)})"


def clean(x: str) -> str:
    return strip(f"replace(replace(replace(coalesce({x}, ''), chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{BLANK}]+', ' ', 'g'))"


def hits(x: str, markers: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {q(m)})::int" for m in markers) + ")"


def has_any(x: str, markers: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(m)})" for m in markers) + ")"


def punctuation(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{M.PUNCTUATION}]'))"


def top_char_share(x: str) -> str:
    d = f"regexp_replace({x}, '[{BLANK}]+', '', 'g')"
    return f"(case when {d} = '' then 1.0::double else list_max(list_transform(list_distinct(string_split({d}, '')), lambda c: length({d}) - length(replace({d}, c, '')))) / length({d})::double end)"


def paragraphs(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[。！？\\n]'), lambda p: {strip('p')} <> ''))"


def letters_only(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]+', '', 'g')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[。！？!?；;\\n]+'), lambda s: {letters_only('s')}), lambda s: s <> '')"


def lenient(conv: str) -> str:
    turn = f"{{'from': {key('coalesce(x.\"from\", chr(32))')}, 'value': {collapse('x.\"value\"')}}}"
    return f"list_filter(list_transform(coalesce({conv}, []), lambda x: {turn}), lambda y: y.\"from\" <> '' and y.\"value\" <> '')"


def digest(conv: str) -> str:
    return f"sha1(array_to_string(list_transform({conv}, lambda x: x.\"from\" || chr(31) || x.\"value\" || chr(30)), ''))"


def band(v: str, low: int, high: int, hard_low: int, hard_high: int) -> str:
    return f"(case when {v} < {hard_low} or {v} > {hard_high} then 0.0 when {v} between {low} and {high} then 1.0 when {v} < {low} then ({v} - {hard_low})::double / {max(1, low - hard_low)} else ({hard_high} - {v})::double / {max(1, hard_high - high)} end)"
