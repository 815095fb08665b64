"""Records of several layouts as one: formats, contents, histories, graded items, typed answers, names."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from dialoom.functions import conversation as C
from dialoom.functions import text as T

# How "answer" is written before the letter of a choice, and the letters of other scripts.
ANSWER_WORDS = (
    "Answer উত্তর उत्तर উত্তরঃ Antwort 답변 정답 답 答案 答 答复 答曰 الإجابة الجواب إجابة الإجابة_النهائية الإجابة_الصحيحة الإجابة_الصحيحة_هي الإجابة_هي الجواب_النهائي"
    " Respuesta Risposta 答え 回答 解答 Jawaban Réponse Resposta Jibu Idahun Ìdáhùn Idáhùn Àmọ̀nà Àdáhùn Ànúgọ Àṣàyàn"
).replace("_", "\u0001").split()
CHOICE_LETTERS = {"أ": "A", "ب": "B", "ج": "C", "د": "D", "অ": "A", "ব": "B", "ড": "C", "ঢ": "D", "Ａ": "A", "Ｂ": "B", "Ｃ": "C", "Ｄ": "D"}


def record_format(df: DataFrame) -> Column:
    """``dialogue`` where there are conversations, ``instruction`` where an instruction and an output are given, else null."""
    has = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    return F.when(has("conversations"), "dialogue").when(has("instruction") & has("output"), "instruction")


def dispatched(df: DataFrame) -> DataFrame:
    """``df`` with ``format``, the normalised ``record`` or the ``error`` that keeps it from being one; never both."""
    get = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    conv, ask, more, out = get("conversations", C.CONV), get("instruction", "string"), get("input", "string"), get("output", "string")
    rows = df.withColumn("format", record_format(df))
    made = C.from_instruction(ask, more, out)
    error = F.when(F.col("format") == "dialogue", C.strict_error(conv)).when(F.col("format") == "instruction", F.when(made.isNull(), "empty side")).otherwise("unknown format")
    record = F.when(F.col("format") == "dialogue", C.strict(conv)).when(F.col("format") == "instruction", made)
    return rows.withColumn("error", error).withColumn("record", F.when(F.col("error").isNull(), record))


def _flat(x) -> str:
    if isinstance(x, dict):
        return _flat(x.get("text", x.get("content")))
    if isinstance(x, list):
        return "\n".join(part for part in map(_flat, x) if part)
    return "" if x is None else str(x).strip()


@F.pandas_udf(t.StringType())
def flat_content(contents: pd.Series) -> pd.Series:
    """The text of a message's content given as JSON: strings, objects with ``text`` or ``content``, lists of them at any depth. What is no JSON is text."""

    def one(raw):
        if raw is None:
            return ""
        try:
            return _flat(json.loads(raw))
        except ValueError:
            return raw.strip()

    return pd.Series([one(x) for x in contents], dtype=object)


def chat_messages(system: Column, history: Column) -> Column:
    """A chat from an instruction and earlier messages (array of role, content): only users and assistants with text, the instruction first if there is one."""
    kept = F.filter(F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.struct(T.strip(m["role"]).alias("role"), T.strip(m["content"]).alias("content"))), lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))
    head = T.strip(F.coalesce(system, F.lit("")))
    return F.when(head != "", F.concat(F.array(F.struct(F.lit("system").alias("role"), head.alias("content"))), kept)).otherwise(kept)


def reference_of(conv: Column) -> Column:
    """Prompt, question and reference of a conversation: without system turns, the last turn an answer, the one before a question; else null."""
    turns = F.filter(conv, lambda x: x["from"] != "system")
    last, ask = F.try_element_at(turns, F.lit(-1)), F.try_element_at(turns, F.lit(-2))
    whole = F.struct(F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0))).alias("prompt"), ask["value"].alias("question"), last["value"].alias("reference"))
    return F.when((last["from"] == "gpt") & (ask["from"] == "human"), whole)


def sole_tag(tags: Column, prefix: str) -> Column:
    """The one tag that begins with ``prefix``, without it; an error if there is none or more than one."""
    own = F.filter(tags, lambda x: x.startswith(prefix))
    return F.when(F.size(own) == 1, F.substr(own[0], F.lit(len(prefix) + 1))).otherwise(F.raise_error(F.concat(F.lit(f"not one {prefix} tag: "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ","))))


def tags_with(tags: Column, prefix: str) -> Column:
    """The tags that begin with ``prefix``, in order."""
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: x.startswith(prefix))


def display_name(key: Column, names: dict[str, str]) -> Column:
    """The name of a key, the key itself where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), key) if names else key


def graded(rubrics: Column, grades: Column) -> Column:
    """Rubric items beside their grades by position; an error if there are more of one."""
    return F.when(F.size(rubrics) == F.size(grades), F.arrays_zip(rubrics.alias("rubric"), grades.alias("grade"))).otherwise(F.raise_error(F.lit("rubrics and grades differ in number")))


def typed_answer(answer: Column) -> Column:
    """``values, kind`` of an answer object: a number, else spans, else a date; null if it has none of them."""
    j = F.from_json(answer, "number string, spans array<string>, date struct<day:string,month:string,year:string>")
    date = T.strip(F.concat_ws(" ", *(F.coalesce(j["date"][k], F.lit("")) for k in ("day", "month", "year"))))
    one = lambda values, kind: F.struct(values.alias("values"), kind.alias("kind"))
    number = (j["number"] != "") & ~j["number"].isin("0", "0.0")
    return F.when(number, one(F.array(j["number"]), F.lit("number"))).when(F.size(j["spans"]) > 0, one(j["spans"], F.when(F.size(j["spans"]) == 1, "span").otherwise("spans"))).when(j["date"].isNotNull(), one(F.array(date), F.lit("date")))


def release_date(c: Column) -> Column:
    """A date written as year-month-day, year/month/day or day month year; null if it is none."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd", "yyyy/M/d", "d MMMM yyyy", "MMMM d, yyyy"))).cast("date")


def choice_letter(c: Column) -> Column:
    """The letter A-D after the first word for "answer" in any of ANSWER_WORDS, letters of other scripts as A-D; null without one."""
    words = "|".join(re.escape(w).replace("\u0001", r"\s*").replace("\\\u0001", r"\s*") for w in sorted(ANSWER_WORDS, key=len, reverse=True))
    found = F.upper(F.regexp_extract(c, rf"(?i)(?:{words})\s*[:：]?[ \t​]*\$?([A-D]|[{''.join(CHOICE_LETTERS)}])", 1))
    return F.nullif(F.translate(found, "".join(CHOICE_LETTERS), "".join(CHOICE_LETTERS.values())), F.lit(""))


def grade_letter(reply: Column, letters: str = "ABC", otherwise: str = "C") -> Column:
    """The first of the letters in a grader's reply."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), f"([{letters}])", 1), F.lit("")), F.lit(otherwise))


def says_yes(reply: Column) -> Column:
    """Whether a checker's reply is yes."""
    return F.coalesce(T.name_key(reply) == "yes", F.lit(False))


def token_proxy(c: Column) -> Column:
    """A cheap count of tokens: runs of Latin letters, single digits, characters of other scripts and marks."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\p{IsLatin}+|[0-9]|[^ \t\n\x0B\f\r])"), 1))


def within_length(df: DataFrame, text: Column, most: int, count=token_proxy) -> DataFrame:
    """Rows with ``n_tokens`` of at most ``most``; ``count`` gives the tokens of a text (any encoder as a Column)."""
    return df.withColumn("n_tokens", count(text)).where(F.col("n_tokens") <= most)


def number_slug(value: float) -> str:
    """A number for a path: six significant digits, p for the point, neg for the sign."""
    return f"{value:g}".replace("-", "neg").replace(".", "p")


def model_alias(model: str | None, adapter: str | None) -> str:
    """A short name: of the folder above an adapter, else of the model's path."""
    parts = [p for p in (adapter or "").rstrip("/").split("/") if p]
    name = (parts[-2] if len(parts) > 1 else parts[-1]) if parts else [p for p in (model or "").split("/") if p][-1:]
    name = name if isinstance(name, str) else (name[0] if name else "unknown-model")
    return re.sub("-+", "-", re.sub(r"[^\w\-]", "-", name.strip().lower())).strip("-")


def remaining(seconds: float) -> str:
    """Hours, minutes and seconds of an estimate, none below zero."""
    s = max(0, int(seconds))
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def warmup_steps(samples: int, per_device: int, devices: int, accumulation: int, epochs: float, ratio: float, most_steps: int = -1) -> int:
    """Optimizer steps of the warm-up: a share of all steps, each count rounded up to whole batches."""
    batch = max(1, max(1, per_device * devices) * accumulation)
    steps = most_steps if most_steps >= 0 else max(1, math.ceil(max(1, math.ceil(samples / batch)) * epochs))
    return max(0, int(steps * ratio))


def batch_for_groups(per_device: int, devices: int, group: int) -> int:
    """The least batch per device, from the wanted one up, that whole groups fill over all devices."""
    size = max(1, per_device)
    step = group // math.gcd(devices, group)
    return -(-size // step) * step
