"""Model-backed operators with a pluggable client: judging rubric items and rewriting pairs, batch by batch."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as t

#: A client maps (criterion, text) pairs to verdicts.
Client = Callable[[list[tuple[str, str]]], list[bool]]


def stub_judge(items: list[tuple[str, str]]) -> list[bool]:
    """A deterministic stand-in: a verdict by the hash of criterion and text."""
    return [hashlib.md5(f"{c}|{t}".encode()).hexdigest() < "8" for c, t in items]


def retried(client: Client, items: list[tuple[str, str]], tries: int = 3, wait_s: float = 0.0) -> list[bool]:
    """Calls the client again after an error; a batch that keeps failing is sent one by one."""
    for attempt in range(tries):
        try:
            return client(items)
        except Exception:
            if attempt + 1 < tries:
                time.sleep(wait_s * 2**attempt)
    if len(items) == 1:
        raise RuntimeError("the client kept failing")
    return [v for x in items for v in retried(client, [x], tries, wait_s)]


def judged(df: DataFrame, criterion: str, text: str, make_client: Callable[[], Client], *, at_once: int | None = None, batch: int = 64) -> DataFrame:
    """``df`` with ``met``. One client per task; ``at_once`` bounds the tasks that call at a time."""
    out = t.StructType([*df.schema.fields, t.StructField("met", t.BooleanType())])

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for part in parts:
            items = list(zip(part[criterion].fillna("").astype(str), part[text].fillna("").astype(str)))
            met = [v for i in range(0, len(items), batch) for v in retried(client, items[i : i + batch])]
            yield part.assign(met=met)

    return (df.coalesce(at_once) if at_once else df).mapInPandas(judge, out)


#: A model maps prompts to replies.
Model = Callable[[list[str]], list[str]]

JUDGE_PROMPT = """Below are a conversation and one item of a rubric. Judge the last turn of the conversation by the item.

Conversation:
{conversation}

Rubric item:
{criterion}

Answer with one JSON object with the fields "explanation" (a string) and "criteria_met" (true or false).
Say true only if every part of the item is met. An item with negative points describes what should not happen: say true if it does happen."""


def judge_prompt(conversation: str, criterion: str) -> str:
    return JUDGE_PROMPT.format(conversation=conversation, criterion=criterion)


def verdict(reply: str | None) -> tuple[bool, str]:
    """``criteria_met, explanation`` of a reply: its outermost object, fences dropped; an error unless the verdict is a boolean."""
    found = re.search(r"\{.*\}", re.sub(r"```(?:json)?", "", reply or ""), re.S)
    data = json.loads(found.group()) if found else {}
    if not isinstance(data.get("criteria_met"), bool):
        raise ValueError("no verdict in the reply")
    return data["criteria_met"], str(data.get("explanation", ""))


def stub_model(prompts: list[str]) -> list[str]:
    """A deterministic stand-in that judges by the hash of the prompt and replies in a fence."""
    return ["```json\n" + json.dumps({"explanation": "by hash", "criteria_met": hashlib.md5(p.encode()).hexdigest() < "8"}) + "\n```" for p in prompts]


def model_judge(model: Model, tries: int = 3) -> Client:
    """A client that asks a model; a reply without a verdict is asked again, then it is an error."""

    def client(items: list[tuple[str, str]]) -> list[bool]:
        out: dict[int, bool] = {}
        for _ in range(tries):
            left = [i for i in range(len(items)) if i not in out]
            for i, reply in zip(left, model([judge_prompt(items[i][1], items[i][0]) for i in left])) if left else ():
                try:
                    out[i] = verdict(reply)[0]
                except ValueError:
                    pass
        if len(out) < len(items):
            raise RuntimeError("no verdict")
        return [out[i] for i in range(len(items))]

    return client


def stub_rewriter(items: list[dict]) -> list[dict]:
    """A deterministic stand-in for rewriting pairs: white space collapsed; it takes no batch that holds a text with "boom"."""
    if len(items) > 1 and any("boom" in x["chosen"] for x in items):
        raise RuntimeError("batch refused")
    return [{"sample_id": x["sample_id"], "chosen": " ".join(x["chosen"].split()), "rejected": " ".join(x["rejected"].split())} for x in items]


def rewritten(df: DataFrame, key: str, chosen: str, rejected: str, make_client: Callable[[], Callable[[list[dict]], list[dict]]], *, batch: int = 8, per_second: float | None = None, at_once: int | None = None) -> DataFrame:
    """``key, chosen, rejected, error``: both sides rewritten by a client, batch by batch.

    A batch that fails, or whose replies are not exactly its keys, is sent one by
    one; a single row that fails keeps its texts and has the ``error``.
    ``per_second`` limits the calls of a task, ``at_once`` the tasks that call.
    """
    schema = t.StructType([df.schema[key], t.StructField("chosen", t.StringType()), t.StructField("rejected", t.StringType()), t.StructField("error", t.StringType())])

    def rewrite(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, last = make_client(), [0.0]

        def call(items: list[dict]) -> list[tuple]:
            if per_second:
                time.sleep(max(0.0, last[0] + 1 / per_second - time.monotonic()))
                last[0] = time.monotonic()
            try:
                by = {r["sample_id"]: r for r in client(items)}
                if set(by) != {x["sample_id"] for x in items}:
                    raise ValueError("the replies are not those of the batch")
                return [(x["sample_id"], by[x["sample_id"]]["chosen"], by[x["sample_id"]]["rejected"], None) for x in items]
            except Exception as e:
                if len(items) == 1:
                    return [(items[0]["sample_id"], items[0]["chosen"], items[0]["rejected"], f"{type(e).__name__}: {e}")]
            return [row for x in items for row in call([x])]

        for part in parts:
            items = [{"sample_id": k, "chosen": c or "", "rejected": r or ""} for k, c, r in zip(part[key], part[chosen], part[rejected])]
            rows = [row for i in range(0, len(items), batch) for row in call(items[i : i + batch])]
            yield pd.DataFrame(rows, columns=[key, "chosen", "rejected", "error"])

    return (df.coalesce(at_once) if at_once else df).select(key, chosen, rejected).mapInPandas(rewrite, schema)
