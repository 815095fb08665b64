import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialoom.functions import conversation as C
from dialoom.functions import markers as M
from dialoom.functions import rewards, slices
from dialoom.functions import text as T

TEXTS = ["", " 　 \x1c\x85 x  y\r\nz﻿ ", "é👍𠮷", "aaaa", "首先，可能。其次；最后！", "a.b.a.b.", "多喝水。多喝水。休息", "x\n\nx\ny", "Hello,  World 12.50 and 3", "哈"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string").cache()


def value(df, c):
    return {r["i"]: r["v"] for r in df.select("i", c.alias("v")).collect()}


def test_white_space(texts):
    got = value(texts, T.collapse(F.col("t")))
    assert all(got[i] == " ".join(t.split()) for i, t in enumerate(TEXTS)) and got[99] == ""
    got = value(texts, T.clean(F.col("t")))
    assert all(got[i] == t.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n").strip() for i, t in enumerate(TEXTS)) and got[99] == ""


def test_shares(texts):
    chars, lines = value(texts, T.top_char_share(F.col("t"))), value(texts, T.top_line_share(F.col("t")))
    for i, t in enumerate(TEXTS):
        dense = "".join(t.split())
        assert chars[i] == pytest.approx(max(Counter(dense).values()) / len(dense) if dense else 1.0)
        own = [x.strip() for x in re.split("\r\n|[\r\n]", t) if x.strip()]
        assert lines[i] == pytest.approx(max(Counter(own).values()) / len(own) if len(own) > 1 else 0.0)


def test_sentences_and_bigrams(texts):
    rep, grams = value(texts, T.repeated_sentences(F.col("t"))), value(texts, T.bigrams(F.col("t")))
    for i, t in enumerate(TEXTS):
        letters = lambda x: re.sub("[^一-鿿A-Za-z0-9]+", "", x.lower())
        s = [x for x in map(letters, re.split("[。！？!?；;\n]+", t)) if x]
        assert rep[i] == pytest.approx((len(s) - len(set(s))) / len(s) if len(s) > 1 else 0.0)
        x = letters(t)
        assert grams[i] == ([x[j : j + 2] for j in range(len(x) - 1)] if len(x) > 1 else [x] if x else [])
    assert rep[6] == pytest.approx(1 / 3)


@pytest.mark.parametrize("a, b", [("aabbc", "abbbd"), ("aaaa", "aa"), ("", "abc"), ("你好你好", "你好")])
def test_bag_overlap(spark, a, b):
    got = spark.range(1).select(T.bag_overlap_f1(T.bigrams(F.lit(a)), T.bigrams(F.lit(b))).alias("v")).first()["v"]
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    common = sum((x & y).values())
    assert got == pytest.approx(2 * common / (sum(x.values()) + sum(y.values())) if common else 0.0)


def test_small_extractors(spark):
    df = spark.createDataFrame([("a: Answer is (B)", "x 1,234.50 then 7.10", "Theme:Big_one", "```python\nx = 1\n```", "ok {\"a\": 1} end", "My  Name! 你好")], "a string, n string, t string, c string, j string, s string")
    r = df.select(T.answer_letter(F.col("a")).alias("a"), T.last_number(F.col("n")).alias("n"), T.tag_title(F.col("t")).alias("t"), T.code_block(F.col("c")).alias("c"), T.json_object(F.col("j")).alias("j"), T.slug(F.col("s")).alias("s")).first()
    assert tuple(r) == ("B", "7.1", "Big one", "x = 1\n", '{"a": 1}', "my-name-你好")


CONVS = {
    "good": [("user", "问题是什么呢"), ("assistant", "这是一个足够长的回答，需要结合检查结果再判断，可以先观察两天。")],
    "system": [("system", "s"), ("human", "question"), ("gpt", "x" * 30 + ".")],
    "empty": [],
    "single": [("human", "alone")],
    "blank": [("human", "hello there"), ("gpt", " 　 ")],
    "order": [("gpt", "first"), ("human", "then this")],
    "role": [("human", "hello"), ("tool", "x")],
    "long": [("human" if i % 2 == 0 else "gpt", f"turn number {i}, fine") for i in range(13)],
}


@pytest.fixture(scope="module")
def convs(spark):
    rows = [(k, [{"from": a, "value": b} for a, b in v]) for k, v in CONVS.items()] + [("null", None)]
    return spark.createDataFrame(rows, f"k string, c {C.CONV}")


def test_strict_validation(convs):
    got = {r["k"]: r["e"] for r in convs.select("k", C.strict_error(F.col("c")).alias("e")).collect()}
    assert got["good"] is None and got["system"] is None
    assert (got["empty"], got["null"], got["blank"], got["role"], got["order"], got["long"], got["single"]) == ("empty conversation", "empty conversation", "empty value", "unknown role", "roles out of order", "incomplete exchange", "incomplete exchange")


def test_rule_reasons(convs):
    got = {r["k"]: r["r"] for r in convs.select("k", C.rule_reasons(C.lenient(F.col("c"))).alias("r")).collect()}
    assert got["empty"] == got["null"] == ["empty_conversations"] and got["single"] == got["blank"] == ["too_few_turns"]
    assert {"odd_turn_count", "role_order_invalid"} <= set(got["system"])  # a leading system turn passes the strict check but not the rules
    assert {"too_many_turns", "odd_turn_count"} <= set(got["long"])


def test_quality_bounds(spark):
    a = "首先，建议门诊复查。其次，可能需要结合检查。" * 5
    df = spark.createDataFrame([("胸痛三天了怎么办呢请问医生", a), ("胸痛三天了怎么办呢请问医生", "多喝水。")], "q string, a string")
    rows = df.select(*[c.alias(k) for k, c in C.quality_features(F.col("q"), F.col("a")).items()]).withColumn("total", C.quality_total()).collect()
    assert rows[0]["referral_score"] == 0.6 and rows[0]["total"] <= 0.748
    assert rows[1]["high_risk_no_referral_penalty"] == 1.0 and rows[1]["low_signal_penalty"] == 0.45 and rows[1]["total"] == 0.0 or rows[1]["total"] >= 0


def test_rewards_and_slices(spark):
    df = spark.createDataFrame([("我胸痛，担心", "先别慌，建议立即去急诊。", ["emergency"], [], "high", "建议急诊", None), ("", "", None, None, None, None, None)], "prompt_text string, completion string, slice_tags array<string>, hard_constraints array<string>, risk_level string, reference_answer string, negative_reference_answer string")
    rows = df.select(*[f().alias(k) for k, f in rewards.REWARDS.items()]).collect()
    assert rows[0]["emergency_referral"] == 0.85 and rows[0]["safety_penalty"] == -0.55 + 0.55 - (0.55 if len("先别慌建议立即去急诊") < 18 else 0)
    assert rows[1]["communication"] == -1.0 and rows[1]["reference_alignment"] == 0.0
    q = spark.createDataFrame([("我胸痛，怎么办", 1, "x", None, None, None), (None, 0, None, None, None, None)], "q string, n int, s string, r string, t array<string>, i array<string>")
    f = slices.scores(F.col("q"), F.col("n"), F.col("s"), F.col("r"), F.col("t"), F.col("i"), {})
    r = q.select(*[c.alias(k) for k, c in f.items()], slices.tags(f).alias("tags"), slices.risk(F.col("q"), f["emergency"]).alias("risk")).collect()
    assert r[0]["emergency"] == pytest.approx(1.4) and r[0]["risk"] == "high"
    assert r[1]["tags"] == [M.SLICES[0]] and r[1]["risk"] == "low"
