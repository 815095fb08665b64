import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.functions import answers as A
from dialoom.operators import judging


def test_pairing_against_enumeration():
    rng = random.Random(6)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        g = np.array([[rng.random() for _ in range(m)] for _ in range(n)])
        small, big = (g, m) if n <= m else (g.T, n)
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))
        assert A.best_pairing(g) == pytest.approx(best)
    assert A.best_pairing(np.zeros((0, 0))) == 0.0


def test_bags_and_encryption(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]], [["c"], ["a"]], "snow 雪"), (None, [["c"]], None)], "f array<array<string>>, w array<array<string>>, t string")
    rows = df.select(A.bags_f1("f", "w").alias("f1"), A.decrypted(A.locked("t", F.lit("k")), F.lit("k")).alias("t")).collect()
    assert rows[0]["f1"] == pytest.approx(83.33) and rows[1]["f1"] == 0.0
    assert rows[0]["t"] == "snow 雪" and rows[1]["t"] is None


def test_usage_layouts(spark):
    df = spark.createDataFrame([('{"prompt_tokens": 3, "completion_tokens": 4}',), ('{"input_tokens": 5, "output_tokens": 6, "total_tokens": 12, "input_tokens_details": {"cached_tokens": 2}}',), (None,)], "u string")
    rows = [tuple(r["u"]) for r in df.select(A.usage(F.col("u")).alias("u")).collect()]
    assert rows == [(3, None, 4, None, 7), (5, 2, 6, None, 12), (None,) * 5]


def test_loose_equality_and_keys(spark):
    df = spark.createDataFrame([("The Big-House", "big house!", True), ("", "", True), ("x", "", False), ("a cat", "dog", False)], "a string, b string, e boolean")
    assert all(r["v"] == r["e"] for r in df.select("e", A.loosely_equal(F.col("a"), F.col("b")).alias("v")).collect())
    r = spark.range(1).select(A.metric_key(F.lit("t:c:x y")).alias("a"), A.metric_key(F.lit("t")).alias("b")).first()
    assert tuple(r["a"]) == ("t", "c", "x y") and tuple(r["b"]) == ("t", None, None)


def test_judge_retries_and_splits(spark):
    calls = []

    def weak(items):
        calls.append(len(items))
        if len(items) > 1:
            raise OSError
        return judging.stub_judge(items)

    items = [("c", str(i)) for i in range(3)]
    assert judging.retried(weak, items, 2) == judging.stub_judge(items) and calls == [3, 3, 1, 1, 1]
    with pytest.raises(RuntimeError):
        judging.retried(lambda x: 1 / 0, items[:1], 2)
    df = spark.createDataFrame([("c", "t"), (None, None)], "c string, t string")
    assert [r["met"] for r in judging.judged(df, "c", "t", lambda: judging.stub_judge, at_once=1).collect()] == judging.stub_judge([("c", "t"), ("", "")])
    assert judging.judged(df.limit(0), "c", "t", lambda: judging.stub_judge).count() == 0
