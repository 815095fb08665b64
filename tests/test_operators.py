import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from dialoom.operators import cutoffs, dedup, evaluation, joins, ngrams, prefix, quotas, vectors
from dialoom.operators.components import connected_components
from dialoom.plans import analysis


def test_cutoffs_against_sorting(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, 0.5, 0.5, 1.0, rng.random(), 0.123456789])) for g in "abc" for _ in range(rng.choice([1, 40, 300]))] + [("hot", 0.25)] * 500
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in cutoffs.group_cutoffs(df, ["g"], "v", F.ceil(F.col("n") * 0.3), bits=3, levels=2).collect()}
    for g in {r[0] for r in rows}:
        values = sorted((v for h, v in rows if h == g), reverse=True)
        k = math.ceil(len(values) * 0.3)
        cut = values[k - 1]
        assert (got[g]["n"], got[g]["k"], got[g]["cutoff"], got[g]["n_kept"], got[g]["n_above"]) == (len(values), k, cut, sum(v >= cut for v in values), sum(v > cut for v in values))


def test_cutoffs_of_nothing(spark):
    assert cutoffs.group_cutoffs(spark.createDataFrame([], "g string, v double"), ["g"], "v", F.col("n")).count() == 0
    assert cutoffs.group_cutoffs(spark.createDataFrame([("a", 0.1)], "g string, v double"), ["g"], "v", F.lit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 230)] + [(300, x) for x in range(301, 340)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_offsets(spark):
    rng = random.Random(1)
    rows = [("g" if rng.random() < 0.7 else "h", i, rng.randrange(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = prefix.running_offsets(df, ["g"], F.xxhash64("i"), "v", tie="i", bits=3).withColumn("o", F.xxhash64("i")).collect()
    for g in "gh":
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["v"] for r in own)][:-1]
        unsigned = [r["o"] % 2**64 for r in own]
        assert unsigned == sorted(unsigned)


def test_share_out():
    sizes = {"a": 70, "b": 20, "c": 10, "d": 1}
    for total in (0, 1, 10, 50, 101, 500):
        q = quotas.share_out(sizes, total)
        assert sum(q.values()) == min(total, 101) and all(q[k] <= sizes[k] for k in q)
    assert quotas.share_out({}, 5) == {}


@pytest.mark.parametrize("total", [3000, 300, 7, 1000])
def test_scaled_targets(total):
    t = {"a": 900, "b": 700, "c": 600, "d": 450, "e": 350}
    s = quotas.scaled(t, total)
    assert sum(s.values()) == total and min(s.values()) >= 1
    if total == 3000:
        assert s == t
    if total == 300:
        assert s == {"a": 90, "b": 70, "c": 60, "d": 45, "e": 35}


def test_keyed_dedup_keeps_blank_keys(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, ""), (4, ""), (5, None)], "i int, k string")
    assert sorted(r["i"] for r in dedup.keyed(df, "k", "i", "last").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["i"] for r in dedup.keyed(df, "k", "i").collect()) == [0, 1, 3, 4, 5]
    assert {r["i"] for r in dedup.latest(df, "k", [F.col("i")]).collect()} == {1, 2, 4, 5}


def test_rubric_score_golden(spark):
    df = spark.createDataFrame([(7.0, True), (5.0, False), (10.0, True), (-6.0, True)], "p double, m boolean")
    assert df.agg(evaluation.rubric_score(F.col("p"), F.col("m")).alias("s")).first()["s"] == 0.5
    assert df.where("p < 0").agg(evaluation.rubric_score(F.col("p"), F.col("m")).alias("s")).first()["s"] is None


def test_agreement_by_pairs(spark):
    rng = random.Random(9)
    rows = [(c, f"{c}{i}", r, rng.random() < 0.6) for c in "ab" for i in range(12) for r in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "c string, item string, r int, label boolean")
    got = {(x["c"], x["metric"], x["positive"]): (x["n"], round(x["value"], 9)) for x in evaluation.pairwise_agreement(df, "item", "r", "label", ["c"]).collect()}
    want = {}
    for c in "ab":
        pairs = [(a[3], b[3]) for a in rows for b in rows if a[0] == b[0] == c and a[1] == b[1] and a[2] != b[2]]
        for m, at in (("precision", 0), ("recall", 1)):
            for label in (True, False):
                own = [x == y for x, y in pairs if (x, y)[at] == label]
                if own:
                    want[c, m, label] = (len(own), round(sum(own) / len(own), 9))
    assert got == want


@pytest.mark.parametrize("k", [1, 2, 3])
def test_worst_at_k_by_enumeration(spark, k):
    scores = [0.2, 0.6, 0.4]
    df = spark.createDataFrame([("m", "e", s) for s in scores], "m string, e string, s double")
    got = {r["k"]: r["value"] for r in evaluation.worst_at_k(df, ["m"], "e", "s", 4).collect()}
    subsets = list(itertools.combinations(scores, k))
    assert got[k] == pytest.approx(sum(map(min, subsets)) / len(subsets)) and 4 not in got
    assert sum(w * s for w, s in zip(evaluation.worst_weights(3, k), sorted(scores))) == pytest.approx(got[k])


def test_win_rate_length_control(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 100), ("b", 1, 0.1, 120), ("a", 2, 0.1, 100), ("b", 2, 0.4, 101)], "m string, e int, s double, l int")
    free = {(r["model"], r["other"]): r["value"] for r in evaluation.win_rates(df, "m", "e", "s").collect()}
    tied = {(r["model"], r["other"]): r["value"] for r in evaluation.win_rates(df, "m", "e", "s", "l").collect()}
    assert free["a", "b"] == 0.5 and tied["a", "b"] == 0.0


def test_running_record(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, 3.0, None, 2.0, 5.0])], "i int, v double")
    assert [r["i"] for r in evaluation.running_record(df, [], [F.col("i")], "v").collect()] == [0, 1, 5]


def grouped(rng, n=400):
    return [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, float(rng.randrange(30)), rng.random()])) for i in range(n)]


@pytest.mark.parametrize("best", ["max", "min"])
def test_running_record_in_parts(spark, best):
    rows = grouped(random.Random(3))
    got = {r["i"] for r in evaluation.running_record(spark.createDataFrame(rows, "i int, g string, v double").repartition(7), ["g"], [F.col("i")], "v", best).collect()}
    want, seen = set(), {}
    for i, g, v in rows:
        if v is not None and (g not in seen or (v > seen[g] if best == "max" else v < seen[g])):
            seen[g] = v
            want.add(i)
    assert got == want


def test_mid_ranks(spark):
    rows = [r for r in grouped(random.Random(4)) if r[1]]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(5)
    for by in ([], ["g"]):
        for r in evaluation.mid_ranks(df, by, "v").collect():
            own = [v for _, g, v in rows if v is not None and (not by or g == r["g"])]
            assert r["rank"] == sum(v < r["v"] for v in own) + (sum(v == r["v"] for v in own) + 1) / 2 and r["all"] == len(own)


def test_first_rows_of_a_quota(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), rng.random()) for i in range(300)]
    got = {r["i"] for r in quotas.by_quota(spark.createDataFrame(rows, "i int, g string, v double"), "g", {"a": 40, "b": 7, "none": 3}, [F.desc("v"), F.col("i")]).collect()}
    best = lambda g, n: {r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:n]}
    assert got == best("a", 40) | best("b", 7)


def test_repeats_are_marked_but_the_first(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", f"k{i % 9}", None]), rng.choice([[], [], ["bad"]])) for i in range(200)]
    rng.shuffle(rows)
    got = {r["i"]: r["reasons"] for r in dedup.mark_duplicates(spark.createDataFrame(rows, "i int, k string, reasons array<string>"), "k", "reasons", "i").collect()}
    first = {}
    for i, k, reasons in sorted(rows, key=lambda r: r[0]):
        want = reasons or ([] if first.setdefault(k, i) == i else ["duplicate_conversation"])
        assert got[i] == want


def test_split_and_scaled_quotas():
    assert quotas.split(10, {"b": 0.25, "a": 0.75}) == {"a": 8, "b": 2} and quotas.split(5, {"a": 0.5, "b": 0.5}) == {"a": 3, "b": 2}
    assert quotas.split(3, {"a": 0.5, "b": 0.5}) == {"a": 1, "b": 2} and quotas.split(0, {}) == {}
    assert quotas.scaled({"a": 3, "b": 1}, 0) == {"a": 0, "b": 0} and quotas.scaled({"a": 900, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 1}


def chosen_one_by_one(rows, quota, ratios, taken):
    """The greedy selection over Python lists: rows are (key, slices, source, score)."""
    used, out = set(taken), []
    free = [r for r in rows if r[0] not in used]
    count = lambda k: sum(s == k for _, s in out)
    for k in sorted(quota, key=lambda k: (sum(k in r[1] for r in free) / max(quota[k], 1), k)):
        order = sorted((r for r in free if k in r[1]), key=lambda r: (-r[3], r[0]))
        for source, n in quotas.split(quota[k], ratios[k]).items():
            for r in [r for r in order if r[2] == source and r[0] not in used][:n]:
                used.add(r[0])
                out.append((r[0], k))
        for r in [r for r in order if r[0] not in used][: quota[k] - count(k)]:
            used.add(r[0])
            out.append((r[0], k))
    for r in sorted((r for r in free if r[0] not in used), key=lambda r: (-r[3], r[0]))[: sum(quota.values()) - len(out)]:
        under = [s for s in r[1] if count(s) < quota.get(s, 0)]
        out.append((r[0], max(under, key=lambda s: quota[s] - count(s)) if under else r[1][0]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_selection_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(i, sorted({rng.choice("abc"), rng.choice("abcd")}), rng.choice("xxy"), round(rng.random(), 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s array<string>, src string, v double")
    ratios = {k: {"x": 0.3, "y": 0.7} for k in "abc"}
    order = [F.desc("v"), F.col("id")]
    pick = lambda quota, taken=None: quotas.greedy_slices(df, "id", "s", quota, order, source="src", ratios=ratios, rest=order, taken=taken)
    for quota in ({"a": 20, "b": 10, "c": 12}, {"a": 2, "b": 3, "c": 70}):
        first = pick(quota)
        assert sorted(map(tuple, first.collect())) == (want := chosen_one_by_one(rows, quota, ratios, set()))
        again = pick({"a": 3, "b": 3, "c": 3}, first)
        assert sorted(map(tuple, again.collect())) == chosen_one_by_one(rows, {"a": 3, "b": 3, "c": 3}, ratios, {k for k, _ in want})
    assert quotas.greedy_slices(df.limit(0), "id", "s", {"a": 2}, order, rest=order).count() == 0


def test_joins(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("x", 50)], "k string, v int")
    small = spark.createDataFrame([("hot", 1), ("y", 2)], "k string, w int")
    assert joins.salted_join(big, small, "k", 4).count() == 50
    assert joins.salted_join(big, small, "k", 4, "left_anti").count() == 1
    state = {r["k"]: r["state"] for r in joins.completeness(small, big, "k").collect()}
    assert state == {"hot": "repeated", "x": "unexpected", "y": "missing"}
    assert joins.positional(big.limit(2), small).count() == 2
    with pytest.raises(ValueError):
        joins.positional(big, small)


def test_bootstrap_spread(spark):
    df = spark.createDataFrame([("m", i, float(i % 2)) for i in range(400)], "m string, _id long, s double")
    assert evaluation.bootstrap_std(df, ["m"], "s", rounds=100).first()["std"] == pytest.approx(0.025, rel=0.35)


@pytest.mark.parametrize("size", [None, "l"])
def test_win_rates_against_pairs(spark, size):
    rng = random.Random(4)
    rows = [(m, e, rng.choice([None, 0.0, 0.2, 0.4, 0.6, 1.0]), rng.choice([None, 0, 19, 20, 21, rng.randrange(60)])) for m in "abc" for e in range(5) for _ in range(rng.randrange(1, 40))]
    got = {(r["model"], r["other"]): r["value"] for r in evaluation.win_rates(spark.createDataFrame(rows, "m string, e int, s double, l int"), "m", "e", "s", size).collect()}
    for m, o in itertools.permutations("abc", 2):
        shares = []
        for e in range(5):
            pairs = [(x, y) for x in rows for y in rows if (x[0], y[0]) == (m, o) and x[1] == y[1] == e and None not in (x[2], y[2]) and x[2] != y[2]]
            if size:
                pairs = [(x, y) for x, y in pairs if None not in (x[3], y[3]) and x[3] + y[3] > 0 and abs(x[3] - y[3]) <= 0.1 * ((x[3] + y[3]) / 2)]
            if pairs:
                shares.append(sum(x[2] > y[2] for x, y in pairs) / len(pairs))
        assert got[m, o] == pytest.approx(sum(shares) / len(shares))


def test_truncated_svd_spans_the_largest_directions(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((60, 30)) < 0.3) * rng.random((60, 30)) * 0.9 ** np.arange(30)
    df = spark.createDataFrame([(i, Vectors.sparse(30, {int(j): float(r[j]) for j in np.flatnonzero(r)})) for i, r in enumerate(a)], ["i", "v"])
    got = np.array([r["reduced"].toArray() for r in vectors.truncated_svd(df, "v", 5, rounds=20).orderBy("i").collect()])
    u, size, _ = np.linalg.svd(a, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :5] * size[:5]), abs=1e-6)
    assert len(vectors.truncated_svd(df.limit(20), "v", 64).first()["reduced"]) == 19


def test_tfidf_clusters_are_the_whole_job(spark, small, monkeypatch):
    seen = {}
    monkeypatch.setattr(vectors, "CountVectorizer", lambda **x: seen.update(x) or CountVectorizer(**x))
    rows = analysis.queries()["tfidf_clusters"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text <> ''")
    assert seen["vocabSize"] == 12_000 and len(rows) == 24 and sum(r["n"] for r in rows) == docs.count()


@pytest.mark.parametrize("features, least", [(60, 2), (60, 5), (700, 2), (100_000, 1)])
def test_tfidf_is_that_of_count_vectorizer(spark, features, least):
    rng = random.Random(3)
    words = ["aa", "ab\0", "Fieber", "头疼。", "😀x", "\U00020041b", "ü", "  ", "\u3000", "e", "aaaaaa", "Ｘ\n"]
    texts = ["".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(60))) + "zq" for _ in range(150)] + ["", "a", "zq" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(5)
    counts = {r["i"]: Counter(r["t"][a : a + n] for n in (2, 3, 4) for a in range(len(r["t"]) - n + 1)) for r in df.select("i", ngrams.folded(F.col("text")).alias("t")).collect()}
    texts_with = Counter(g for c in counts.values() for g in c)
    total = Counter()
    for c in counts.values():
        total.update({g: x for g, x in c.items() if least <= texts_with[g] <= 0.95 * len(texts)})
    packed = vectors.ngrams_counted(df, "text", features=features, least=least)
    known = {int(c): g for g in texts_with for _, c, _ in ngrams.codes_of(pa.array([g])) for c in c[-1:]}
    assert len(known) == len(texts_with)
    place = [known.get(int(c)) for c in packed.codes]
    vocabulary = [g for g, x in zip(place, packed.chosen) if x]
    assert sorted(total[g] for g in vocabulary) == sorted(total.values())[-features:]
    for r in vectors.tfidf(df, "text", features=features, least=least).collect():
        want = {g: (1 + np.log(counts[r["i"]][g])) * np.log((len(texts) + 1) / (texts_with[g] + 1)) for g in vocabulary if g in counts[r["i"]]}
        norm = np.linalg.norm(list(want.values())) or 1
        assert {vocabulary[j]: x for j, x in zip(r["tfidf"].indices, r["tfidf"].values)} == pytest.approx({g: x / norm for g, x in want.items()})


def test_reduced_ngrams_span_the_largest_directions(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "".join(rng.choices("abcdef ", k=rng.randrange(90)))) for i in range(400)], "i int, text string")
    a = np.array([r["tfidf"].toArray() for r in vectors.tfidf(df, "text", features=300).orderBy("i").collect()])
    size = np.linalg.svd(a, compute_uv=False)
    got = np.array([r["reduced"].toArray() for r in vectors.ngrams_reduced(vectors.ngrams_counted(df, "text", features=300), 8, rounds=12).orderBy("i").collect()])
    assert np.linalg.norm(got, axis=0) == pytest.approx(size[:8], rel=1e-3)
    assert np.abs(got.T @ got - np.diag(size[:8] ** 2)).max() < 1e-3


def test_ngrams_of_long_texts_take_linear_time(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "".join(rng.choices("abcdefghijklmnop ", k=300_000))) for i in range(4)], "i int, text string")
    began = time.time()
    assert vectors.tfidf(df, "text").where("tfidf is not null").count() == 4
    assert time.time() - began < 60


def test_bootstrap_takes_a_thousand_rounds(spark):
    df = spark.createDataFrame([("m", i, float(i % 2)) for i in range(400)], "m string, _id long, s double")
    std = evaluation.bootstrap_std(df, ["m"], "s").first()["std"]
    assert std == evaluation.bootstrap_std(df, ["m"], "s", rounds=1000).first()["std"] == pytest.approx(0.025, rel=0.1)
