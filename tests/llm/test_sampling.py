import random

import pytest
from conftest import same

from dialoom.llm import cutoff, mixture, proportions, queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, duck, name):
    same(queries.queries()[name](spark, small), duck, SQL[name])


CAND = "cand_id long, prompt_id string, source_dataset string, slice_tags array<string>, priority_score double, cells string, n int, quota int"


def candidates(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], CAND)


def targets(spark, rows):
    return spark.createDataFrame(rows, "slice_tag string, source_dataset string, target_per_mille int, min_rows int")


def test_sample_meets_quotas_and_prefers_priority(spark):
    rng = random.Random(2)
    rows = [(i, f"p{i % 900}", "d" if i % 3 else "e", [" A ", None, "", "b" if i % 2 else "zz"], rng.choice([1.0, 9.0])) for i in range(1000)]
    t = targets(spark, [("a", "d", 400, 5), ("b", "e", 100, 400), ("rare", "d", 1, 2)])
    c = candidates(spark, rows)
    report = {r["slice_tag"]: r for r in proportions.report(c, t).collect()}
    assert report["a"]["pool"] == 900 and report["a"]["required"] == 180 * 400 // 1000
    assert report["rare"]["available"] == 0 and report["rare"]["missing"] == 2 and report["b"]["missing"] > 0
    drawn = proportions.sample(c, t).collect()
    for tag, r in report.items():
        own = [x["prompt_id"] for x in drawn if x["slice_tag"] == tag]
        assert len(own) == len(set(own)) == r["quota"]
    high = [x for x in drawn if x["slice_tag"] == "a"]
    assert sum(x["priority_score"] == 9.0 for x in high) > 0.75 * len(high)
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, proportions.sample(c, t).collect()))
    assert {r["slice_tag"] for r in proportions.exhausted(c, t).collect()} == {"b", "rare"}


def test_proportions_of_nulls_and_nothing(spark):
    t = targets(spark, [("a", "d", 1000, 1), (None, "d", 5, 1), ("a", None, 5, 1)])
    rows = [(1, None, "d", ["a"], 1.0), (2, "p", None, ["a"], 1.0), (3, "q", "d", None, 1.0), (4, "r", "d", [], None), (5, "s", "d", ["a", "A"], float("nan")), (6, "s", "d", ["a"], 2.0)]
    got = proportions.report(candidates(spark, rows), t).collect()
    assert [(r["available"], r["pool"]) for r in got] == [(1, 3)]
    assert [r["prompt_id"] for r in proportions.sample(candidates(spark, rows), t).collect()] == ["s"]
    empty = candidates(spark, [])
    assert proportions.report(empty, t).first()["missing"] == 1 and proportions.sample(empty, t).count() == 0
    assert proportions.report(candidates(spark, rows), targets(spark, [])).count() == 0


def records(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "z") for r in rows], "record_id long, curation_source string, quality_score double, quality_bucket string, cutoff double, _score string")


def test_cutoffs_with_ties_and_odd_scores(spark):
    rows = [(i, " A " if i % 2 else "a", 0.5, "hi") for i in range(10)] + [(20 + i, "a", 0.9, None) for i in range(2)] + [(30, "a", None, "x"), (31, "a", float("nan"), "x"), (32, "a", 7.0, "x"), (33, "a", -1.0, "x"), (34, None, 0.4, "x"), (35, "b", 0.0, "x"), (36, "b", 1.0, "x"), (37, "c", 0.3, "x"), (38, "zero", 0.3, "x")]
    t = spark.createDataFrame([("A", 250), ("a", 100), ("b", 1000), ("none", 10), ("zero", 0), (None, 5)], "curation_source string, keep_per_mille int")
    got = {r["curation_source"]: (r["n_counted"], r["n_target"], r["cutoff"], r["n_kept"]) for r in cutoff.cutoffs(records(spark, rows), t).collect()}
    assert got == {"a": (12, 3, 0.5, 12), "b": (2, 2, 0.0, 2), "zero": (1, 0, None, 0)}
    assert {r["record_id"] for r in cutoff.kept(records(spark, rows), t).collect()} == {*range(10), 20, 21, 35, 36}
    assert sum(r["n_kept"] for r in cutoff.kept_sizes(records(spark, rows), t).collect()) == 14
    assert cutoff.kept(records(spark, []), t).count() == 0 and cutoff.kept(records(spark, rows), t.limit(0)).count() == 0


def within_a_block(given, block):
    """Blocks given so far against exact shares, as long as every source has whole blocks left to give."""
    total, order = sum(given.values()), mixture.schedule(given, block)
    seen = dict.fromkeys(given, 0)
    for t, (n, i) in enumerate(order, 1):
        assert i == seen[n]
        seen[n] += 1
        if t <= total // block:
            assert all(abs(given[k] * t - seen[k] * total) < total for k in given)
    assert seen == {k: -(-v // block) for k, v in given.items()}


def test_schedule_stays_within_a_block():
    rng = random.Random(4)
    for _ in range(20):
        within_a_block({f"s{i}": rng.randrange(1, 10 ** rng.randrange(1, 6)) for i in range(rng.randrange(1, 9))}, rng.choice([1, 7, 64]))
    assert mixture.schedule({}) == []


def test_schedule_of_equal_sources_never_drifts():
    within_a_block({"a": 333_350 * 3, "b": 333_350 * 3, "c": 333_300 * 3}, 10)
    within_a_block({"a": 200_001, "b": 3, "c": 1}, 2)


@pytest.mark.parametrize("priorities", [[0.0], [1e-3], [1e6], [0.0, -5.0], [1e-300, 1e300, float("inf")]])
def test_reservoirs_of_odd_priorities_are_uniform(spark, priorities):
    rows = [(i, f"p{i:05d}", "d", ["a"], priorities[i % len(priorities)]) for i in range(4000)]
    got = proportions.sample(candidates(spark, rows), targets(spark, [("a", "d", 0, 1000)])).collect()
    assert len({r["prompt_id"] for r in got}) == 1000 and len({r["reservoir_key"] for r in got}) == 1000
    if len(priorities) == 3:
        assert {r["priority_score"] for r in got} == {float("inf"), 1e300}
    else:  # no matter where the identifiers stand
        assert 350 < sum(r["prompt_id"] < "p02000" for r in got) < 650


def test_high_priorities_come_before_none(spark):
    rows = [(i, f"p{i:05d}", "d", ["a"], 2.0 if i % 4 == 0 else 0.0) for i in range(4000)]
    got = proportions.sample(candidates(spark, rows), targets(spark, [("a", "d", 0, 1200)])).collect()
    assert sum(r["priority_score"] == 2.0 for r in got) == 1000 and len(got) == 1200


def test_more_cells_than_are_broadcast(spark, monkeypatch):
    rows = [(i, f"p{i}", f"d{i % 7}", [f"t{i % 5}"], 1.0 + i % 3) for i in range(700)]
    t = targets(spark, [(f"t{i}", f"d{j}", 20, 3) for i in range(5) for j in range(7)])
    whole = sorted(map(tuple, proportions.sample(candidates(spark, rows), t).collect()))
    monkeypatch.setattr(proportions, "MAX_CELLS", 3)
    assert sorted(map(tuple, proportions.sample(candidates(spark, rows), t).collect())) == whole and len(whole) == 105


def test_parts_share_what_others_lack():
    total, given = mixture.parts([("a", 1.0, 100, 1), ("b", 1.0, 1000, 1), ("c", 2.0, 1000, 3), ("gone", 5.0, 0, 9)], 1200)
    assert total == 1200 and given["a"] == 100 and given["gone"] == 0 and abs(given["c"] - 2 * given["b"]) <= 2 and sum(given.values()) >= 1197
    assert mixture.parts([], None) == (0, {}) and mixture.parts([("a", 1.0, 10, 2)], 1000)[1] == {"a": 20}


DOCS = "doc_id long, source string, text string, slot int, repeat int, n_tokens int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)


def mixes(spark, rows):
    return spark.createDataFrame(rows, "source string, target_weight double, max_repeats int")


def test_mixture_repeats_and_shares(spark):
    rows = [(i, " Big " if i % 2 else "big", "one two three four five six " * 8) for i in range(200)] + [(500 + i, "small", "seven eight nine ten " * 8) for i in range(5)] + [(900, None, "x"), (901, "big", None), (902, "big", ""), (903, "other", "y")]
    t = mixes(spark, [("big", 3.0, 1), ("small", 1.0, 3), ("empty", 1.0, 2), (None, 1.0, 1), ("nan", float("nan"), 1)])
    m = mixture.mixture(docs(spark, rows), t, frame=100, block=64).collect()
    times = {}
    for r in m:
        times.setdefault((r["source"], r["doc_id"]), []).append(r["repeat"])
    assert all(sorted(v) == list(range(len(v))) for v in times.values())
    assert max(len(v) for (s, _), v in times.items() if s == "small") == 3 and max(len(v) for (s, _), v in times.items() if s == "big") == 1
    share = {r["source"]: r for r in mixture.shares(docs(spark, rows), t).collect()}
    assert share["small"]["missed"] and share["empty"]["missed"] and not share["big"]["missed"]
    assert share["big"]["used_tokens"] == sum(r["n_tokens"] for r in m if r["source"] == "big")
    assert abs(sum(r["actual_share"] for r in share.values()) - 1) < 1e-9
    equal = mixture.shares(docs(spark, rows), mixes(spark, [("big", 1.0, 1), ("small", 1.0, 9)]), total=600).collect()
    assert all(abs(r["actual_share"] - 0.5) < 0.1 and not r["missed"] for r in equal)


def test_mixture_of_nothing(spark):
    t = mixes(spark, [("big", 3.0, 1)])
    assert mixture.mixture(docs(spark, []), t).count() == 0
    r = mixture.shares(docs(spark, []), t).first()
    assert r["actual_share"] == 0.0 and r["used_tokens"] == 0
    assert mixture.mixture(docs(spark, [(1, "big", "a")]), mixes(spark, [])).count() == 0
    assert mixture.shares(docs(spark, [(1, "big", "a")]), mixes(spark, [])).count() == 0
