import re
from collections import Counter
from hashlib import md5

import pytest
from conftest import same

from dialoom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
SLOW = {"tfidf_clusters"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).collect()


def test_quota_sample_is_proportional(spark, small):
    rows = QUERIES["curation_source_quotas"](spark, small).collect()
    assert len({r["record_id"] for r in rows}) == len(rows) > 0


def test_selections_meet_their_quotas_apart(spark, small):
    rows = QUERIES["slice_selection"](spark, small).collect()
    assert len({r["cand_id"] for r in rows}) == len(rows)
    assert Counter(r["split"] for r in rows)["train"] <= 300 and {r["split"] for r in rows} <= {"train", "valid"}


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_best_reference_takes_whole_texts(spark, small):
    got = {r["cand_id"]: r["best"] for r in QUERIES["best_reference"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/candidates.parquet").where("cand_id is not null and reference_answer is not null").collect()

    def pairs(text):
        t = re.sub("[^\u4e00-\u9fffa-z0-9]+", "", (text or "").lower())
        return Counter(t[i : i + 2] for i in range(max(len(t) - 1, min(len(t), 1))))

    assert any(len(r["question"] or "") > 60 < len(r["reference_answer"]) for r in rows)
    for r in rows:
        q, refs = pairs(r["question"]), [pairs(r[x]) for x in ("reference_answer", "negative_reference_answer")]
        assert got[r["cand_id"]] == pytest.approx(max(2 * (q & x).total() / (q.total() + x.total()) if q and x else 0.0 for x in refs), abs=1e-9)


def test_slugs_of_whole_texts(spark, small):
    got = {r["doc_id"]: r["slug_md5"] for r in QUERIES["text_slugs"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 80").collect()
    assert rows
    for r in rows:
        slug = re.sub("-+", "-", "".join(x if x.isalnum() or x in "-_" else "-" for x in r["text"].lower())).strip("-")
        assert got[r["doc_id"]] == md5(slug.encode()).hexdigest()
