import gzip
import json

import pytest

from dialoom.plans import runs as P
from dialoom.sources import jsonl
from dialoom.streaming import runs


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_text('{"k": "a", "v": 1}\n\n  \nnot json\n{"k": "b", "v": 2}\n', encoding="utf-8")
    (tmp_path / "sub/b.json").write_text(json.dumps([{"k": "c", "v": 3}, {"k": "d", "v": 4}], indent=1))
    (tmp_path / "c.txt").write_text("x")
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write('{"k": "e", "v": 5}\n')
    return tmp_path


def test_layout_and_expansion(spark, folder):
    assert jsonl.layout(spark, str(folder / "a.jsonl")) == "lines" and jsonl.layout(spark, str(folder / "sub/b.json")) == "array"
    assert [x.rsplit("/", 1)[1] for x in jsonl.expand(spark, str(folder))] == ["a.jsonl", "b.json"]
    assert jsonl.expand(spark, str(folder / "a.jsonl")) == [str(folder / "a.jsonl")]


def test_numbered_records(spark, folder):
    rows = sorted(jsonl.read_numbered(spark, str(folder / "a.jsonl"), "k string, v int").collect(), key=lambda r: r["line_no"])
    assert [r["line_no"] for r in rows] == [1, 4, 5]
    assert rows[0]["record"]["k"] == "a" and rows[1]["record"] is None and rows[1]["error"].startswith("not a record") and rows[2]["error"] is None


def test_line_numbers_over_split_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(str(i) for i in range(1, 5001)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = jsonl.numbered_lines(spark, str(tmp_path / "x.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(int(r["value"]) == r["line_no"] for r in rows)


def test_strict_lenient_any(spark, folder):
    assert jsonl.read_lenient(spark, str(folder / "a.jsonl"), "k string, v int").where("k is not null").count() == 2
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(folder / "a.jsonl"), "k string, v int").collect()
    assert jsonl.read_any(spark, str(folder / "sub/b.json"), "k string, v int").count() == 2
    assert jsonl.read_strict(spark, str(folder / "d.json.gz"), "k string, v int").first()["v"] == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "雪", 1), ("b", None, 2), ("a", "x", 3)], "b string, t string, v int")
    jsonl.write_lines(df, str(tmp_path / "o"), one_file=True)
    text = next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8")
    assert "雪" in text and '"t":null' in text
    jsonl.write_buckets(df, str(tmp_path / "p"), "b")
    assert spark.read.json(str(tmp_path / "p")).count() == 3 and (tmp_path / "p/b=a").is_dir()
    jsonl.write_report(spark, {"n": 3, "名": "x"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["n"] == 3
    jsonl.append_manifest(df, str(tmp_path / "m"))
    jsonl.append_manifest(df, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), sep="\t").count() == 6
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\"x\ny\"\n")
    assert jsonl.read_table(spark, str(tmp_path / "t.tsv"), "a int, b string", "\t").first()["b"] == "x\ny"
    assert jsonl.markdown(df.orderBy("v")).count("\n") == 4
    with pytest.raises(ValueError):
        jsonl.markdown(df, 2)


def test_split_and_head_tail(spark):
    df = spark.range(2000)
    a, b = jsonl.split_rows(df, 0.1, 1, "id")
    assert a.count() + b.count() == 2000 and 120 < b.count() < 280
    lines = df.selectExpr("'f' as file", "id as line_no")
    assert sorted(r["line_no"] for r in jsonl.head_and_tail(lines, 2).collect()) == [0, 1, 1998, 1999]


def test_log_scan(spark, tmp_path):
    (tmp_path / "x.log").write_text("fine\nCUDA out of memory\n")
    (tmp_path / "y.log").write_text("fine\n")
    got = {r["file"][-5:]: r["oom"] for r in jsonl.scan_logs(spark, str(tmp_path), {"oom": "out of memory"}).collect()}
    assert got == {"x.log": True, "y.log": False}


def test_metric_rows(spark):
    rows = spark.createDataFrame([("t1", 1, {"loss": 1.0}), ("t2", 1, {"loss": 1.5}), ("t3", 1, {"eval": 0.4}), ("t4", 2, {"loss": 0.7})], "timestamp string, step long, logs map<string,double>")
    assert sorted(r["timestamp"] for r in runs.first_per_step(rows).collect()) == ["t1", "t3", "t4"]
    assert runs.latest(rows, "loss").first()["value"] == 0.7


def test_stream_dedup_within_watermark(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "k string, ts string").selectExpr("k", "cast(ts as timestamp) as ts").write.json(str(tmp_path / "in"))
    s = runs.deduplicated(runs.read_log(spark, str(tmp_path / "in"), "k string, ts timestamp"), ["k"], "ts")
    seen = []
    runs.drain(s, lambda b, i: seen.extend(r["k"] for r in b.collect()))
    assert sorted(seen) == ["a", "b"]


def test_places_are_new(spark):
    assert P._place(spark) != P._place(spark)
