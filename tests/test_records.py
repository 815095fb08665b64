import json

import pytest
from pyspark.sql import functions as F

from dialoom import session
from dialoom.functions import records as R
from dialoom.operators import judging
from dialoom.sources import jsonl
from dialoom.streaming import runs


def test_small_names_and_counts():
    assert R.number_slug(0.7) == "0p7" and R.number_slug(-1) == "neg1" and R.number_slug(1e-5) == "1eneg05"
    assert R.model_alias("org/Some Model_7B", None) == "some-model_7b" and R.model_alias("x", "/runs/My.Run/checkpoint-3/") == "my-run"
    assert R.model_alias(None, None) == "unknown-model" and R.model_alias(None, "only") == "only"
    assert R.remaining(3723.9) == "01:02:03" and R.remaining(-5) == "00:00:00" and R.remaining(360000) == "100:00:00"
    assert R.warmup_steps(1000, 2, 2, 8, 3, 0.1) == 9 and R.warmup_steps(10, 1, 1, 1, 1, 0.5, most_steps=40) == 20 and R.warmup_steps(0, 0, 1, 0, 1, 0.0) == 0
    for per, devices, group in ((1, 2, 4), (3, 2, 8), (0, 1, 1), (5, 3, 7)):
        size = max(1, per)
        while size * devices % group:
            size += 1
        assert R.batch_for_groups(per, devices, group) == size
    assert runs.progress(50, 200, 10) == {"done": 50, "total": 200, "share": 0.25, "per_second": 5.0, "left": "00:00:30"} and runs.progress(0, 0, 0)["left"] == "00:00:00"


def test_contents_of_any_depth(spark):
    rows = [json.dumps(x) for x in (" a ", {"text": {"content": "b"}}, ["x", {"content": ["y", "", {"text": " z"}]}, None], {"other": 1}, 7, [])] + ["no json {", None]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(rows)), "i int, c string").orderBy("i").select(R.flat_content("c").alias("t")).collect()]
    assert got == ["a", "b", "x\ny\nz", "", "7", "", "no json {", ""]


def test_dispatch_and_chats(spark):
    conv = "array<struct<from:string,value:string>>"
    df = spark.createDataFrame([(1, [("user", "q"), ("bot", "a")], None, None), (2, None, "do", "done"), (3, None, "do", " "), (4, None, None, "x"), (5, [], "do", "done")], f"i int, conversations {conv}, instruction string, output string")
    got = {r["i"]: (r["format"], r["error"], r["record"] and [tuple(x) for x in r["record"]]) for r in R.dispatched(df).collect()}
    assert got[1] == ("dialogue", None, [("human", "q"), ("gpt", "a")]) and got[2] == ("instruction", None, [("human", "do"), ("gpt", "done")])
    assert got[3] == ("instruction", "empty side", None) and got[4] == (None, "unknown format", None) and got[5][:2] == ("dialogue", "empty conversation")
    assert R.dispatched(df.select("i")).where("error = 'unknown format'").count() == 5
    m = spark.createDataFrame([(" be kind ", [("user", " hi "), ("tool", "x"), ("assistant", " ")]), (None, None)], "s string, h array<struct<role:string,content:string>>").select(R.chat_messages(F.col("s"), F.col("h")).alias("m")).collect()
    assert [[tuple(x) for x in r["m"]] for r in m] == [[("system", "be kind"), ("user", "hi")], []]


def test_assertions_fail_loudly(spark):
    sole = lambda tags: spark.createDataFrame([(tags,)], "t array<string>").select(R.sole_tag(F.col("t"), "theme:").alias("k")).collect()
    assert sole(["theme:a", "x"])[0]["k"] == "a"
    for tags in (["theme:a", "theme:b"], ["x"], None):
        with pytest.raises(Exception, match="theme:"):
            sole(tags)
    with pytest.raises(Exception, match="differ in number"):
        spark.sql("select array(1, 2) as a, array(true) as b").select(R.graded(F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="whole number"):
        jsonl.whole_numbers(spark.createDataFrame([("3",), ("3.5",)], "target string"), "target").collect()


def test_answers(spark):
    rows = ["Answer: B", "the ANSWER : $c$", "答案：Ｄ", "الإجابة النهائية: ب", "so A it is", None]
    assert [r["x"] for r in spark.createDataFrame(list(enumerate(rows)), "i int, c string").orderBy("i").select(R.choice_letter(F.col("c")).alias("x")).collect()] == ["B", "C", "D", "B", None, None]
    kinds = spark.createDataFrame([('{"number": "0"}',), ('{"date": {"day": "", "month": "May", "year": "1990"}}',), ("{}",)], "a string").select(R.typed_answer(F.col("a")).alias("x")).collect()
    assert [r["x"] and (r["x"]["values"], r["x"]["kind"]) for r in kinds] == [None, (["May 1990"], "date"), None]


def test_replies_of_models():
    assert judging.verdict('x ```json\n{"criteria_met": true, "explanation": "e"}\n```') == (True, "e")
    for reply in (None, "", "{}", '{"criteria_met": "yes"}'):
        with pytest.raises(ValueError):
            judging.verdict(reply)
    asked = []

    def forgetful(prompts):
        asked.append(len(prompts))
        return ["nothing" if len(asked) == 1 and i % 2 else r for i, r in enumerate(judging.stub_model(prompts))]

    items = [(f"c{i}", f"t{i}") for i in range(6)]
    assert judging.model_judge(forgetful)(items) == judging.model_judge(judging.stub_model)(items) and asked == [6, 3]
    with pytest.raises(RuntimeError):
        judging.model_judge(lambda prompts: ["" for _ in prompts])(items)


def test_rewriting_falls_back_to_single_rows(spark):
    rows = [(f"k{i}", f" a  {i} ", None if i == 3 else "r  r") for i in range(20)] + [("boom", "boom  x", "y"), ("bad", "no", "z")]

    def client(items):
        if any(x["sample_id"] == "bad" for x in items):
            raise RuntimeError("never")
        return judging.stub_rewriter(items)

    got = {r["k"]: (r["chosen"], r["rejected"], r["error"]) for r in judging.rewritten(spark.createDataFrame(rows, "k string, c string, r string").coalesce(1), "k", "c", "r", lambda: client, batch=8, per_second=1000).collect()}
    assert len(got) == 22 and got["k5"] == ("a 5", "r r", None) and got["k3"] == ("a 3", "", None) and got["boom"] == ("boom x", "y", None)
    assert got["bad"][0] == "no" and "never" in got["bad"][2]


def test_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n" * 9000 + '[{"v": 1}]')
    (tmp_path / "o.json").write_text('{\n "v": 1\n}\n')
    (tmp_path / "l.jsonl").write_text('﻿\n{"v": 1}\n{"v": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"v": 1}\n{"v": \n')
    (tmp_path / "e.json").write_text("")
    kinds = {n: jsonl.layout(spark, str(tmp_path / n)) for n in ("a.json", "o.json", "l.jsonl", "e.json")}
    assert kinds == {"a.json": "array", "o.json": "object", "l.jsonl": "lines", "e.json": "lines"}
    assert jsonl.read_any(spark, str(tmp_path / "o.json"), "v int").first()["v"] == 1 and jsonl.read_any(spark, str(tmp_path / "a.json"), "v int").count() == 1
    with pytest.raises(Exception):
        jsonl.read_any(spark, str(tmp_path / "bad.jsonl"), "v int").collect()


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", \n b'), (2, None)], "v int, t string")
    jsonl.write_csv(df, str(tmp_path / "c"))
    assert sorted((r["v"], r["t"]) for r in jsonl.read_table(spark, str(tmp_path / "c"), "v int, t string").collect()) == [(1, 'a "q", \n b'), (2, None)]
    jsonl.append_lines(df, str(tmp_path / "l"))
    jsonl.append_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    assert "<h2>x &lt;</h2>" in jsonl.html_table(df, "x <") and jsonl.html_table(df).count("<tr>") == 3
    lines = spark.range(1, 1001).selectExpr("'f' as file", "id as line_no", "cast(id as string) as value").unionByName(spark.range(1, 4).selectExpr("'g' as file", "id as line_no", "cast(id as string) as value"))
    got = sorted((r["file"], r["line_no"], r["value"]) for r in jsonl.shortened(lines, 2).collect())
    assert [v for f, _, v in got if f == "f"] == ["1", "2", "... 996 lines left out ...", "999", "1000"] and [v for f, _, v in got if f == "g"] == ["1", "2", "3"]
    assert jsonl.output_name("d/x.jsonl", "processed") == "d/x.processed.jsonl" and jsonl.output_name("x", "kept") == "x.kept.jsonl"
    (tmp_path / "runs/r1/artifacts").mkdir(parents=True)
    (tmp_path / "runs/r2").mkdir()
    (tmp_path / "runs/r1/artifacts/s.json").write_text("1")
    assert [x.rsplit("/", 1)[1] for x in jsonl.runs_with(spark, str(tmp_path / "runs"))] == ["r1"]
    assert jsonl.copy_files(spark, str(tmp_path / "runs/r1"), str(tmp_path / "out"), ["artifacts/s.json", "none"]) == ["artifacts/s.json"] and (tmp_path / "out/artifacts/s.json").read_text() == "1"
    assert jsonl.existing(spark, {"a": [str(tmp_path)], "b": [str(tmp_path), str(tmp_path / "no")]}) == {"a": [str(tmp_path)]}


def test_best_survives_a_repeated_batch(spark, tmp_path):
    place = f"file://{tmp_path}/best"
    step = runs.best_so_far(place, "g", "v", "i", "max")
    batch = lambda rows: spark.createDataFrame(rows, "g string, i int, v double")
    step(batch([("a", 1, 1.0), ("b", 2, 5.0), ("c", 3, None)]), 0)
    for _ in range(2):  # a crash after writing, and the batch comes again
        step(batch([("a", 4, 3.0), ("b", 5, 4.0)]), 1)
    step(batch([("a", 6, 3.0)]), 2)
    assert sorted(map(tuple, runs.current(spark, place).select("g", "i", "v").collect())) == [("a", 4, 3.0), ("b", 2, 5.0)]


def test_tables_are_removed(spark):
    with session.scratch(spark):
        kept = session.durable(spark.range(3))
        assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def get(self, *_):
            return None

    class Session:
        conf = Unset()
        sparkContext = type("C", (), {"getConf": lambda self: Unset(), "master": "local-cluster[2,1,1024]", "applicationId": "x"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
