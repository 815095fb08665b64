"""Queries of benchmark answers and of model-backed operators (with the stand-in judge)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import answers as A
from dialoom.operators import judging
from dialoom.plans import sqltext as S
from dialoom.session import broadcast_within, table


def _choices(s, d):
    p = table(s, d, "part").select("p_partkey", F.array(F.lit("red"), F.lit("green"), F.lit("blue"), F.lit("black")).alias("c"), F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue"), F.lit("black")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("right"))
    p = p.withColumn("c", A.permuted(F.col("c"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", A.letter_of(F.col("c"), F.col("right")).alias("letter"), F.md5(A.choice_prompt(F.lit("Which colour?"), F.col("c"))).alias("prompt_md5"))


def _responses(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(A.plain_response(F.col("text"))).alias("plain_md5"))


def _token_f1(s, d):
    p = table(s, d, "preference_pairs").select("pair_id", A.answer_tokens(F.col("response_chosen")).alias("a"), A.answer_tokens(F.col("response_rejected")).alias("b"))
    return p.select("pair_id", F.round(A.token_f1(F.col("a"), F.col("b")), 6).alias("f1"), (F.array_sort("a") == F.array_sort("b")).alias("exact"), F.size("a").alias("n"))


def _few_shot(s, d):
    """Three worked examples per priority, drawn by hash, before each target."""
    o = table(s, d, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.md5(F.concat(F.lit("shot "), F.col("o_orderkey").cast("string"))), "o_orderkey")
    shots = o.withColumn("i", F.row_number().over(w)).where("i <= 3").groupBy("o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o_orderkey", "o_orderstatus"))), lambda x: F.concat(F.lit("Q "), x["o_orderkey"].cast("string"), F.lit(" A "), x["o_orderstatus"])), "\n").alias("shots"))
    return o.where("o_orderstatus = 'P'").join(broadcast_within(shots, 10_000), "o_orderpriority").select("o_orderkey", F.md5(F.concat("shots", F.lit("\nQ "), F.col("o_orderkey").cast("string"))).alias("prompt_md5"))


def _completion_ids(s, d):
    return table(s, d, "candidates").select("cand_id", F.sha2(F.concat(F.coalesce("prompt_id", F.lit("")), F.coalesce("reference_answer", F.lit(""))), 256).alias("completion_id"))


def _judged(s, d):
    c = table(s, d, "candidates").select("cand_id", F.explode_outer("slice_tags").alias("criterion"), F.coalesce("reference_answer", F.lit("")).alias("answer")).withColumn("criterion", F.coalesce("criterion", F.lit("")))
    r = judging.judged(c, "criterion", "answer", lambda: judging.stub_judge)
    return r.groupBy("criterion").agg(F.count(F.lit(1)).alias("n"), F.count_if("met").alias("met"))


def _keys(s, d):
    e = table(s, d, "candidates").select("cand_id", F.concat(F.col("source_dataset"), F.lit(":"), F.coalesce("risk_level", F.lit("")), F.lit(":"), F.coalesce("reference_answer_kind", F.lit(""))).alias("k"))
    return e.select("cand_id", A.metric_key(F.col("k")).alias("x")).select("cand_id", "x.theme", "x.category", "x.criterion")


def _roles(s, d):
    c = table(s, d, "candidates").where("prompt is not null")
    return c.groupBy(A.all_roles_in(F.col("prompt"), ["user", "assistant"]).alias("plain")).agg(F.count(F.lit(1)).alias("n"))


def _decrypted(s, d):
    """Texts encrypted here and decrypted by the operator; how many come back unchanged."""
    r = table(s, d, "documents").select("text", A.decrypted(A.locked("text", F.lit("key")), F.lit("key")).alias("back"))
    return r.agg(F.count("text").alias("texts"), F.count_if(F.col("text") == F.col("back")).alias("unchanged"))


def queries():
    return {"choice_prompts": _choices, "plain_responses": _responses, "answer_token_f1": _token_f1, "few_shot_prompts": _few_shot, "completion_ids": _completion_ids, "stub_judged": _judged, "metric_keys": _keys, "plain_roles": _roles, "decrypted_texts": _decrypted}


def oracle_sql():
    plain = "text"
    for mark in ("**", "$\\boxed{", "}$", "\\$", "$\\text{", "$", "\\mathrm{", "\\{", "\\text", "\\(", "\\mathbf{", "{", "\\boxed"):
        plain = f"replace({plain}, {S.q(mark)}, '')"
    tok = lambda c: f"list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '[ \\-]+'), lambda x: case when regexp_matches(x, '^[+-]?[0-9]+(\\.[0-9]+)?$') then x else regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g') end), lambda x: x not in ('', 'a', 'an', 'the')))"
    return {
        "choice_prompts": "with c as (select p_partkey, list_transform(list_sort(list_transform(['red', 'green', 'blue', 'black'], lambda x: {'h': md5(p_partkey || '|0|' || x), 'c': x})), lambda y: y.c) as c, ['red', 'green', 'blue', 'black'][(p_partkey % 4 + 1)::int] as r from part) select p_partkey, substr('ABCD', list_position(c, r), 1) as letter, md5('Which colour?' || chr(10) || 'A) ' || c[1] || chr(10) || 'B) ' || c[2] || chr(10) || 'C) ' || c[3] || chr(10) || 'D) ' || c[4]) as prompt_md5 from c",
        "plain_responses": f"select doc_id, md5(translate({plain}, '{A.WIDE}', '{A.PLAIN}')) as plain_md5 from documents where text is not null",
        "answer_token_f1": f"with t as (select pair_id, {tok('response_chosen')} as a, {tok('response_rejected')} as b from preference_pairs), c as (select *, len(list_intersect(a, b)) as k, list_filter(b, lambda x: regexp_matches(x, '^[+-]?[0-9]+(\\.[0-9]+)?$')) as nums from t) select pair_id, round(case when len(nums) > 0 and len(list_intersect(nums, a)) = 0 then 0.0 when k = 0 then 0.0 else 200.0 * k / (len(a) + len(b)) end::double, 6) as f1, list_sort(a) = list_sort(b) as exact, len(a) as n from c",
        "few_shot_prompts": "with r as (select *, row_number() over (partition by o_orderpriority order by md5('shot ' || o_orderkey), o_orderkey) as i from orders), s as (select o_orderpriority, string_agg('Q ' || o_orderkey || ' A ' || o_orderstatus, chr(10) order by i) as shots from r where i <= 3 group by 1) select o_orderkey, md5(shots || chr(10) || 'Q ' || o_orderkey) as prompt_md5 from orders join s using (o_orderpriority) where o_orderstatus = 'P'",
        "completion_ids": "select cand_id, sha256(coalesce(prompt_id, '') || coalesce(reference_answer, '')) as completion_id from candidates",
        "stub_judged": "with c as (select coalesce(t.x, '') as criterion, coalesce(reference_answer, '') as answer from (select reference_answer, unnest(case when slice_tags is null or len(slice_tags) = 0 then [null] else slice_tags end) as x from candidates) t) select criterion, count(*) as n, count(*) filter (md5(criterion || '|' || answer) < '8') as met from c group by 1",
        "metric_keys": "select cand_id, nullif(source_dataset, '') as theme, nullif(risk_level, '') as category, nullif(reference_answer_kind, '') as criterion from candidates where source_dataset is not null union all select cand_id, null, null, null from candidates where source_dataset is null",
        "plain_roles": "select len(list_filter(prompt, lambda m: m.\"role\" not in ('user', 'assistant'))) = 0 as plain, count(*) as n from candidates where prompt is not null group by 1",
        "decrypted_texts": "select count(text) as texts, count(text) as unchanged from documents",
    }
