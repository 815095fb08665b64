"""Queries of record layouts, files, small answers and model-backed steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import answers as A
from dialoom.functions import conversation as C
from dialoom.functions import records as R
from dialoom.functions import text as T
from dialoom.operators import judging
from dialoom.plans import sqltext as S
from dialoom.plans.curation import _SQL_STRICT
from dialoom.session import new_place, table
from dialoom.sources import jsonl


def _instructions(s, d):
    p = table(s, d, "preference_pairs")
    return p.select("pair_id", F.col("question").alias("instruction"), F.col("system").alias("input"), F.col("response_chosen").alias("output"))


def _dispatched(s, d):
    """Dialogues, instructions and texts of no format through one dispatcher."""
    a = table(s, d, "scored_records").select("conversations")
    b = _instructions(s, d).drop("pair_id")
    c = table(s, d, "documents").select("text")
    r = R.dispatched(a.unionByName(b, True).unionByName(c, True))
    return r.groupBy(F.coalesce("format", F.lit("none")).alias("format"), F.coalesce("error", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count("record").alias("records"))


def _instruction_records(s, d):
    r = R.dispatched(_instructions(s, d)).where("record is not null")
    return r.select("pair_id", F.md5(F.col("record")[0]["value"]).alias("ask_md5"), F.md5(F.col("record")[1]["value"]).alias("answer_md5"))


def _train_records(s, d):
    """The columns that training reads, with the name of the subset."""
    r = table(s, d, "scored_records").where("quality_bucket = 'high_confidence_keep'")
    return r.select("record_id", "curation_source", "curation_hash", F.round("quality_score", 9).alias("quality_score"), "quality_bucket", F.lit("high_all").alias("subset_name"))


def _chats(s, d):
    m = R.chat_messages(F.col("risk_level"), F.col("prompt"))
    r = table(s, d, "candidates").select("cand_id", m.alias("m"))
    return r.select("cand_id", F.size("m").alias("n_messages"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n\n")).alias("chat_md5"))


def _references(s, d):
    r = table(s, d, "scored_records").select("record_id", R.reference_of(C.lenient(F.col("conversations"))).alias("r")).where("r is not null")
    return r.select("record_id", F.size("r.prompt").alias("n_prompt"), F.md5("r.question").alias("question_md5"), F.md5("r.reference").alias("reference_md5"))


_NAMES = {"urgent": "Urgent care", "high": "High"}


def _themes(s, d):
    """Orders as examples with exactly one theme tag, by its display name."""
    tags = F.array(F.lit("level:order"), F.concat(F.lit("theme:"), F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))))
    o = table(s, d, "orders").select(R.display_name(R.sole_tag(tags, "theme:"), _NAMES).alias("theme"), F.size(R.tags_with(tags, "level:")).alias("levels"))
    return o.groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.sum("levels").alias("levels"))


def _graded(s, d):
    """Slice tags as rubric items beside grades by position."""
    tags = F.transform(F.coalesce("slice_tags", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    c = table(s, d, "candidates").select(F.explode(R.graded(tags, F.transform(tags, lambda x: F.length(x) % 2 == 0))).alias("x"))
    return c.groupBy(F.col("x.rubric").alias("rubric")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.grade")).alias("met"))


def _typed(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.to_json(F.struct(F.col("p_size").cast("string").alias("number"))))
        .when(k == 1, F.to_json(F.struct(F.lit("").alias("number"), F.array("p_name").alias("spans"))))
        .when(k == 2, F.to_json(F.struct(F.array("p_brand", "p_type").alias("spans"))))
        .otherwise(F.to_json(F.struct(F.struct(F.lit("3").alias("day"), F.lit("May").alias("month"), F.col("p_size").cast("string").alias("year")).alias("date"))))
    )
    return p.select("p_partkey", R.typed_answer(text).alias("a")).select("p_partkey", F.array_join("a.values", "|").alias("values"), "a.kind")


def _dates(s, d):
    e = table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("day", "d MMMM yyyy")).otherwise(F.lit("unknown"))
    return e.select("o_orderkey", F.date_format(R.release_date(text), "yyyy-MM-dd").alias("day"))


def _replicated(s, d):
    """Every order three times, numbered."""
    o = table(s, d, "orders").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return o.groupBy("o_orderpriority", "replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def _most_common(s, d):
    """Sources by number of documents, ties by their first document."""
    c = table(s, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select("place", "source", "n")  # one row a source


def _lengths(s, d):
    c = table(s, d, "candidates").where("question is not null").select("cand_id", "question")
    return R.within_length(c, F.col("question"), 120).select("cand_id", "n_tokens")


def _models(s, d):
    """Replicates of the named models only."""
    wanted = [x.strip() for x in "m1, m3".split(",")]
    li = table(s, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model"))
    return li.where(F.col("model").isin(wanted)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def _fan_out(s, d):
    """Candidates of one reference kind, one row for each of their references."""
    c = table(s, d, "candidates").where("reference_answer_kind is not null and reference_answer is not null")
    return c.select("cand_id", "reference_answer_kind", F.posexplode(F.array_compact(F.array("reference_answer", "negative_reference_answer"))).alias("i", "completion")).select("cand_id", "reference_answer_kind", "i", F.md5("completion").alias("completion_md5"))


def _letters(s, d):
    """Replies that say the letter of a choice in many languages."""
    words = F.array(*[F.lit(w.replace("\u0001", " ")) for w in R.ANSWER_WORDS])
    word = F.element_at(words, (F.col("p_partkey") % len(R.ANSWER_WORDS) + 1).cast("int"))
    letter = F.substring(F.lit("ABCDＡＢＣＤ"), (F.col("p_partkey") % 8 + 1).cast("int"), F.lit(1))
    reply = F.when(F.col("p_partkey") % 11 == 0, "nothing said").otherwise(F.concat(F.lit("so... "), word, F.lit(" : "), letter))
    return table(s, d, "part").select("p_partkey", R.choice_letter(reply).alias("letter"))


def _grades(s, d):
    r = F.concat(F.lit("grade "), F.upper(F.substring(F.md5(F.col("cand_id").cast("string")), 1, 3)))
    return table(s, d, "candidates").select("cand_id", R.grade_letter(r).alias("grade"), R.says_yes(F.when(F.col("cand_id") % 3 == 0, " Yes ").when(F.col("cand_id") % 3 == 1, "no")).alias("equal"))


def _usage(s, d):
    p = F.col("p_size").cast("long")
    a = F.to_json(F.struct(p.alias("prompt_tokens"), (p + 1).alias("completion_tokens"), F.struct(F.lit(2).cast("long").alias("cached_tokens")).alias("prompt_tokens_details")))
    b = F.to_json(F.struct(p.alias("input_tokens"), (p * 2).alias("output_tokens"), (p * 3).alias("total_tokens")))
    return table(s, d, "part").select("p_partkey", A.usage(F.when(F.col("p_partkey") % 2 == 0, a).otherwise(b)).alias("u")).select("p_partkey", "u.input", "u.output", "u.total", "u.cached")


def _titles(s, d):
    tags = table(s, d, "candidates").select(F.explode("slice_tags").alias("tag")).where("tag is not null").distinct()
    return tags.select("tag", T.tag_title(F.concat(F.lit("theme:"), "tag")).alias("title"))


def _model_judged(s, d):
    """Answers judged through prompts and replies of the stand-in model."""
    c = table(s, d, "candidates").select("source_dataset", F.coalesce("risk_level", F.lit("")).alias("criterion"), F.coalesce("question", F.lit("")).alias("talk"))
    r = judging.judged(c, "criterion", "talk", lambda: judging.model_judge(judging.stub_model))
    return r.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("met").alias("met"))


def _rewritten(s, d):
    """Pairs rewritten by the stand-in, batch by batch, single where a batch fails."""
    p = table(s, d, "preference_pairs").select("pair_id", "response_chosen", "response_rejected")
    r = judging.rewritten(p.withColumnRenamed("pair_id", "key"), "key", "response_chosen", "response_rejected", lambda: judging.stub_rewriter)
    return r.select(F.col("key").alias("pair_id"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), "error")


def _lines_back(s, d):
    """Candidates written as JSON lines and read back with line numbers."""
    place = new_place(s)
    jsonl.write_lines(table(s, d, "candidates").select("cand_id", "question", "source_dataset"), place)
    r = jsonl.read_numbered(s, place, "cand_id long, question string, source_dataset string")
    return r.where("error is null").select("record.cand_id", F.md5(F.coalesce("record.question", F.lit("null"))).alias("question_md5"), F.col("record.source_dataset").alias("source_dataset"))


def _csv_back(s, d):
    """Questions through a CSV file with a header: line ends, quotes and marks within fields come back."""
    place = new_place(s)
    jsonl.write_csv(table(s, d, "orders").select("o_orderkey", F.concat(F.lit('a "b", '), "o_orderpriority", F.lit("\nx")).alias("text")), place)
    return jsonl.read_table(s, place, "o_orderkey long, text string").select("o_orderkey", F.md5("text").alias("text_md5"))


def _buckets_back(s, d):
    """Records written into a folder for each bucket and read as one table."""
    place = new_place(s)
    jsonl.write_buckets(table(s, d, "scored_records").select("record_id", F.coalesce(F.nullif("quality_bucket", F.lit("")), F.lit("none")).alias("bucket")), place, "bucket")
    return s.read.schema("record_id long, bucket string").json(place).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))


def _split(s, d):
    a, b = jsonl.split_rows(table(s, d, "documents"), 0.1, 7, "doc_id")
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), (F.col("n") > 0).alias("has"))
    both = a.select("doc_id").unionByName(b.select("doc_id")).agg(F.countDistinct("doc_id").alias("n")).select(F.lit("both").alias("side"), (F.col("n") > 0).alias("has"))
    return one(a, "train").unionByName(one(b, "valid")).unionByName(both)


def _equal_answers(s, d):
    p = table(s, d, "preference_pairs")
    return p.groupBy(A.loosely_equal(F.col("response_chosen"), F.col("response_rejected")).alias("equal")).agg(F.count(F.lit(1)).alias("n"))


def queries():
    return {
        "records_dispatched": _dispatched, "instruction_records": _instruction_records, "train_records": _train_records, "chat_messages": _chats, "conversation_references": _references, "sole_themes": _themes, "graded_items": _graded, "typed_answers": _typed, "release_dates": _dates,
        "replicated_examples": _replicated, "most_common": _most_common, "prompt_lengths": _lengths, "model_filter": _models, "reference_fan_out": _fan_out, "choice_letters": _letters, "grader_letters": _grades, "usage_counters": _usage, "tag_titles": _titles,
        "model_judged": _model_judged, "pairs_rewritten": _rewritten, "files_lines": _lines_back, "files_csv": _csv_back, "files_buckets": _buckets_back, "split_sides": _split, "loosely_equal_answers": _equal_answers,
    }


def oracle_sql():
    ask = f"case when {S.clean('question')} <> '' and {S.clean('system')} <> '' then {S.clean('question')} || chr(10) || chr(10) || {S.clean('system')} else {S.clean('question')} || {S.clean('system')} end"
    before, between, after = (S.q(x) for x in judging.JUDGE_PROMPT.replace("{criterion}", "{conversation}").split("{conversation}"))
    tok = "list_filter(list_transform(regexp_split_to_array(lower(coalesce({0}, '')), '[ \\-]+'), lambda x: case when regexp_matches(x, '^[+-]?[0-9]+(\\.[0-9]+)?$') then x else regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g') end), lambda x: x <> '' and x not in ('a', 'an', 'the'))"
    joined = "array_to_string(list_transform(list_filter(list_transform(range(1, len({0}) + 1), lambda i: struct_pack(x := {0}[i], first := list_position({0}, {0}[i]) = i)), lambda p: p.first), lambda p: p.x), ' ')"
    conv = f"list_filter({S.lenient('conversations')}, lambda x: x.\"from\" <> 'system')"
    return {
        "records_dispatched": f"with {_SQL_STRICT}, i as (select case when question is null or response_chosen is null then 'none' else 'instruction' end as format, case when question is null or response_chosen is null then 'unknown format' when ({ask}) = '' or {S.clean('response_chosen')} = '' then 'empty side' else 'valid' end as outcome from preference_pairs), u as (select case when conversations is null then 'none' else 'dialogue' end as format, case when conversations is null then 'unknown format' when len(turns) = 0 then 'empty conversation' when len(list_filter(turns, lambda x: x.r is null)) > 0 then 'unknown role' when len(list_filter(turns, lambda x: x.v = '')) > 0 then 'empty value' when len(list_filter(body, lambda x, i: x.r <> case when i % 2 = 1 then 'human' else 'gpt' end)) > 0 then 'roles out of order' when len(body) < 2 or len(body) % 2 <> 0 then 'incomplete exchange' else 'valid' end as outcome from b union all select * from i union all select 'none', 'unknown format' from documents) select format, outcome, count(*) as n, count(*) filter (outcome = 'valid') as records from u group by all",
        "instruction_records": f"select pair_id, md5({ask}) as ask_md5, md5({S.clean('response_chosen')}) as answer_md5 from preference_pairs where question is not null and response_chosen is not null and ({ask}) <> '' and {S.clean('response_chosen')} <> ''",
        "train_records": "select record_id, curation_source, curation_hash, round(quality_score, 9) as quality_score, quality_bucket, 'high_all' as subset_name from scored_records where quality_bucket = 'high_confidence_keep'",
        "chat_messages": f"with m as (select cand_id, list_filter(list_transform(coalesce(prompt, []), lambda x: {{'r': {S.strip('x.\"role\"')}, 'c': {S.strip('x.\"content\"')}}}), lambda x: x.r in ('user', 'assistant') and x.c <> '') as k, {S.strip("coalesce(risk_level, '')")} as h from candidates), t as (select cand_id, case when h <> '' then list_concat([{{'r': 'system', 'c': h}}], k) else k end as m from m) select cand_id, len(m)::int as n_messages, md5(coalesce(array_to_string(list_transform(m, lambda x: x.r || ': ' || x.c), chr(10) || chr(10)), '')) as chat_md5 from t",
        "conversation_references": f"with c as (select record_id, {conv} as t from scored_records) select record_id, (len(t) - 1)::int as n_prompt, md5(t[-2].\"value\") as question_md5, md5(t[-1].\"value\") as reference_md5 from c where t[-1].\"from\" = 'gpt' and t[-2].\"from\" = 'human'",
        "sole_themes": "with t as (select lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) as k from orders) select case k when 'urgent' then 'Urgent care' when 'high' then 'High' else k end as theme, count(*) as n, count(*) as levels from t group by 1",
        "graded_items": "select rubric, count(*) as n, count(*) filter (length(rubric) % 2 = 0) as met from (select coalesce(t.x, '') as rubric from candidates, unnest(slice_tags) as t(x)) group by 1",
        "typed_answers": "select p_partkey, case when p_partkey % 4 = 0 and p_size <> 0 then p_size::varchar when p_partkey % 4 = 1 then p_name when p_partkey % 4 = 2 then p_brand || '|' || p_type else '3 May ' || p_size end as values, case when p_partkey % 4 = 0 then 'number' when p_partkey % 4 = 1 then 'span' when p_partkey % 4 = 2 then 'spans' else 'date' end as kind from part",
        "release_dates": "select o_orderkey, case when o_orderkey % 3 = 2 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders",
        "replicated_examples": "select o_orderpriority, r::int as replicate, count(*) as n, sum(o_orderkey)::bigint as keys from orders, range(1, 4) t(r) group by all",
        "most_common": "select row_number() over (order by n desc, first)::int as place, source, n from (select source, count(*) as n, min(doc_id) as first from documents where source is not null group by 1)",
        "prompt_lengths": "with t as (select cand_id, len(regexp_extract_all(question, '\\p{Latin}+|[0-9]|[^ \\t\\n\\x0b\\f\\r]')) as n_tokens from candidates where question is not null) select cand_id, n_tokens::int as n_tokens from t where n_tokens <= 120",
        "model_filter": "select 'm' || (l_suppkey % 5) as model, count(*) as n from lineitem where l_suppkey % 5 in (1, 3) group by 1",
        "reference_fan_out": "with r as (select cand_id, reference_answer_kind, list_filter([reference_answer, negative_reference_answer], lambda x: x is not null) as x from candidates where reference_answer_kind is not null and reference_answer is not null) select cand_id, reference_answer_kind, (i - 1)::int as i, md5(x[i]) as completion_md5 from (select *, unnest(range(1, len(x) + 1)) as i from r)",
        "choice_letters": "select p_partkey, case when p_partkey % 11 = 0 then null else substr('ABCDABCD', (p_partkey % 8 + 1)::int, 1) end as letter from part",
        "grader_letters": "select cand_id, coalesce(nullif(regexp_extract('grade ' || upper(substr(md5(cand_id::varchar), 1, 3)), '[ABC]'), ''), 'C') as grade, cand_id % 3 = 0 as equal from candidates",
        "usage_counters": "select p_partkey, p_size::bigint as input, case when p_partkey % 2 = 0 then p_size + 1 else p_size * 2 end::bigint as output, case when p_partkey % 2 = 0 then 2 * p_size + 1 else p_size * 3 end::bigint as total, case when p_partkey % 2 = 0 then 2 end::bigint as cached from part",
        "tag_titles": "with t as (select distinct unnest(slice_tags) as tag from candidates), x as (select tag, translate(string_split('theme:' || tag, ':')[-1], '_-', '  ') as t from t where tag is not null) select tag, upper(substr(t, 1, 1)) || lower(substr(t, 2)) as title from x",
        "model_judged": f"select source_dataset, count(*) as n, count(*) filter (md5({before} || coalesce(question, '') || {between} || coalesce(risk_level, '') || {after}) < '8') as met from candidates group by 1",
        "pairs_rewritten": f"select pair_id, md5({S.collapse('response_chosen')}) as chosen_md5, md5({S.collapse('response_rejected')}) as rejected_md5, null::varchar as error from preference_pairs",
        "files_lines": "select cand_id, md5(coalesce(question, 'null')) as question_md5, source_dataset from candidates",
        "files_csv": "select o_orderkey, md5('a \"b\", ' || o_orderpriority || chr(10) || 'x') as text_md5 from orders",
        "files_buckets": "select coalesce(nullif(quality_bucket, ''), 'none') as bucket, count(*) as n, sum(record_id)::bigint as ids from scored_records group by 1",
        "split_sides": "select unnest(['train', 'valid', 'both']) as side, true as has",
        "loosely_equal_answers": f"with t as (select {tok.format('response_chosen')} as a, {tok.format('response_rejected')} as b from preference_pairs), j as (select coalesce({joined.format('a')}, '') as x, coalesce({joined.format('b')}, '') as y from t) select case when x = '' or y = '' then x = y else contains(x, y) or contains(y, x) end as equal, count(*) as n from j group by 1",
    }
