"""Queries over preference pairs, their audits and prompt candidates: assembling, joining, tagging, rewarding, selecting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import markers as M
from dialoom.functions import rewards, slices
from dialoom.functions import text as T
from dialoom.operators import dedup, joins, quotas
from dialoom.plans import sqltext as S
from dialoom.session import durable, table

MSGS = "array<struct<role:string,content:string>>"
# Which target tag asks for which slice.
TARGETS = {"theme:communication": "communication", "theme:global_health": "global_health", "theme:hedging": "hedging", "axis:context_awareness": "context_seeking", "theme:emergency_referrals": "emergency"}


def _history(c) -> object:
    """History in either layout, objects with role and content or pairs of texts, as user and assistant turns that are not empty."""
    objects = F.from_json(c, "array<struct<role:string,content:string>>")
    pairs = F.from_json(c, "array<array<string>>")
    turn = lambda r, v: F.struct(r.alias("role"), T.clean(v).alias("content"))
    from_pairs = F.flatten(F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: F.array(turn(F.lit("user"), p[0]), turn(F.lit("assistant"), p[1]))))
    from_objects = F.transform(F.filter(objects, lambda o: T.name_key(o["role"]).isin("user", "assistant")), lambda o: turn(T.name_key(o["role"]), o["content"]))
    both = F.when(c.rlike(r"^\s*\[\s*\["), from_pairs).otherwise(from_objects)
    return F.filter(F.coalesce(both, F.array().cast(MSGS)), lambda m: m["content"] != "")


def _pairs(s, d) -> DataFrame:
    """Prompt messages, chosen and rejected of every usable pair; a system text comes first if there is one."""
    p = table(s, d, "preference_pairs")
    clean = {c: T.clean(F.col(c)) for c in ("system", "question", "response_chosen", "response_rejected")}
    p = p.select("pair_id", "sample_id", "source", "split", "ingested_at", _history(F.col("history")).alias("history"), *[v.alias(k) for k, v in clean.items()])
    lead = F.when(F.col("system") != "", F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")))).otherwise(F.array().cast(MSGS))
    ask = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    return p.withColumn("valid", (F.col("question") != "") & (F.col("response_chosen") != "") & (F.col("response_rejected") != "")).withColumn("prompt", F.concat(lead, F.col("history"), ask))


def _assembled(s, d):
    p = _pairs(s, d).where("valid")
    text = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return p.select("pair_id", F.size("prompt").alias("n_messages"), F.md5(text).alias("prompt_md5"), F.length("response_chosen").alias("chosen_chars"), F.length("response_rejected").alias("rejected_chars"))


_C = {c: S.clean(c) for c in ("system", "question", "response_chosen", "response_rejected")}
_SQL_PAIRS = f"""
p0 as (select pair_id, sample_id, source, split, ingested_at, history as h, {', '.join(f'{v} as {k}' for k, v in _C.items())} from preference_pairs),
p1 as (select *, case when h is null then [] when regexp_matches(h, '^\\s*\\[\\s*\\[') then flatten(list_transform(list_filter(from_json(h, '[["VARCHAR"]]'), lambda x: len(x) >= 2), lambda x: [{{'role': 'user', 'content': {S.clean('x[1]')}}}, {{'role': 'assistant', 'content': {S.clean('x[2]')}}}]))
 else list_transform(list_filter(from_json(h, '[{{"role":"VARCHAR","content":"VARCHAR"}}]'), lambda x: {S.key('x."role"')} in ('user', 'assistant')), lambda x: {{'role': {S.key('x."role"')}, 'content': {S.clean('x."content"')}}}) end as turns from p0),
p2 as (select *, list_filter(turns, lambda x: x."content" <> '') as hist, question <> '' and response_chosen <> '' and response_rejected <> '' as valid from p1),
p3 as (select *, list_concat(case when system <> '' then [{{'role': 'system', 'content': system}}] else [] end, hist, [{{'role': 'user', 'content': question}}]) as prompt from p2)
"""


def _invalid(s, d):
    return _pairs(s, d).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def _latest(s, d):
    p = table(s, d, "preference_pairs").select("sample_id", "pair_id", "ingested_at")
    return dedup.latest(p, "sample_id", [F.col("ingested_at"), F.col("pair_id")]).select("sample_id", "pair_id")


def _keyed(keep):
    def run(s, d):
        p = table(s, d, "preference_pairs").select("pair_id", T.strip(F.col("question")).alias("question"))
        return dedup.keyed(p, "question", "pair_id", keep).select("pair_id")

    return run


def _audited(s, d):
    """Latest audit of every sample, joined; samples without and audits of no pair show up as such."""
    a = dedup.latest(table(s, d, "pair_audits").select("sample_id", "audit_id", "audited_at", "swap_pair", "rewrite_strength"), "sample_id", [F.col("audited_at"), F.col("audit_id")])
    p = table(s, d, "preference_pairs").select("sample_id").distinct().withColumn("p", F.lit(True))
    return p.join(a.withColumn("a", F.lit(True)), "sample_id", "full").select("sample_id", "audit_id", F.coalesce("p", F.lit(False)).alias("has_pair"), F.coalesce("a", F.lit(False)).alias("has_audit"))


def _pending(s, d):
    p = table(s, d, "preference_pairs").select("sample_id").distinct()
    return p.join(table(s, d, "pair_audits").select("sample_id"), "sample_id", "left_anti")


def _audit_summary(s, d):
    a = table(s, d, "pair_audits")
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if("swap_pair").alias("swapped"), F.count_if(F.col("label_correct") == False).alias("wrong"), F.round(F.avg(F.col("swap_pair").cast("int")), 9).alias("swap_ratio"))  # noqa: E712


def _tag_counts(s, d):
    a = table(s, d, "pair_audits")
    one = lambda c, k: a.select(F.lit(k).alias("kind"), F.explode(c).alias("tag"))
    strength = a.select(F.lit("strength").alias("kind"), F.col("rewrite_strength").alias("tag"))
    return one("issue_tags", "issue").unionByName(one("target_tags", "target")).unionByName(strength).select("kind", F.lower(F.trim("tag")).alias("tag")).where("tag is not null and tag <> ''").groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))


def _sanitised(s, d):
    """A rewrite that is blank falls back to the other side's text; equal sides get the original."""
    p = table(s, d, "preference_pairs")
    chosen = F.coalesce(F.nullif(T.strip(F.col("response_chosen")), F.lit("")), F.col("response_rejected"))
    rejected = F.coalesce(F.nullif(T.strip(F.col("response_rejected")), F.lit("")), F.col("response_chosen"))
    return p.select("pair_id", F.md5(F.coalesce(chosen, F.lit(""))).alias("chosen"), F.md5(F.coalesce(F.when(chosen == rejected, F.col("response_rejected")).otherwise(rejected), F.lit(""))).alias("rejected"))


def _positional(s, d):
    """Pairs and their made identifiers, both in the order of pairs, joined by place; an error if one is longer."""
    rows = table(s, d, "preference_pairs").orderBy("pair_id").select("pair_id")
    return joins.positional(rows, _sample_ids(s, d).orderBy("pair_id")).select("pair_id", F.col("right_made_id").alias("made_id"))


def _sample_ids(s, d):
    p = table(s, d, "preference_pairs")
    return p.select("pair_id", F.format_string("%s_%05d_%s", F.coalesce("split", F.lit("none")), F.col("pair_id"), F.substring(F.md5(F.coalesce("question", F.lit(""))), 1, 10)).alias("made_id"))


def _candidates(s, d) -> DataFrame:
    return table(s, d, "candidates")


def _slice_rows(s, d) -> DataFrame:
    """Candidates with the slices their question, reference, tags and source give. The slice tags stand for target tags here, the signals for issues."""
    c = _candidates(s, d)
    theme = F.transform("slice_tags", lambda t: F.concat(F.when(t == "context_seeking", "axis:context_awareness").when(t == "emergency", "theme:emergency_referrals").otherwise(F.concat(F.lit("theme:"), t))))
    f = slices.scores(F.col("question"), F.size(F.coalesce("prompt", F.array().cast(MSGS))), F.col("source_dataset"), F.col("reference_answer"), theme, F.col("selection_signals"), TARGETS)
    c = c.select("cand_id", "question", "source_dataset", "source_hash", "selection_signals", *[F.round(x, 6).alias(k) for k, x in f.items()])
    found = {k: F.col(k) for k in M.SLICES}
    c = c.withColumn("tags", slices.tags(found)).withColumn("risk", slices.risk(F.col("question"), F.col("emergency")))
    return c.withColumn("priority", slices.priority(F.col("question"), found, F.lit(0.5), F.lit("light"), F.col("selection_signals")))


def _has_sql(x, ms):
    return S.has_any(x, ms)


def _want(sl):
    t = {"communication": "communication", "global_health": "global_health", "hedging": "hedging", "context_seeking": "context_seeking", "emergency": "emergency"}[sl]
    return f"2.0 * len(list_filter(coalesce(slice_tags, []), lambda x: x = '{t}'))"


def _issue(*names):
    return "(case when " + " or ".join(f"contains(iss, '{n}')" for n in names) + " then 1.5 else 0.0 end)"


_SQL_SLICES = f"""
c0 as (select *, lower(coalesce(question, '')) as lq, lower(coalesce(reference_answer, '')) as lr, array_to_string(coalesce(selection_signals, []), ' ') as iss, (case when len(coalesce(prompt, [])) >= 3 then 1 else 0 end) as talk,
 case when source_dataset = 'hq_holdout' then 0.2 else 0.0 end as fresh, case when length(coalesce(question, '')) >= 80 then 0.4 else 0.0 end as lng from candidates),
c1 as (select *, {S.hits('lq', M.SLICE_AMBIGUITY)} as amb, {S.hits('lq', M.SLICE_EMERGENCY)} as urg, case when {S.has_any('lq', M.SLICE_FOLLOWUP)} then 0.6 else 0.0 end as foll from c0),
c2 as (select *, round(({_want('communication')} + {_issue('poor_communication', 'too_generic', 'too_verbose')} + least(2.0, 0.6 * {S.hits('lq', M.SLICE_COMMUNICATION)}) + 0.8 * talk + foll + fresh + lng)::double, 6) as communication,
 round(({_want('global_health')} + least(3.0, 1.0 * {S.hits('lq', M.SLICE_GLOBAL_HEALTH)}) + least(1.8, 0.4 * {S.hits('lr', M.SLICE_GLOBAL_HEALTH)}) + fresh)::double, 6) as global_health,
 round(({_want('hedging')} + {_issue('overconfidence')} + least(2.0, 0.7 * amb))::double, 6) as hedging,
 round(({_want('context_seeking')} + {_issue('missing_context_awareness')} + least(2.0, 0.7 * amb) + least(2.5, 0.8 * {S.hits('lq', M.SLICE_CHECKUP)}) + case when urg > 0 then 0.5 else 0.0 end + 0.5 * talk + foll + lng)::double, 6) as context_seeking,
 round(({_want('emergency')} + {_issue('missing_emergency_referral', 'unsafe_advice')} + least(4.0, 1.4 * urg))::double, 6) as emergency from c1),
c3 as (select *, list_sort(list_filter([{', '.join(f"case when {x} >= 1.5 then '{x}' end" for x in M.SLICES)}], lambda x: x is not null)) as own from c2),
c4 as (select *, case when len(own) > 0 then own else [coalesce({', '.join(f"case when {x} = greatest({', '.join(M.SLICES)}) then '{x}' end" for x in M.SLICES)})] end as tags,
 case when emergency >= 3.0 or urg > 0 then 'high' when emergency >= 1.5 or amb >= 2 then 'medium' else 'low' end as risk,
 round((communication + global_health + hedging + context_seeking + emergency + least(1.0, length(coalesce(question, '')) / 200.0::double) + 0.5 + 0.2 + least(1.0, 0.15 * coalesce(len(selection_signals), 0)))::double, 4) as priority from c3)
"""


def _best_priority(s, d):
    """Best priority per source hash across datasets."""
    c = _candidates(s, d).where("source_hash is not null").select("cand_id", F.lower("source_hash").alias("hash"), "priority_score")
    return dedup.first_wins(c, ["hash"], [F.desc_nulls_last("priority_score"), F.col("cand_id")]).select("cand_id", "hash")


def _prompt_hash(s, d):
    text = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit("::"), F.lower(T.collapse(m["content"])))), "||")
    return _candidates(s, d).select("cand_id", F.sha1(F.coalesce(text, F.lit(""))).alias("prompt_hash"))


def _held_out(s, d):
    """Candidates whose hash no training row has; blank hashes are left out."""
    c = _candidates(s, d).select("cand_id", F.lower("source_hash").alias("hash"), T.name_key(F.col("source_split")).alias("split")).where("hash <> ''")
    return c.where("split <> 'train'").join(c.where("split = 'train'").select("hash"), "hash", "left_anti").select("cand_id")


def _rewarded(s, d) -> DataFrame:
    c = _candidates(s, d).select(
        "cand_id", F.coalesce("question", F.lit("")).alias("prompt_text"), F.coalesce("reference_answer", F.lit("")).alias("completion"), "slice_tags", F.array().cast("array<string>").alias("hard_constraints"), "risk_level",
        F.col("negative_reference_answer").alias("reference_answer"), F.lit(None).cast("string").alias("negative_reference_answer"),
    )
    return c.select("cand_id", *[f().alias(k) for k, f in rewards.REWARDS.items()])


#: Weights of the profiled rewards; what is missing weighs 1.
_PROFILE = {"communication_quality": 1.3, "context_awareness": 0.8, "hedging": 1.2, "emergency_referral": 1.5, "medical_plausibility": 0.9}
_PENALTIES = {"low_effort_penalty": 0.5, "unsafe_overclaim_penalty": 1.4}


def _profiled(s, d) -> DataFrame:
    """Rewards with hard constraints, a negative reference and weights of two profiles."""
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    c = _candidates(s, d).select(
        "cand_id", F.coalesce("question", F.lit("")).alias("prompt_text"), F.coalesce("reference_answer", F.lit("")).alias("completion"), "slice_tags", "risk_level", F.col("question").alias("reference_answer"), "negative_reference_answer", pairs(_PROFILE).alias("profile"), pairs(_PENALTIES).alias("penalties"),
        F.when(F.col("cand_id") % 3 == 0, F.array(F.lit("must_not_miss_emergency_referral"))).when(F.col("cand_id") % 3 == 1, F.array(F.lit("must_not_overclaim_without_context"))).alias("hard_constraints"),
    )
    return c.select("cand_id", *[f("penalties" if k == "safety_penalty" else "profile").alias(k) for k, f in rewards.REWARDS.items()])


def _rep(x):
    return f"(case when len({S.sentences(x)}) < 2 then 0.0 else (len({S.sentences(x)}) - len(list_distinct({S.sentences(x)}))) / len({S.sentences(x)})::double end)"


def _d(ms):
    return S.has_any("completion", ms)


def _a(ms):
    return S.has_any("prompt_text", ms)


def _w(cond, v):
    return f"(case when {cond} then {v} else 0.0 end)"


_EM = f"(coalesce(list_contains(slice_tags, 'emergency'), false) or coalesce(risk_level = 'high', false) or {_a(M.REWARD_EMERGENCY_ASKED)})"
_SQL_REWARDS = f"""
r0 as (select cand_id, coalesce(question, '') as prompt_text, coalesce(reference_answer, '') as completion, slice_tags, risk_level, coalesce(negative_reference_answer, '') as ref from candidates),
r1 as (select *, length({S.letters_only('completion')}) as n, {_rep('completion')} as rep, coalesce(list_contains(slice_tags, 'context_seeking'), false) or {_a(M.REWARD_NEEDS_CONTEXT)} as needs_context,
 coalesce(list_contains(slice_tags, 'hedging'), false) or {_a(M.REWARD_NEEDS_HEDGING)} as needs_hedging, {_EM} as emergency, {_d(M.REWARD_EMERGENCY_ADVISED)} as sent, {_d(M.REWARD_CHECKUP)} as checkup, {_d(M.REWARD_ABSOLUTE)} as absolute,
 {_d(M.REWARD_EMPATHY)} as kind, {_d(M.REWARD_LOW_INFO)} as lowinfo from r0)
"""


def _bag_sql(x):
    t = S.letters_only(x)
    return f"(case when length({t}) = 0 then [] when length({t}) = 1 then [{t}] else list_transform(range(1, length({t})), lambda i: substr({t}, i::bigint, 2)) end)"


#: Wanted rows per slice, and the share of them that each dataset should give.
_WANTED = {"communication": 900, "global_health": 700, "hedging": 600, "context_seeking": 450, "emergency": 350}
_SOURCES = {"communication": (0.4, 0.6), "global_health": (0.2, 0.8), "hedging": (0.7, 0.3), "context_seeking": (0.55, 0.45), "emergency": (0.6, 0.4)}


def _selectable(s, d) -> DataFrame:
    """The best candidate of each source hash (its identifier where there is none), with what the selection orders by."""
    c = _slice_rows(s, d)
    rows = c.select(
        F.coalesce(F.nullif(F.lower("source_hash"), F.lit("")), F.concat(F.lit("id "), F.col("cand_id").cast("string"))).alias("hash"), "cand_id", "source_dataset", "tags", "priority", F.create_map(*[x for k in M.SLICES for x in (F.lit(k), F.col(k))]).alias("scores"),
        (F.col("source_dataset") == "hq_holdout").cast("int").alias("fresh"),
    )
    return dedup.first_wins(rows, ["hash"], [F.desc("priority"), F.col("cand_id")])


def _select(c: DataFrame, total: int, taken: DataFrame | None = None) -> DataFrame:
    first, second = "hq_holdout", "dpo_v2_train"
    ratios = {k: {first: b, second: a} for k, (a, b) in _SOURCES.items()}
    order = lambda k: [F.desc(F.col("scores")[k]), F.desc("priority"), F.desc_nulls_last("fresh"), F.col("cand_id")]
    rest = [F.desc("priority"), F.desc(F.size("tags")), F.col("cand_id")]
    return quotas.greedy_slices(c, "hash", "tags", quotas.scaled(_WANTED, total), order, source="source_dataset", ratios=ratios, scores="scores", rest=rest, taken=taken)


def _selection(s, d):
    """A training and a validation selection over one pool, without a common source hash."""
    c = durable(_selectable(s, d))
    train = durable(_select(c, 300))
    valid = _select(c, 30, train)
    both = train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("valid")))
    return both.join(c.select("hash", "cand_id"), "hash").select("cand_id", "slice", "split")


def _selection_summary(s, d):
    c = _slice_rows(s, d).select("source_dataset", "risk", F.explode("tags").alias("tag"), "priority")
    return c.groupingSets([[F.col("tag")], [F.col("source_dataset")], [F.col("risk")]], "tag", "source_dataset", "risk").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("priority"), 6) / F.count("priority")).alias("mean_priority"))


def _slice_examples(s, d):
    c = _slice_rows(s, d).select("cand_id", F.explode("tags").alias("tag"), "priority")
    return c.withColumn("i", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("priority"), "cand_id"))).where("i <= 5").select("tag", "i", "cand_id")


def _constraints(s, d):
    c = _slice_rows(s, d)
    return c.select("cand_id", F.array_join(slices.hard_constraints(F.col("tags"), F.col("risk")), ",").alias("constraints"))


def queries():
    return {
        "pairs_assembled": _assembled, "pairs_invalid": _invalid, "pairs_latest": _latest, "pairs_keep_first": _keyed("first"), "pairs_keep_last": _keyed("last"), "pairs_audit_completeness": _audited, "pairs_pending": _pending,
        "pairs_audit_summary": _audit_summary, "pairs_tag_counts": _tag_counts, "pairs_sanitised": _sanitised, "pairs_positional_join": _positional, "pairs_sample_ids": _sample_ids,
        "slice_scores": lambda s, d: _slice_rows(s, d).select("cand_id", *M.SLICES), "slice_tags": lambda s, d: _slice_rows(s, d).select("cand_id", F.array_join("tags", ",").alias("tags"), "risk", "priority"), "slice_constraints": _constraints,
        "slice_best_priority": _best_priority, "slice_prompt_hash": _prompt_hash, "slice_held_out": _held_out, "slice_selection": _selection, "slice_summary": _selection_summary, "slice_examples": _slice_examples, "rewards": _rewarded, "rewards_profiled": _profiled,
    }


def oracle_sql():
    profiled = _SQL_REWARDS.replace("coalesce(negative_reference_answer, '') as ref from candidates", "coalesce(question, '') as ref, coalesce(negative_reference_answer, '') as neg, cand_id % 3 as con from candidates")
    _PROFILED = "with " + profiled.replace("as needs_context", "or con = 1 as needs_context").replace("as emergency", "or con = 0 as emergency")  # noqa: N806
    p, c, r = "with " + _SQL_PAIRS, "with " + _SQL_SLICES, "with " + _SQL_REWARDS
    k = f"with k as (select pair_id, case when coalesce({S.strip('question')}, '') = '' then 'row ' || pair_id else 'q ' || {S.strip('question')} end as k from preference_pairs) "
    return {
        "pairs_assembled": p + "select pair_id, len(prompt) as n_messages, md5(array_to_string(list_transform(prompt, lambda m: m.\"role\" || ':' || m.\"content\"), chr(10))) as prompt_md5, length(response_chosen) as chosen_chars, length(response_rejected) as rejected_chars from p3 where valid",
        "pairs_invalid": p + "select coalesce(source, 'none') as source, count(*) filter (valid) as valid, count(*) filter (not valid) as invalid from p2 group by 1",
        "pairs_latest": "select sample_id, pair_id from (select *, row_number() over (partition by sample_id order by ingested_at desc nulls last, pair_id desc) as i from preference_pairs) where i = 1",
        "pairs_keep_first": k + "select min(pair_id) as pair_id from k group by k",
        "pairs_keep_last": k + "select max(pair_id) as pair_id from k group by k",
        "pairs_audit_completeness": "with a as (select * from (select *, row_number() over (partition by sample_id order by audited_at desc nulls last, audit_id desc) as i from pair_audits) where i = 1), p as (select distinct sample_id from preference_pairs) select coalesce(p.sample_id, a.sample_id) as sample_id, audit_id, p.sample_id is not null as has_pair, a.sample_id is not null as has_audit from p full join a on p.sample_id = a.sample_id",
        "pairs_pending": "select distinct sample_id from preference_pairs where sample_id not in (select sample_id from pair_audits where sample_id is not null)",
        "pairs_audit_summary": "select count(*) as n, count(*) filter (swap_pair) as swapped, count(*) filter (label_correct = false) as wrong, round(avg(swap_pair::int), 9) as swap_ratio from pair_audits",
        "pairs_tag_counts": "with t as (select 'issue' as kind, unnest(issue_tags) as tag from pair_audits union all select 'target', unnest(target_tags) from pair_audits union all select 'strength', rewrite_strength from pair_audits) select kind, lower(trim(tag)) as tag, count(*) as n from t where trim(tag) <> '' group by all",
        "pairs_sanitised": f"with t as (select *, coalesce(nullif({S.strip('response_chosen')}, ''), response_rejected) as c, coalesce(nullif({S.strip('response_rejected')}, ''), response_chosen) as r from preference_pairs) select pair_id, md5(coalesce(c, '')) as chosen, md5(coalesce(case when c = r then response_rejected else r end, '')) as rejected from t",
        "pairs_positional_join": "select a.pair_id, made_id from (select pair_id, row_number() over (order by pair_id) as i from preference_pairs) a join (select coalesce(split, 'none') || '_' || lpad(pair_id::varchar, greatest(5, length(pair_id::varchar))::int, '0') || '_' || substr(md5(coalesce(question, '')), 1, 10) as made_id, row_number() over (order by pair_id) as i from preference_pairs) b using (i)",
        "pairs_sample_ids": "select pair_id, coalesce(split, 'none') || '_' || lpad(pair_id::varchar, greatest(5, length(pair_id::varchar))::int, '0') || '_' || substr(md5(coalesce(question, '')), 1, 10) as made_id from preference_pairs",
        "slice_scores": c + f"select cand_id, {', '.join(M.SLICES)} from c4",
        "slice_tags": c + "select cand_id, array_to_string(tags, ',') as tags, risk, priority from c4",
        "slice_constraints": c + "select cand_id, array_to_string(list_filter([case when risk = 'high' or list_contains(tags, 'emergency') then 'must_not_miss_emergency_referral' end, case when list_contains(tags, 'context_seeking') or list_contains(tags, 'hedging') then 'must_not_overclaim_without_context' end], lambda x: x is not null), ',') as constraints from c4",
        "slice_best_priority": "select cand_id, hash from (select cand_id, lower(source_hash) as hash, row_number() over (partition by lower(source_hash) order by priority_score desc nulls last, cand_id) as i from candidates where source_hash is not null) where i = 1",
        "slice_prompt_hash": f"select cand_id, sha1(coalesce(array_to_string(list_transform(prompt, lambda m: m.\"role\" || '::' || lower({S.collapse('m.\"content\"')})), '||'), '')) as prompt_hash from candidates",
        "slice_held_out": f"with c as (select cand_id, lower(source_hash) as hash, {S.key('source_split')} as split from candidates where source_hash <> '') select cand_id from c where split <> 'train' and hash not in (select hash from c where split = 'train')",
        "slice_summary": c + ", e as (select source_dataset, risk, unnest(tags) as tag, priority from c4) select tag, source_dataset, risk, count(*) as n, round(sum(priority), 6) / count(priority) as mean_priority from e group by grouping sets ((tag), (source_dataset), (risk))",
        "slice_examples": c + ", e as (select cand_id, unnest(tags) as tag, priority from c4) select tag, i, cand_id from (select *, row_number() over (partition by tag order by priority desc, cand_id) as i from e) where i <= 5",
        "rewards": r + f""", b as (select *, {_bag_sql('completion')} as ba, {_bag_sql('ref')} as bb from r1),
o as (select *, case when len(ba) = 0 or len(bb) = 0 then 0.0 else 2.0 * coalesce(list_sum(list_transform(list_distinct(list_intersect(ba, bb)), lambda x: least(len(list_filter(ba, lambda y: y = x)), len(list_filter(bb, lambda y: y = x))))), 0) / (len(ba) + len(bb)) end as f1 from b)
select cand_id,
 round(greatest(-1.2, least(1.2, (case when n = 0 then -1.0 when n < 16 then -0.8 when n < 40 then -0.25 when n <= 420 then 0.25 when n <= 700 then 0.1 else -0.2 end) + {_w('kind', 0.35)} + {_w(_d(M.REWARD_ACTION), 0.25)} + {_w(_d(M.REWARD_STRUCTURE) + " or contains(completion, chr(10))", 0.1)} - {_w(_a(M.REWARD_DISTRESS) + ' and not kind', 0.2)} - {_w('lowinfo', 0.25)} - 0.35 * rep))::double, 6) as communication,
 round((case when needs_context then greatest(-1.0, {_w(_d(M.REWARD_FOLLOWUP), 0.45)} + {_w('checkup', 0.3)} + {_w(_d(M.REWARD_HEDGING), 0.15)} - {_w('absolute', 0.85)}) else {_w('checkup', 0.1)} end)::double, 6) as context_awareness,
 round(({_w('needs_hedging and ' + _d(M.REWARD_HEDGING), 0.6)} + {_w('needs_hedging and checkup', 0.1)} - {_w('absolute', 0.8)})::double, 6) as hedging,
 round((case when emergency then case when sent then 0.85 when {_d(['尽快', '及时', '就医', '住院'])} then 0.45 else -0.75 end when sent then -0.1 else 0.0 end)::double, 6) as emergency_referral,
 round(greatest(-1.0, least(1.0, f1 + {_w(S.has_any('ref', M.REWARD_CHECKUP) + ' and checkup', 0.08)} + {_w(S.has_any('ref', M.REWARD_EMERGENCY_ADVISED) + ' and sent', 0.08)}))::double, 6) as reference_alignment,
 round(greatest(-1.5, least(0.0, {_w('n < 18', -0.55)} + {_w('lowinfo', -0.3)} + {_w('absolute', -0.6)} + {_w('emergency and not ' + _d([*M.REWARD_EMERGENCY_ADVISED, '尽快', '及时', '就医']), -0.55)} - 0.35 * rep))::double, 6) as safety_penalty from o""",
        "rewards_profiled": _PROFILED + f""", b as (select *, {_bag_sql('completion')} as ba, {_bag_sql('ref')} as bb, {_bag_sql('neg')} as bn from r1),
o as (select *, case when len(ba) = 0 or len(bb) = 0 then 0.0 else 2.0 * coalesce(list_sum(list_transform(list_distinct(list_intersect(ba, bb)), lambda x: least(len(list_filter(ba, lambda y: y = x)), len(list_filter(bb, lambda y: y = x))))), 0) / (len(ba) + len(bb)) end as f1, case when len(ba) = 0 or len(bn) = 0 then 0.0 else 2.0 * coalesce(list_sum(list_transform(list_distinct(list_intersect(ba, bn)), lambda x: least(len(list_filter(ba, lambda y: y = x)), len(list_filter(bn, lambda y: y = x))))), 0) / (len(ba) + len(bn)) end as f1n from b)
select cand_id,
 round((greatest(-1.2, least(1.2, (case when n = 0 then -1.0 when n < 16 then -0.8 when n < 40 then -0.25 when n <= 420 then 0.25 when n <= 700 then 0.1 else -0.2 end) + {_w('kind', 0.35)} + {_w(_d(M.REWARD_ACTION), 0.25)} + {_w(_d(M.REWARD_STRUCTURE) + " or contains(completion, chr(10))", 0.1)} - {_w(_a(M.REWARD_DISTRESS) + ' and not kind', 0.2)} - {_w('lowinfo', 0.25)} - 0.35 * rep)) * 1.3)::double, 6) as communication,
 round(((case when needs_context then greatest(-1.0, {_w(_d(M.REWARD_FOLLOWUP), 0.45)} + {_w('checkup', 0.3)} + {_w(_d(M.REWARD_HEDGING), 0.15)} - {_w('absolute', 0.85)}) else {_w('checkup', 0.1)} end) * 0.8)::double, 6) as context_awareness,
 round((({_w('needs_hedging and ' + _d(M.REWARD_HEDGING), 0.6)} + {_w('needs_hedging and checkup', 0.1)} - {_w('absolute', 0.8)}) * 1.2)::double, 6) as hedging,
 round(((case when emergency then case when sent then 0.85 when {_d(['尽快', '及时', '就医', '住院'])} then 0.45 else -0.75 end when sent then -0.1 else 0.0 end) * 1.5)::double, 6) as emergency_referral,
 round((greatest(-1.0, least(1.0, f1 - 0.45 * f1n + {_w(S.has_any('ref', M.REWARD_CHECKUP) + ' and checkup', 0.08)} + {_w(S.has_any('ref', M.REWARD_EMERGENCY_ADVISED) + ' and sent', 0.08)})) * 0.9)::double, 6) as reference_alignment,
 round(greatest(-1.5, least(0.0, {_w('n < 18', -0.275)} + {_w('lowinfo', -0.15)} + {_w('absolute', -0.84)} + {_w('emergency and not ' + _d([*M.REWARD_EMERGENCY_ADVISED, '尽快', '及时', '就医']), -0.55)} - 0.35 * rep))::double, 6) as safety_penalty from o""",
    }
