"""Queries of the curation funnel over scored_records: normalise, validate, filter, de-duplicate, score, select."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import conversation as C
from dialoom.functions import markers as M
from dialoom.functions import text as T
from dialoom.operators import dedup, quotas
from dialoom.plans import sqltext as S
from dialoom.session import table


def _mean(c: str):
    """A mean that does not depend on the order of the sum: the sum is rounded, the quotient is not."""
    return F.round(F.sum(c), 9) / F.count(c)


def _rows(s, d) -> DataFrame:
    """Leniently normalised conversations with their source and place."""
    r = table(s, d, "scored_records")
    return r.select("record_id", F.coalesce(T.name_key(F.col("curation_source")), F.lit("unknown")).alias("source"), C.lenient(F.col("conversations")).alias("conv"))


def _reasoned(s, d) -> DataFrame:
    q, a = C.last_values(F.col("conv"))
    r = _rows(s, d).select("record_id", "source", C.digest(F.col("conv")).alias("hash"), q.alias("q"), a.alias("a"), C.rule_reasons(F.col("conv")).alias("reasons"))
    return dedup.mark_duplicates(r, "hash", "reasons", "record_id")


def _features(s, d) -> DataFrame:
    r = _reasoned(s, d).where(F.size("reasons") == 0)
    return r.select("record_id", "source", "hash", *[c.alias(k) for k, c in C.quality_features(F.col("q"), F.col("a")).items()])


def _scored(s, d) -> DataFrame:
    return _features(s, d).withColumn("score", F.round(C.quality_total(), 9)).withColumn("bucket", C.quality_bucket(F.col("score")))


_SQL_ROWS = f"""
rows0 as (select record_id, coalesce({S.key('curation_source')}, 'unknown') as source, {S.lenient('conversations')} as conv from scored_records),
rows1 as (select *, {S.digest('conv')} as hash, coalesce(conv[-2]."value", '') as q, coalesce(conv[-1]."value", '') as a from rows0),
rows2 as (select *, case when len(conv) = 0 then ['empty_conversations'] when len(conv) < 2 then ['too_few_turns'] else list_sort(list_filter([
  case when len(conv) > 12 then 'too_many_turns' end, case when len(conv) % 2 <> 0 then 'odd_turn_count' end,
  case when len(list_filter(conv, lambda x, i: x."from" <> case when i % 2 = 1 then 'human' else 'gpt' end)) > 0 then 'role_order_invalid' end,
  case when length(q) < 4 then 'user_too_short' end, case when length(q) > 1500 then 'user_too_long' end,
  case when length(a) < 24 then 'assistant_too_short' end, case when length(a) > 4000 then 'assistant_too_long' end,
  case when {S.punctuation('a')} < 1 then 'assistant_low_structure' end, case when {S.top_char_share('a')} > 0.35 then 'assistant_char_repeat' end,
  case when a in ({', '.join(map(S.q, M.RULE_LOW_SIGNAL))}) then 'assistant_low_signal' end,
  case when length(a) < 80 and {S.has_any('a', M.RULE_DEFERRAL)} then 'assistant_generic_deferral' end], lambda r: r is not null)) end as base from rows1),
rows3 as (select *, case when len(base) = 0 and row_number() over (partition by hash, len(base) = 0 order by record_id) > 1 then ['duplicate_conversation'] else base end as reasons from rows2),
feats as (select record_id, source, hash, {S.band('length(a)', 80, 900, 24, 2200)} as length_score, {S.band('length(q)', 12, 280, 4, 1200)} as question_length_score,
  least(1.0, 0.35 * ({S.punctuation('a')} >= 3)::int + 0.35 * ({S.paragraphs('a')} >= 2)::int + 0.30 * least({S.hits('a', M.QUALITY_STRUCTURE)}, 2)) as structure_score,
  case when {S.has_any('a', M.QUALITY_REFERRAL)} then 0.6 else 0.0 end as referral_score, least(1.0, {S.hits('a', M.QUALITY_HEDGING)} / 2.0) as hedging_score,
  case when {S.has_any('a', M.QUALITY_LOW_SIGNAL)} then 0.55 when length(a) < 48 then 0.45 else 0.0 end as low_signal_penalty, least(1.0, {S.hits('a', M.QUALITY_ABSOLUTE)} / 2.0) as absolute_penalty,
  least(1.0, greatest({S.top_char_share('a')} - 0.18, 0.0) * 2.2) as repetition_penalty,
  case when {S.has_any('q', M.QUALITY_HIGH_RISK)} and not {S.has_any('a', M.QUALITY_REFERRAL)} then 1.0 else 0.0 end as high_risk_no_referral_penalty from rows3 where len(reasons) = 0),
scored as (select *, round(greatest(0.0, least(1.0, {' + '.join(f'({w}) * {k}::double' for k, w in zip(C.FEATURES, C.WEIGHTS))})), 9) as score from feats),
bucketed as (select *, case when score >= 0.72 then 'high_confidence_keep' when score < 0.45 then 'high_risk_drop' else 'borderline_review' end as bucket from scored)
"""


def _funnel(s, d):
    return _scored(s, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), _mean("score").alias("mean_score"))


def _filter_report(s, d):
    """Per source and, under a null source, for all: seen, kept, rejected, duplicates, share kept."""
    r = _reasoned(s, d)
    out = r.rollup("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("reasons") == 0).alias("kept"), F.count_if(F.size("reasons") > 0).alias("rejected"),
        F.count_if(F.array_contains("reasons", "duplicate_conversation")).alias("duplicates"), (F.count_if(F.size("reasons") == 0) / F.count(F.lit(1))).alias("keep_ratio"),
    )
    return out


def _reason_counts(s, d):
    r = _reasoned(s, d).select("source", F.explode("reasons").alias("reason"))
    return r.groupingSets([[F.col("source"), F.col("reason")], [F.col("reason")]], "source", "reason").agg(F.count(F.lit(1)).alias("n"))


def _buckets(s, d):
    r = _scored(s, d).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 9))


def _means(s, d):
    r = _scored(s, d)
    return r.groupBy("source").agg(_mean("score").alias("mean_score"), *[_mean(f).alias(f) for f in C.FEATURES])


def _histogram(s, d):
    r = _scored(s, d).groupBy(F.least(F.lit(9), F.floor(F.col("score") * 10).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    return s.range(10).select(F.col("id").cast("int").alias("bin")).join(r, "bin", "left").select("bin", F.coalesce("k", F.lit(0)).alias("n"))


def _pivot(s, d):
    r = _scored(s, d).groupBy("source").pivot("bucket", ["high_confidence_keep", "borderline_review", "high_risk_drop"]).count()
    return r.na.fill(0)


def _given(s, d) -> DataFrame:
    """The stored scores, where they are usable."""
    r = table(s, d, "scored_records").where("quality_score between 0 and 1 and curation_hash is not null")
    return r.select("record_id", T.name_key(F.col("curation_source")).alias("source"), "curation_hash", "quality_score", T.name_key(F.col("quality_bucket")).alias("bucket")).where("source is not null")


_SQL_GIVEN = f"given as (select record_id, {S.key('curation_source')} as source, curation_hash, quality_score, {S.key('quality_bucket')} as bucket from scored_records where quality_score between 0 and 1 and curation_hash is not null and curation_source is not null)"
_BEST = "quality_score desc, curation_hash, record_id"
_TOP, _FILL = 200, 900


def _top_high(s, d):
    return _given(s, d).where("bucket = 'high_confidence_keep'").orderBy(F.desc("quality_score"), "curation_hash", "record_id").limit(_TOP).select("record_id")


def _high_fill(s, d):
    rank = F.when(F.col("bucket") == "high_confidence_keep", 0).otherwise(1)
    return _given(s, d).where("bucket in ('high_confidence_keep', 'borderline_review')").orderBy(rank, F.desc("quality_score"), "curation_hash", "record_id").limit(_FILL).select("record_id", "bucket")


def _source_quotas(s, d):
    return quotas.proportional(_given(s, d).where("bucket = 'high_confidence_keep'"), "source", 300, [F.desc("quality_score"), F.asc("curation_hash"), F.asc("record_id")]).select("record_id", "source")


def _source_rank(s, d):
    w = Window.partitionBy("source").orderBy(F.desc("quality_score"), "curation_hash", "record_id")
    return _given(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("source", "record_id", "rank")


def _subset_report(s, d):
    r = _given(s, d).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"), _mean("quality_score").alias("mean"))
    return r


def _turn_pairs(s, d):
    """Expected speaker against the actual one at every turn; every seventh conversation is read backwards, so that there is something to find."""
    conv = F.when(F.col("record_id") % 7 == 0, F.reverse("conv")).otherwise(F.col("conv"))
    r = _rows(s, d).select("record_id", F.posexplode(conv).alias("turn", "x"))
    prev = F.lag("x").over(Window.partitionBy("record_id").orderBy("turn"))
    return r.withColumn("before", prev["from"]).where((F.col("x.from") == F.col("before")) | ((F.col("turn") == 0) & (F.col("x.from") != "human"))).select("record_id", "turn", F.col("x.from").alias("speaker"))


def _strict(s, d):
    r = table(s, d, "scored_records")
    e = C.strict_error(F.col("conversations"))
    return r.groupBy(F.coalesce(e, F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_SQL_STRICT = f"""
t as (select record_id, conversations, list_transform(coalesce(conversations, []), lambda x: {{'r': case {S.key('x."from"')} when 'user' then 'human' when 'human' then 'human' when 'assistant' then 'gpt' when 'bot' then 'gpt' when 'gpt' then 'gpt' when 'system' then 'system' end, 'v': {S.clean('x."value"')}}}) as turns from scored_records),
b as (select *, case when turns[1].r = 'system' then turns[2:] else turns end as body from t),
o as (select case when conversations is null or len(turns) = 0 then 'empty conversation' when len(list_filter(turns, lambda x: x.r is null)) > 0 then 'unknown role' when len(list_filter(turns, lambda x: x.v = '')) > 0 then 'empty value'
 when len(list_filter(body, lambda x, i: x.r <> case when i % 2 = 1 then 'human' else 'gpt' end)) > 0 then 'roles out of order' when len(body) < 2 or len(body) % 2 <> 0 then 'incomplete exchange' else 'valid' end as outcome from b)
"""


def _payload(s, d):
    q, a = C.last_values(F.col("conv"))
    r = _rows(s, d).where(F.size("conv") >= 2).select("record_id", F.concat(F.lit("问题："), q, F.lit("\n回答："), a).alias("payload"), F.size("conv").alias("turns"), F.length(q).alias("question_chars"), F.length(a).alias("answer_chars"))
    return r.select("record_id", F.md5("payload").alias("payload_md5"), "turns", "question_chars", "answer_chars")


def _exact(s, d):
    """Exact repeats inside each source, the first kept."""
    r = _rows(s, d).withColumn("hash", C.digest(F.col("conv")))
    n = r.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    kept = dedup.first_wins(r.select("source", "hash", "record_id"), ["source", "hash"], [F.col("record_id")]).groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.sum("record_id").alias("id_sum"))
    return n.join(kept, "source").withColumn("duplicates", F.col("rows") - F.col("kept"))


def _first_examples(s, d):
    w = Window.partitionBy("bucket").orderBy("record_id")
    return _given(s, d).withColumn("i", F.row_number().over(w)).where("i <= 3").select("bucket", "i", "record_id")


def _chat(s, d):
    """Chat roles and a rendered transcript."""
    name = lambda r: F.when(r == "human", "user").when(r == "gpt", "assistant").otherwise(r)
    r = _rows(s, d).withColumn("text", F.array_join(F.transform("conv", lambda x: F.concat(name(x["from"]), F.lit(": "), x["value"])), "\n"))
    return r.select("record_id", F.md5("text").alias("rendered_md5"), F.length("text").alias("chars"))


def _spans(s, d):
    """Character spans of the answers in the rendered transcript, by running length."""
    r = _rows(s, d).select("record_id", F.posexplode("conv").alias("turn", "x"))
    size = F.length("x.from") + 2 + F.length("x.value") + 1
    before = F.coalesce(F.sum(size).over(Window.partitionBy("record_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("start", before + F.length("x.from") + 2).where(F.col("x.from") == "gpt")
    return r.select("record_id", "turn", "start", (F.col("start") + F.length("x.value")).alias("stop"))


def queries():
    return {
        "curation_funnel": _funnel,
        "curation_reasons": lambda s, d: _reasoned(s, d).select("record_id", F.array_join("reasons", ",").alias("reasons")),
        "curation_filter_report": _filter_report,
        "curation_reason_counts": _reason_counts,
        "curation_features": lambda s, d: _features(s, d).select("record_id", *[F.round(f, 9).alias(f) for f in C.FEATURES]),
        "curation_scored": lambda s, d: _scored(s, d).select("record_id", "score", "bucket"),
        "curation_bucket_ratios": _buckets,
        "curation_bucket_pivot": _pivot,
        "curation_means": _means,
        "curation_histogram": _histogram,
        "curation_hashes": lambda s, d: _rows(s, d).select("record_id", C.digest(F.col("conv")).alias("hash")),
        "curation_exact_dedup": _exact,
        "curation_top_high": _top_high,
        "curation_high_fill": _high_fill,
        "curation_source_quotas": _source_quotas,
        "curation_source_rank": _source_rank,
        "curation_subset_report": _subset_report,
        "curation_turn_order": _turn_pairs,
        "curation_strict_outcomes": _strict,
        "curation_payload": _payload,
        "curation_examples": _first_examples,
        "curation_chat_render": _chat,
        "curation_answer_spans": _spans,
    }


def oracle_sql():
    w, g = "with " + _SQL_ROWS, "with " + _SQL_GIVEN
    return {
        "curation_funnel": w + "select bucket, count(*) as n, round(sum(score), 9) / count(score) as mean_score from bucketed group by bucket",
        "curation_reasons": w + "select record_id, array_to_string(reasons, ',') as reasons from rows3",
        "curation_filter_report": w + "select source, count(*) as total, count(*) filter (len(reasons) = 0) as kept, count(*) filter (len(reasons) > 0) as rejected, count(*) filter (list_contains(reasons, 'duplicate_conversation')) as duplicates, count(*) filter (len(reasons) = 0) / count(*) as keep_ratio from rows3 group by rollup(source)",
        "curation_reason_counts": w + ", e as (select source, unnest(reasons) as reason from rows3) select source, reason, count(*) as n from e group by grouping sets ((source, reason), (reason))",
        "curation_features": w + f"select record_id, {', '.join(f'round({f}::double, 9) as {f}' for f in C.FEATURES)} from feats",
        "curation_scored": w + "select record_id, score, bucket from bucketed",
        "curation_bucket_ratios": w + "select source, bucket, count(*) as n, round(count(*) / sum(count(*)) over (partition by source), 9) as ratio from bucketed group by source, bucket",
        "curation_bucket_pivot": w + "select source, count(*) filter (bucket = 'high_confidence_keep') as high_confidence_keep, count(*) filter (bucket = 'borderline_review') as borderline_review, count(*) filter (bucket = 'high_risk_drop') as high_risk_drop from bucketed group by source",
        "curation_means": w + f"select source, round(sum(score), 9) / count(score) as mean_score, {', '.join(f'round(sum({f}::double), 9) / count({f}) as {f}' for f in C.FEATURES)} from bucketed group by source",
        "curation_histogram": w + "select r.bin::int as bin, count(score) as n from range(10) r(bin) left join bucketed on least(9, floor(score * 10)) = r.bin group by 1",
        "curation_hashes": w + "select record_id, hash from rows1",
        "curation_exact_dedup": w + ", k as (select source, hash, min(record_id) as m from rows1 group by all), n as (select source, count(*) as rows from rows1 group by all) select source, n.rows, count(*) as kept, sum(m)::bigint as id_sum, n.rows - count(*) as duplicates from k join n using (source) group by source, n.rows",
        "curation_top_high": g + f"select record_id from given where bucket = 'high_confidence_keep' order by {_BEST} limit {_TOP}",
        "curation_high_fill": g + f"select record_id, bucket from given where bucket in ('high_confidence_keep', 'borderline_review') order by bucket <> 'high_confidence_keep', {_BEST} limit {_FILL}",
        "curation_source_rank": g + f"select source, record_id, rank from (select *, row_number() over (partition by source order by {_BEST}) as rank from given) where rank <= 5",
        "curation_subset_report": g + "select source, bucket, count(*) as n, round(sum(quality_score), 9) / count(quality_score) as mean from given group by all",
        "curation_turn_order": w + ", f as (select record_id, case when record_id % 7 = 0 then list_reverse(conv) else conv end as conv from rows1), e as (select record_id, unnest(range(len(conv))) as turn, unnest(conv) as x from f), l as (select *, lag(x.\"from\") over (partition by record_id order by turn) as before from e) select record_id, turn::int as turn, x.\"from\" as speaker from l where x.\"from\" = before or (turn = 0 and x.\"from\" <> 'human')",
        "curation_strict_outcomes": "with " + _SQL_STRICT + "select outcome, count(*) as n from o group by outcome",
        "curation_payload": w + "select record_id, md5('问题：' || q || chr(10) || '回答：' || a) as payload_md5, len(conv) as turns, length(q) as question_chars, length(a) as answer_chars from rows1 where len(conv) >= 2",
        "curation_examples": g + "select bucket, i, record_id from (select *, row_number() over (partition by bucket order by record_id) as i from given) where i <= 3",
        "curation_chat_render": w + ", t as (select record_id, array_to_string(list_transform(conv, lambda x: case x.\"from\" when 'human' then 'user' when 'gpt' then 'assistant' else x.\"from\" end || ': ' || x.\"value\"), chr(10)) as t from rows1) select record_id, md5(t) as rendered_md5, length(t) as chars from t",
        "curation_answer_spans": w + ", e as (select record_id, unnest(range(len(conv))) as turn, unnest(conv) as x from rows1), l as (select *, coalesce(sum(length(x.\"from\") + 3 + length(x.\"value\")) over (partition by record_id order by turn rows between unbounded preceding and 1 preceding), 0) + length(x.\"from\") + 2 as start from e) select record_id, turn::int as turn, start::bigint as start, (start + length(x.\"value\"))::bigint as stop from l where x.\"from\" = 'gpt'",
    }
