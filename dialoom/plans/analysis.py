"""Queries of reports and analysis: metric aggregates, distributions, frontiers, costs, answers, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.operators import evaluation as E
from dialoom.operators import vectors as V
from dialoom.plans import sqltext as S
from dialoom.session import broadcast_within, durable, table


def _metrics(s, d):
    """Sparse metric maps to one row per metric: mean, spread, extremes, count."""
    c = table(s, d, "candidates").select(F.explode("slice_scores").alias("metric", "v")).where("v is not null")
    return c.groupBy("metric").agg(F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 9).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("v").alias("n"))


def _long(s, d):
    """Wide feature structs as (source, metric, value) rows."""
    f = table(s, d, "scored_records").select(T.name_key(F.col("curation_source")).alias("source"), "features.*")
    cols = [c for c in f.columns if c != "source"]
    long = f.unpivot(["source"], cols, "metric", "value").where("value is not null and source is not null")
    return long.groupBy("source", "metric").agg(F.round(F.avg("value"), 9).alias("value"), F.count(F.lit(1)).alias("n"))


def _wide(s, d):
    r = _long(s, d).where("metric in ('length_score', 'hedging_score', 'referral_score')")
    return r.groupBy("source").pivot("metric", ["length_score", "hedging_score", "referral_score"]).agg(F.first("value"))


def _drill(s, d):
    """Dataset, risk and their counts with shares of the parent; roll-up rows have a null risk."""
    r = table(s, d, "candidates").rollup("source_dataset", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).where("level < 3")
    total = F.sum(F.when(F.col("level") == 1, F.col("n"))).over(Window.partitionBy("source_dataset"))
    return r.select("source_dataset", F.when(F.col("level") == 0, F.coalesce("risk_level", F.lit("none"))).alias("risk_level"), "n", F.round(F.col("n") / total, 9).alias("share"))


def _quantiles(s, d):
    p = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    r = table(s, d, "candidates").select(F.coalesce(F.size("prompt"), F.lit(0)).alias("turns"), F.length(F.coalesce("question", F.lit(""))).alias("chars"))
    row = r.agg(*[F.percentile(c, F.array(*map(F.lit, p))).alias(c) for c in ("turns", "chars")])
    return row.select(F.posexplode(F.arrays_zip("turns", "chars")).alias("i", "x")).select("i", F.round("x.turns", 6).alias("turns"), F.round("x.chars", 6).alias("chars"))


def _distinct(s, d):
    c = table(s, d, "candidates").select("cand_id", F.explode("selection_signals").alias("signal")).where("signal is not null")
    per = c.groupBy("signal").agg(F.countDistinct("cand_id").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("n") > 1).alias("repeated"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"))


def _has_any(s, d):
    c = table(s, d, "candidates")
    return c.groupBy("source_dataset").agg(F.bool_or(F.coalesce(F.array_contains("slice_tags", "emergency"), F.lit(False))).alias("any_emergency"), F.countDistinct(T.name_key(F.col("risk_level"))).alias("risks"))


def _density(s, d):
    """Density histogram of event values clipped to 0..100 in 20 bins, the last one closed."""
    e = table(s, d, "events").where("value is not null").select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value"))).alias("v"))
    b = e.groupBy(F.least(F.lit(19), F.floor(F.col("v") / 5).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.select("bin", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) / 5, 9).alias("density"))


def _correlation(s, d):
    e = table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    rank = lambda c, name: E.mid_ranks(e, ["l_returnflag"], c).select("l_returnflag", c, F.col("rank").alias(name))
    r = e.join(rank("l_quantity", "rq"), ["l_returnflag", "l_quantity"]).join(rank("l_extendedprice", "rp"), ["l_returnflag", "l_extendedprice"])
    return r.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"), F.round(F.corr("rq", "rp"), 6).alias("spearman"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"),
    )


def _cost(s, d):
    """Average cost per order of each part type, prices joined."""
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    li = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    r = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_orderkey").agg(F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("cost"))
    return r.groupBy("p_brand").agg(F.round(F.avg("cost"), 4).alias("mean_cost"), F.count(F.lit(1)).alias("orders"))


def _frontier(s, d):
    """Days on which the day's revenue beat every day before."""
    li = table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return E.running_record(li, [], [F.col("day")], "revenue").select("day", "revenue")


def _family_rank(s, d):
    p = table(s, d, "part")
    return p.withColumn("rank", F.least(F.rank().over(Window.partitionBy("p_brand").orderBy("p_retailprice")) - 1, F.lit(2))).groupBy("p_brand", "rank").agg(F.count(F.lit(1)).alias("n"))


def _grades(s, d):
    """Three-way grades per event type: correct, incorrect, not attempted, then accuracy given attempted and F1."""
    e = table(s, d, "events").select("event_type", F.when(F.col("value") > 60, "c").when(F.col("value") > 25, "i").otherwise("n").alias("g"))
    r = e.groupBy("event_type").agg(*[F.avg((F.col("g") == k).cast("double")).alias(k) for k in "cin"])
    acc = F.when(F.col("c") + F.col("i") > 0, F.col("c") / (F.col("c") + F.col("i"))).otherwise(0.0)
    f1 = F.when(acc + F.col("c") > 0, 2 * acc * F.col("c") / (acc + F.col("c"))).otherwise(0.0)
    return r.select("event_type", F.round("c", 9).alias("correct"), F.round("i", 9).alias("incorrect"), F.round("n", 9).alias("not_attempted"), F.round(acc, 9).alias("given_attempted"), F.round(f1, 9).alias("f1"))


def _category(s, d):
    """Accuracy by nation and by region."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    c = table(s, d, "customer").join(broadcast_within(n, 10_000), F.col("c_nationkey") == F.col("n_nationkey")).join(broadcast_within(r, 10_000), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return c.rollup("r_name", "n_name").agg(F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _error_view(s, d):
    r = _metrics(s, d)
    up = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 9)
    return r.select("metric", up(F.col("mean") - F.col("std")).alias("low"), up(F.col("mean") + F.col("std")).alias("high"), F.round(1 - F.col("mean"), 9).alias("error"))


def _best_reference(s, d):
    """The best overlap of an answer with either reference."""
    c = table(s, d, "candidates").where("reference_answer is not null")
    best = E.best_overlap_f1(F.col("question"), F.col("reference_answer"), F.col("negative_reference_answer"))
    return c.select("cand_id", F.round(best, 9).alias("best"))


def _concentration(s, d):
    """Shares of the largest and of the five largest sources of documents, entropy, and the flags they raise."""
    c = table(s, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source")))
    r = c.agg(F.max("p").alias("largest"), F.sum(F.when(F.col("rank") <= 5, F.col("p"))).alias("top5"), V.entropy_bits(F.col("p")).alias("entropy"), F.count(F.lit(1)).alias("groups"))
    return r.select(F.round("largest", 9).alias("largest"), F.round("top5", 9).alias("top5"), F.round("entropy", 6).alias("entropy"), "groups", (F.col("largest") > 0.12).alias("dominated"), (F.col("top5") > 0.45).alias("concentrated"))


def _cluster_stats(s, d):
    e = table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def _centroids(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return V.nearest(e, "label", "v", "vec_id", 3).select("label", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def _tfidf_clusters(s, d):
    docs = table(s, d, "documents").where("text is not null and text <> ''").select("doc_id", "text")
    v = V.ngrams_reduced(V.ngrams_counted(docs, "text"), 64)
    return V.clustered(durable(v.select("doc_id", "reduced")), "reduced", 24).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _points(s, d):
    from pyspark.ml.functions import array_to_vector

    e = table(s, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    from pyspark.ml.functions import vector_to_array

    return V.reduced(e, "v", 2).select("vec_id", F.round(vector_to_array("reduced")[0], 6).alias("x"), F.round(vector_to_array("reduced")[1], 6).alias("y"))


def _docs(s, d):
    return table(s, d, "documents").where("text is not null")


def _answers(s, d):
    """Extractions from texts: last number, letter answer, code block, object in braces, redaction."""
    t = F.col("text")
    r = _docs(s, d).select("doc_id", T.last_number(t).alias("number"), T.answer_letter(t).alias("letter"), F.md5(T.redacted(t)).alias("redacted_md5"), F.length(T.code_block(t)).alias("code_chars"))
    return r


_SQL_ANSWERS = r"""
with t as (select doc_id, text, regexp_extract_all(replace(text, ',', ''), '-?[0-9]+(?:\.[0-9]+)?')[-1] as n,
 regexp_replace(regexp_replace(regexp_replace(text, '\bwandb_v1_[A-Za-z0-9_]{20,}', '<KEY>', 'g'), '\bhf_[A-Za-z0-9]{20,}', '<TOKEN>', 'g'), '((?:API_KEY|SECRET|TOKEN|PASSWORD)\s*=\s*)\S+', '\1<HIDDEN>', 'g') as red
 from documents where text is not null)
select doc_id, case when contains(n, '.') then regexp_replace(regexp_replace(n, '0+$', ''), '\.$', '') else n end as number,
 coalesce(nullif(regexp_extract(text, '(?i)(?:answer|答案)\s*(?:is|是|:|：)?\s*\(?([A-D])\b', 1), ''), nullif(regexp_extract(text, '\(([A-D])\)', 1), ''), nullif(regexp_extract(text, '^\s*([A-D])\s*[.)）]?\s*$', 1), '')) as letter,
 md5(red) as redacted_md5, coalesce(nullif(length(regexp_extract(text, '(?s)```python\n(.*?)```', 1)), 0), length(text))::int as code_chars from t
"""


def _profile(s, d):
    """Character shares and line repetition of every document."""
    t = T.collapse(F.col("text"))
    return _docs(s, d).select("doc_id", F.round(T.top_char_share(t), 9).alias("top_char"), T.punctuation(t).alias("punctuation"), T.paragraphs(t).alias("paragraphs"), F.md5(T.clean(F.col("text"))).alias("clean_md5"), F.round(T.top_line_share(F.col("text")), 9).alias("top_line"))


def _lines(s, d):
    """Physical lines of each document, numbered from 1; blanks are skipped but counted."""
    r = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return r.where(F.trim("line") != "").select("doc_id", (F.col("i") + 1).alias("line_no"), F.md5("line").alias("line_md5"))


def _sources_union(s, d):
    """Texts of three tables under one schema, tagged by origin."""
    a = table(s, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    b = table(s, d, "preference_pairs").select(F.lit("pairs").alias("origin"), F.col("pair_id").alias("id"), F.col("question").alias("text"))
    c = table(s, d, "candidates").select(F.lit("candidates").alias("origin"), F.col("cand_id").alias("id"), F.col("question").alias("text"))
    u = a.unionByName(b).unionByName(c)
    return u.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


def _set_equality(s, d):
    """Whether two tables speak of the same samples: rows on one side only."""
    a, b = table(s, d, "preference_pairs").select("sample_id"), table(s, d, "pair_audits").select("sample_id")
    one = lambda x, y, n: x.distinct().exceptAll(y.distinct()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "n")
    both = a.intersect(b).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("side"), "n")
    return one(a, b, "pairs only").unionByName(one(b, a, "audits only")).unionByName(both)


def _number_sets(s, d):
    """Shared numbers of question and answer as sets."""
    digits = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1))
    p = table(s, d, "preference_pairs")
    return p.select("pair_id", F.size(F.array_intersect(digits("question"), digits("response_chosen"))).alias("shared"), F.size(F.array_union(digits("question"), digits("response_chosen"))).alias("either"))


def queries():
    return {
        "metric_aggregates": _metrics, "metric_long": _long, "metric_wide": _wide, "metric_error_view": _error_view, "category_drilldown": _drill, "quantile_table": _quantiles, "distinct_signals": _distinct, "has_any": _has_any, "density_histogram": _density,
        "correlations": _correlation, "mean_cost": _cost, "frontier": _frontier, "family_rank": _family_rank, "grade_rates": _grades, "category_accuracy": _category, "best_reference": _best_reference, "concentration": _concentration, "cluster_stats": _cluster_stats,
        "nearest_to_centroid": _centroids, "tfidf_clusters": _tfidf_clusters, "pca_points": _points, "answer_extraction": _answers, "text_slugs": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.slug(F.col("text"))).alias("slug_md5")), "text_profile": _profile, "numbered_lines": _lines, "tagged_union": _sources_union, "set_equality": _set_equality, "number_sets": _number_sets,
    }


def oracle_sql():
    met = "m as (select key as metric, value as v from (select unnest(map_entries(slice_scores), recursive := true) from candidates) where value is not null)"
    metric = f"with {met} select metric, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as std, min(v) as least, max(v) as most, count(v) as n from m group by metric"
    feats = ["length_score", "question_length_score", "structure_score", "referral_score", "hedging_score", "low_signal_penalty", "absolute_penalty", "repetition_penalty", "high_risk_no_referral_penalty"]
    long = "l as (" + " union all ".join(f"select {S.key('curation_source')} as source, '{f}' as metric, features.{f} as value from scored_records" for f in feats) + "), g as (select source, metric, round(avg(value), 9) as value, count(*) as n from l where value is not null and source is not null group by all)"
    dig = lambda c: f"list_distinct(regexp_extract_all(coalesce({c}, ''), '([0-9]+)', 1))"
    return {
        "metric_aggregates": metric,
        "metric_long": f"with {long} select * from g",
        "metric_wide": f"with {long} select source, max(value) filter (metric = 'length_score') as length_score, max(value) filter (metric = 'hedging_score') as hedging_score, max(value) filter (metric = 'referral_score') as referral_score from g where metric in ('length_score', 'hedging_score', 'referral_score') group by source",
        "metric_error_view": f"with a as ({metric}) select metric, round(greatest(0.0, least(1.0, mean - std)), 9) as low, round(greatest(0.0, least(1.0, mean + std)), 9) as high, round(1 - mean, 9) as error from a",
        "category_drilldown": "with g as (select source_dataset, coalesce(risk_level, 'none') as risk_level, count(*) as n from candidates group by all) select source_dataset, risk_level, n, round(n / sum(n) over (partition by source_dataset), 9) as share from g union all select source_dataset, null, sum(n)::bigint, 1.0 from g group by source_dataset",
        "quantile_table": "with r as (select coalesce(len(prompt), 0) as turns, length(coalesce(question, '')) as chars from candidates), q as (select quantile_cont(turns, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) as t, quantile_cont(chars, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) as c from r) select unnest(range(7))::int as i, round(unnest(t)::double, 6) as turns, round(unnest(c)::double, 6) as chars from q",
        "distinct_signals": "with c as (select signal, count(distinct cand_id) as n from (select cand_id, unnest(selection_signals) as signal from candidates) where signal is not null group by signal) select count(*) as signals, count(*) filter (n > 1) as repeated, min(n) as least, max(n) as most, round(avg(n), 9) as mean from c",
        "has_any": f"select source_dataset, bool_or(coalesce(list_contains(slice_tags, 'emergency'), false)) as any_emergency, count(distinct {S.key('risk_level')}) as risks from candidates group by source_dataset",
        "density_histogram": "with b as (select least(19, floor(greatest(0.0, least(100.0, value)) / 5))::int as bin, count(*) as n from events where value is not null group by 1) select bin, n, round(n / sum(n) over () / 5, 9) as density from b",
        "correlations": "with r as (select *, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as rq, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as rp from lineitem) select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as pearson, round(corr(rq, rp), 6) as spearman, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from r group by l_returnflag",
        "mean_cost": "with r as (select p_brand, l_orderkey, sum(l_quantity * p_retailprice) as cost from lineitem join part on l_partkey = p_partkey group by all) select p_brand, round(avg(cost), 4) as mean_cost, count(*) as orders from r group by p_brand",
        "frontier": "with x as (select l_shipdate::date as day, round(sum(l_extendedprice), 2) as revenue from lineitem group by 1), w as (select *, max(revenue) over (order by day rows between unbounded preceding and 1 preceding) as prev from x) select day, revenue from w where prev is null or revenue > prev",
        "family_rank": "with r as (select p_brand, least(rank() over (partition by p_brand order by p_retailprice) - 1, 2)::int as rank from part) select p_brand, rank, count(*) as n from r group by all",
        "grade_rates": "with r as (select event_type, avg((value > 60)::int) as c, avg((value > 25 and value <= 60)::int) as i, avg((value is null or value <= 25)::int) as n from (select event_type, coalesce(value, -1) as value from events) group by 1), a as (select *, case when c + i > 0 then c / (c + i) else 0.0 end as acc from r) select event_type, round(c, 9) as correct, round(i, 9) as incorrect, round(n, 9) as not_attempted, round(acc, 9) as given_attempted, round(case when acc + c > 0 then 2 * acc * c / (acc + c) else 0.0 end, 9) as f1 from a",
        "category_accuracy": "select r_name, n_name, round(avg((c_acctbal > 0)::int), 9) as accuracy, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
        "concentration": "with c as (select source, count(*) as n from documents where source is not null group by 1), p as (select *, n / sum(n) over () as p, row_number() over (order by n desc, source) as rank from c) select round(max(p), 9) as largest, round(sum(p) filter (rank <= 5), 9) as top5, round(-sum(p * log2(p + 1e-12)), 6) as entropy, count(*) as groups, max(p) > 0.12 as dominated, sum(p) filter (rank <= 5) > 0.45 as concentrated from p",
        "cluster_stats": "with e as (select label, count(*) as n from embeddings group by 1) select label, n, round(n / sum(n) over (), 9) as ratio from e",
        "nearest_to_centroid": "with l as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from l group by all), d as (select l.label, vec_id, sqrt(sum((x - m) * (x - m))) as distance from l join c using (label, i) group by all) select label, rank::int as rank, vec_id, round(distance, 6) as distance from (select *, row_number() over (partition by label order by distance, vec_id) as rank from d) where rank <= 3",
        "text_profile": f"with t as (select doc_id, {S.collapse('text')} as t, {S.clean('text')} as c, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\r\\n]'), lambda x: {S.strip('x')}), lambda x: x <> '') as l from documents where text is not null) select doc_id, round({S.top_char_share('t')}, 9) as top_char, {S.punctuation('t')} as punctuation, {S.paragraphs('t')} as paragraphs, md5(c) as clean_md5, round(case when len(l) <= 1 then 0.0 else list_max(list_transform(list_distinct(l), lambda x: len(list_filter(l, lambda y: y = x)))) / len(l) end, 9) as top_line from t",
        "answer_extraction": _SQL_ANSWERS,
        "numbered_lines": "with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as line from documents where text is not null) select doc_id, line_no::int as line_no, md5(line) as line_md5 from l where trim(line, ' ') <> ''",
        "tagged_union": "with u as (select 'documents' as origin, text from documents union all select 'pairs', question from preference_pairs union all select 'candidates', question from candidates) select origin, count(*) as n, count(text) as texts, sum(length(text))::bigint as chars from u group by origin",
        "set_equality": "with a as (select distinct sample_id from preference_pairs), b as (select distinct sample_id from pair_audits) select 'pairs only' as side, count(*) as n from (select * from a except select * from b) union all select 'audits only', count(*) from (select * from b except select * from a) union all select 'both', count(*) from (select * from a intersect select * from b)",
        "number_sets": f"select pair_id, len(list_intersect({dig('question')}, {dig('response_chosen')}))::int as shared, len(list_distinct(list_concat({dig('question')}, {dig('response_chosen')})))::int as either from preference_pairs",
    }
