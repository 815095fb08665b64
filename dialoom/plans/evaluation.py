"""Queries of rubric scoring, agreement and comparison.

Order lines stand in for judged rubric items (an order is an example, its
clerkless priority the theme, return flags the axes), suppliers for models,
events for raters and replicates.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.operators import evaluation as E
from dialoom.session import table


def _items(s, d):
    """Rubric items: points (some negative), whether met, axis."""
    li = table(s, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("example"), F.col("l_linenumber").alias("item"), (F.floor(F.col("l_quantity")) - 10).cast("double").alias("points"), (F.col("l_discount") >= 0.05).alias("met"),
        F.concat(F.lit("axis:"), F.lower("l_returnflag")).alias("axis"), F.col("l_linestatus").alias("status"),
    )


_ITEMS = "items as (select l_orderkey as example, l_linenumber as item, (floor(l_quantity) - 10)::double as points, l_discount >= 0.05 as met, 'axis:' || lower(l_returnflag) as axis, l_linestatus as status from lineitem)"
_SCORE = "sum(case when met then points else 0.0 end) / nullif(sum(case when points > 0 then points end), 0.0)"


def _scores(s, d):
    return _items(s, d).groupBy("example").agg(E.rubric_score(F.col("points"), F.col("met")).alias("score"))


def _axis(s, d):
    return _items(s, d).groupBy("example", F.substring_index("axis", ":", -1).alias("axis")).agg(E.rubric_score(F.col("points"), F.col("met")).alias("score")).where("score is not null")


def _themed(s, d):
    return _scores(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("example"), F.concat(F.lit("theme:"), F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))).alias("theme")), "example")


def _benchmark(s, d):
    """Mean of the example scores overall, by theme and by axis; clipped after the mean."""
    agg = (F.round(F.avg("score"), 9).alias("raw_mean"), F.round(E.clip(F.avg("score")), 9).alias("mean"), F.count("score").alias("n"))
    themed = _themed(s, d)
    overall = themed.agg(*agg).select(F.lit("overall").alias("dim"), F.lit("all").alias("key"), "raw_mean", "mean", "n")
    theme = themed.groupBy("theme").agg(*agg).select(F.lit("theme").alias("dim"), F.col("theme").alias("key"), "raw_mean", "mean", "n")
    axis = _axis(s, d).groupBy("axis").agg(*agg).select(F.lit("axis").alias("dim"), F.col("axis").alias("key"), "raw_mean", "mean", "n")
    return overall.unionByName(theme).unionByName(axis)


def _labels(s, d):
    """Raters: each user's verdict (value over 50) on each hour's event type."""
    e = table(s, d, "events").select(F.concat_ws(" ", "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("item"), "user_id", "event_type", F.coalesce(F.col("value") > 50, F.lit(False)).alias("label"))
    return e.groupBy("item", "event_type", "user_id").agg(F.max("label").alias("label"))


_LABELS = "labels as (select event_type || ' ' || strftime(ts, '%Y-%m-%d %H') as item, event_type, user_id, max(coalesce(value > 50, false)::int) = 1 as label from events group by all), pairs as (select a.event_type, a.user_id, a.label as own, b.label as other from labels a join labels b on a.item = b.item and a.user_id <> b.user_id)"


def _agreement(s, d):
    return E.pairwise_agreement(_labels(s, d), "item", "user_id", "label", ["event_type"]).withColumn("value", F.round("value", 9))


def _agreement_all(s, d):
    return E.pairwise_agreement(_labels(s, d).select("item", "user_id", "label"), "item", "user_id", "label").withColumn("value", F.round("value", 9))


def _agreement_f1(s, d):
    pr = E.pairwise_agreement(_labels(s, d), "item", "user_id", "label", ["event_type"])
    return E.f1_and_balanced(pr, ["event_type"]).withColumn("f1", F.round("f1", 9))


def _agreement_rater(s, d):
    return E.pairwise_agreement(_labels(s, d).select("item", "user_id", "label"), "item", "user_id", "label", alone="user_id").withColumn("value", F.round("value", 9))


def _replicates(s, d):
    """Scores of supplier-models over orders: the same order scored several times."""
    li = table(s, d, "lineitem")
    return li.select(F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model"), (F.col("l_orderkey") % 200).alias("example"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", F.round(F.col("l_discount") * 10 - 0.1, 6).alias("score"), F.col("l_quantity").alias("length"))


#: Line numbers repeat within an order here, so the place of a line takes more columns.
_PLACE = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "length", "score")
_REPL = "repl as (select 'm' || (l_suppkey % 5) as model, l_orderkey % 200 as example, l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_quantity, round(l_discount * 10 - 0.1, 6) as score, l_quantity as length from lineitem)"


def _worst(s, d):
    """Worst of k for k up to 5."""
    return E.worst_at_k(_replicates(s, d), ["model"], "example", "score", 5).select("model", "k", F.round(E.clip(F.col("value")), 9).alias("value"))


def _variability(s, d):
    """Runs are the replicates of one place in their example."""
    r = _replicates(s, d).withColumn("i", F.row_number().over(Window.partitionBy("model", "example").orderBy(*_PLACE)))
    r = r.groupBy("model", "i").agg(E.clip(F.avg("score")).alias("m"))
    return r.groupBy("model").agg(*[F.round(f("m"), 9).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max), ("std", F.stddev_pop))])


def _wins(controlled):
    return lambda s, d: E.win_rates(_replicates(s, d), "model", "example", "score", "length" if controlled else None).withColumn("value", F.round("value", 9))


def _win_matrix(s, d):
    return _wins(False)(s, d).groupBy("model").pivot("other", [f"m{i}" for i in range(5)]).agg(F.first("value"))


def _win_delta(s, d):
    a, b = _wins(False)(s, d), _wins(True)(s, d).withColumnRenamed("value", "controlled")
    return a.join(b, ["model", "other"]).select("model", "other", F.round((F.col("value") - F.col("controlled")) / F.nullif(F.col("value") - 0.5, F.lit(0.0)), 6).alias("delta"))


def _pass_at_k(s, d):
    r = _replicates(s, d).groupBy("model", "example").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0.7).alias("c"))
    return r.where("n >= 5").groupBy("model").agg(F.round(F.avg(E.pass_at_k(F.col("n"), F.col("c"), 5)), 9).alias("pass_at_5"), F.round(F.avg(E.pass_at_k(F.col("n"), F.col("c"), 1)), 9).alias("pass_at_1"))


def _bootstrap(s, d):
    r = _replicates(s, d).withColumn("_id", F.xxhash64("l_orderkey", "l_linenumber"))
    return E.bootstrap_std(r, ["model"], "score")


def _reference_stats(s, d):
    """Each order's dearest line against the mean of the others."""
    li = table(s, d, "lineitem").withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_quantity")))
    per = li.groupBy("l_orderkey").agg(F.max(F.when(F.col("rank") == 1, F.col("l_quantity"))).alias("own"), F.avg(F.when(F.col("rank") > 1, F.col("l_quantity"))).alias("ref")).where("ref is not null").withColumn("diff", F.col("own") - F.col("ref"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("diff") > 0).cast("double")), 9).alias("share_over"), F.round(F.avg(F.when(F.col("diff") > 0, F.col("diff"))), 9).alias("mean_over"), F.round(F.avg((F.col("diff") < 0).cast("double")), 9).alias("share_under"), F.round(F.avg(F.when(F.col("diff") < 0, F.col("diff"))), 9).alias("mean_under"))


def _missing(s, d):
    """Examples without a response and responses of no example, by anti joins."""
    o, li = table(s, d, "orders").select(F.col("o_orderkey").alias("k")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return o.join(li, "k", "left_anti").withColumn("side", F.lit("example")).unionByName(li.join(o, "k", "left_anti").withColumn("side", F.lit("response")))


def _cached(s, d):
    """Three tiers: a local answer, a shared one, else pending."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(s, d, "lineitem")
    local = li.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("local"))
    shared = li.where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("shared"))
    r = o.join(local, "k", "left").join(shared, "k", "left")
    return r.select("k", F.coalesce("local", "shared").alias("line"), F.when(F.col("local").isNotNull(), "local").when(F.col("shared").isNotNull(), "shared").otherwise("pending").alias("tier"))


def _consensus(s, d):
    high = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("example"))
    return _scores(s, d).join(high, "example", "left_semi").select("example", F.round("score", 9).alias("score"))


def _theme_sample(s, d):
    """The same number per theme, in hash order, so a smaller sample is part of a larger one."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    w = Window.partitionBy("o_orderpriority").orderBy(F.md5(F.concat(F.lit("42:"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    return o.withColumn("i", F.row_number().over(w)).where("i <= 15").select("o_orderkey", "o_orderpriority", "i")


def _uniform_sample(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    return o.orderBy(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(100)


def _manifest(s, d):
    return _items(s, d).groupBy("example").agg(F.count(F.lit(1)).alias("n_rubrics"), F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("tags"))


def _rater_summary(s, d):
    return _labels(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("labels"), F.countDistinct("user_id").alias("raters"), F.round(F.avg(F.col("label").cast("int")), 9).alias("share_positive"))


def _weighted(s, d):
    r = E.pairwise_agreement(_labels(s, d).select("item", "user_id", "label"), "item", "user_id", "label", alone="user_id").where("n > 50")
    return r.groupBy("metric").agg(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 9).alias("value"), F.count(F.lit(1)).alias("raters"))


def _percentile(s, d):
    """Mid-rank percentile of each user's mean among all users."""
    m = table(s, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 9).alias("mean"))
    return m.join(E.mid_ranks(m, [], "mean"), "mean").select("user_id", F.round((F.col("rank") - 0.5) / F.col("all") * 100, 6).alias("percentile"))


def queries():
    return {
        "rubric_scores": lambda s, d: _scores(s, d).select("example", F.round("score", 9).alias("score")), "rubric_axis": lambda s, d: _axis(s, d).withColumn("score", F.round("score", 9)), "rubric_benchmark": _benchmark, "rubric_manifest": _manifest, "rubric_consensus": _consensus,
        "rubric_missing": _missing, "rubric_cache_tiers": _cached, "sample_themes": _theme_sample, "sample_uniform": _uniform_sample,
        "agreement_clusters": _agreement, "agreement_overall": _agreement_all, "agreement_f1": _agreement_f1, "agreement_raters": _agreement_rater, "agreement_weighted": _weighted, "rater_summary": _rater_summary,
        "worst_at_k": _worst, "run_variability": _variability, "win_rates": _wins(False), "win_rates_length": _wins(True), "win_matrix": _win_matrix, "win_delta": _win_delta,
        "pass_at_k": _pass_at_k, "bootstrap_std": _bootstrap, "reference_stats": _reference_stats, "rank_percentiles": _percentile,
    }


def oracle_sql():
    it, la, rp = f"with {_ITEMS} ", f"with {_LABELS} ", f"with {_REPL}, placed as (select *, row_number() over (partition by model, example order by l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_quantity, score) as i from repl) "
    clip = "greatest(0.0, least(1.0, {}))"
    pr = "pr as (select event_type, 'precision' as metric, own as positive, count(*) as n, avg((own = other)::int) as value from pairs group by all union all select event_type, 'recall', other, count(*), avg((own = other)::int) from pairs group by all)"
    win = lambda c: f"m as (select a.example, a.model, b.model as other, (a.score > b.score)::int as w from placed a join placed b on a.example = b.example and a.model <> b.model and a.score <> b.score {c}), p as (select example, model, other, avg(w) as v from m group by all), w{len(c) > 0:d} as (select model, other, round(avg(v), 9) as value from p group by all)"
    ctl = "and (a.length + b.length) > 0 and abs(a.length - b.length) <= 0.1 * (a.length + b.length) / 2"
    return {
        "rubric_scores": it + f"select example, round({_SCORE}, 9) as score from items group by example",
        "rubric_axis": it + f"select * from (select example, split_part(axis, ':', -1) as axis, round({_SCORE}, 9) as score from items group by all) where score is not null",
        "rubric_benchmark": it + f", sc as (select example, {_SCORE} as score from items group by example), th as (select sc.*, 'theme:' || lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) as theme from sc join orders on o_orderkey = example), ax as (select example, split_part(axis, ':', -1) as axis, {_SCORE} as score from items group by all), u as (select 'overall' as dim, 'all' as key, score from th union all select 'theme', theme, score from th union all select 'axis', axis, score from ax where score is not null) select dim, key, round(avg(score), 9) as raw_mean, round({clip.format('avg(score)')}, 9) as mean, count(score) as n from u group by dim, key",
        "rubric_manifest": it + "select example, count(*) as n_rubrics, array_to_string(list_sort(list_distinct(list(axis))), ',') as tags from items group by example",
        "rubric_consensus": it + f"select example, round({_SCORE}, 9) as score from items where example in (select o_orderkey from orders where o_orderpriority = '1-URGENT') group by example",
        "rubric_missing": "select o_orderkey as k, 'example' as side from orders where o_orderkey not in (select l_orderkey from lineitem) union all select distinct l_orderkey, 'response' from lineitem where l_orderkey not in (select o_orderkey from orders)",
        "rubric_cache_tiers": "with l as (select l_orderkey as k, min(l_linenumber) filter (l_returnflag = 'R') as loc, min(l_linenumber) filter (l_linestatus = 'O') as sh from lineitem group by 1) select o_orderkey as k, coalesce(loc, sh) as line, case when loc is not null then 'local' when sh is not null then 'shared' else 'pending' end as tier from orders left join l on k = o_orderkey",
        "sample_themes": "select o_orderkey, o_orderpriority, i from (select *, row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey), o_orderkey) as i from orders) where i <= 15",
        "sample_uniform": "select o_orderkey from orders order by md5('7:' || o_orderkey), o_orderkey limit 100",
        "agreement_clusters": la + ", " + pr + " select event_type, metric, positive, n, round(value, 9) as value from pr",
        "agreement_overall": la + "select 'precision' as metric, own as positive, count(*) as n, round(avg((own = other)::int), 9) as value from pairs group by own union all select 'recall', other, count(*), round(avg((own = other)::int), 9) from pairs group by other",
        "agreement_f1": la + ", " + pr + ", f as (select p.event_type, p.positive, case when p.value + r.value = 0 then 0.0 else 2 * p.value * r.value / (p.value + r.value) end as f1 from pr p join pr r on p.event_type = r.event_type and p.positive = r.positive and p.metric = 'precision' and r.metric = 'recall') select event_type, positive, round(f1, 9) as f1 from f union all select event_type, null, round(avg(f1), 9) from f group by event_type having count(*) = 2",
        "agreement_raters": la + "select user_id, 'precision' as metric, own as positive, count(*) as n, round(avg((own = other)::int), 9) as value from pairs group by user_id, own union all select user_id, 'recall', other, count(*), round(avg((own = other)::int), 9) from pairs group by user_id, other",
        "agreement_weighted": la + ", r as (select user_id, 'precision' as metric, own as positive, count(*) as n, avg((own = other)::int) as value from pairs group by user_id, own union all select user_id, 'recall', other, count(*), avg((own = other)::int) from pairs group by user_id, other) select metric, round(sum(value * n) / sum(n), 9) as value, count(*) as raters from r where n > 50 group by metric",
        "rater_summary": la + "select event_type, count(*) as labels, count(distinct user_id) as raters, round(avg(label::int), 9) as share_positive from labels group by event_type",
        "worst_at_k": rp + f", r as (select *, row_number() over (partition by model, example order by score) as j, count(*) over (partition by model, example) as n from placed), f as (select model, example, k.k, n, j, score from r, range(1, 6) k(k) where k.k <= n), v as (select model, example, k, sum(score * coalesce(list_product(list_transform(range(k - 1), lambda t: (n - j - t)::double)), 1.0) * k / list_product(list_transform(range(k), lambda t: (n - t)::double))) as v from f group by all) select model, k::int as k, round({clip.format('avg(v)')}, 9) as value from v group by model, k",
        "run_variability": rp + f", m as (select model, i, {clip.format('avg(score)')} as m from placed group by model, i) select model, round(avg(m), 9) as mean, round(min(m), 9) as least, round(max(m), 9) as most, round(stddev_pop(m), 9) as std from m group by model",
        "win_rates": rp + ", " + win("") + " select model, other, value from w0",
        "win_rates_length": rp + ", " + win(ctl) + " select model, other, value from w1",
        "win_matrix": rp + ", " + win("") + " select model, " + ", ".join(f"max(value) filter (other = 'm{i}') as m{i}" for i in range(5)) + " from w0 group by model",
        "win_delta": rp + ", " + win("") + ", " + win(ctl).replace("m as", "m2 as", 1).replace("p as", "p2 as", 1).replace("from m group", "from m2 group").replace("from p group", "from p2 group") + " select model, other, round((w0.value - w1.value) / nullif(w0.value - 0.5, 0.0), 6) as delta from w0 join w1 using (model, other)",
        "pass_at_k": f"with {_REPL}, g as (select model, example, count(*) as n, count(*) filter (score > 0.7) as c from repl group by all having count(*) >= 5) select model, round(avg(case when n - c < 5 then 1.0 else 1.0 - list_product([(n - c - j)::double / (n - j) for j in [0, 1, 2, 3, 4]]) end), 9) as pass_at_5, round(avg(c::double / n), 9) as pass_at_1 from g group by model",
        "reference_stats": "with r as (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_quantity) as rank from lineitem), p as (select l_orderkey, max(l_quantity) filter (rank = 1) as own, avg(l_quantity) filter (rank > 1) as ref from r group by 1), x as (select own - ref as diff from p where ref is not null) select count(*) as n, round(avg((diff > 0)::int), 9) as share_over, round(avg(diff) filter (diff > 0), 9) as mean_over, round(avg((diff < 0)::int), 9) as share_under, round(avg(diff) filter (diff < 0), 9) as mean_under from x",
        "rank_percentiles": "with m as (select user_id, round(avg(value), 9) as mean from events group by 1) select a.user_id, round((count(*) filter (b.mean < a.mean) + count(*) filter (b.mean = a.mean) / 2.0) / count(*) * 100, 6) as percentile from m a join m b on b.mean is not null where a.mean is not null group by a.user_id, a.mean",
    }
