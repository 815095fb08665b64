"""Queries over the event log as a metric log, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.operators import dedup
from dialoom.operators import evaluation as E
from dialoom.operators import joins
from dialoom.session import new_place, table
from dialoom.streaming import runs as R


def _events(s, d):
    return table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.from_json("props", "k int").alias("p")).withColumn("step", F.col("p.k")).drop("p")


_EV = "e as (select event_id, ts, user_id, event_type, value, json_extract(props, '$.k')::int as step from events)"


def _best(s, d):
    """Strict improvements of the value within each event type."""
    return E.running_record(_events(s, d), ["event_type"], [F.col("ts"), F.col("event_id")], "value").select("event_type", "event_id", "value")


def _dedup(s, d):
    """First event per (step, type)."""
    return dedup.first_wins(_events(s, d), ["step", "event_type"], [F.col("ts"), F.col("event_id")]).select("step", "event_type", "event_id")


def _latest(s, d):
    r = _events(s, d).where("value is not null")
    return r.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.min("value").alias("best"))


def _weighted(s, d):
    return _events(s, d).where("step is not null and value is not null").groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("step")) / F.sum("step"), 9).alias("weighted"))


def _state(s, d):
    per = _events(s, d).groupBy("user_id").agg((F.count(F.lit(1)) < 60).alias("dry_run"), F.bool_or(F.coalesce(F.col("value") > 290, F.lit(False))).alias("failed"), (F.max("value") > 150).alias("finished"))
    return R.run_state(per.na.fill(False)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _gaps(s, d):
    """Sessions: a new one after an hour of quiet."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = _events(s, d).withColumn("gap", F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double"))
    return r.groupBy("user_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > 3600)).alias("sessions"), F.count(F.lit(1)).alias("events"))


def _stream(s, d):
    return R.read_log(s, f"{d}/events.parque[t]", table(s, d, "events").schema, "parquet")


_place = new_place


def _stream_best(s, d):
    """Best value per type, kept across batches."""
    place = _place(s)
    R.drain(_stream(s, d).select("event_type", "event_id", "value"), R.best_so_far(place, "event_type", "value", "event_id", "max"))
    return R.current(s, place).select("event_type", "event_id", "value")


def _stream_append(s, d):
    """Exactly one row per identifier, however often the stream is replayed."""
    place = _place(s)
    step = R.append_new(s, place, "event_id")
    R.drain(_stream(s, d).select("event_id", "event_type"), step)
    R.drain(_stream(s, d).select("event_id", "event_type"), step)
    return s.read.parquet(place).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _stream_windows(s, d):
    """Counts per day and type through the streaming plan."""
    place = _place(s)
    agg = R.windowed(_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 day", "40 days")
    stream = agg.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(place)).option("checkpointLocation", _place(s)).trigger(availableNow=True).start()
    stream.awaitTermination()
    return s.read.parquet(place).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _salted(s, d):
    """Events joined to their users' order counts with the hot users spread."""
    u = table(s, d, "orders").groupBy((F.col("o_custkey") % 150).alias("user_id")).agg(F.count(F.lit(1)).alias("orders"))
    return joins.salted_join(_events(s, d).select("user_id", "event_id", "event_type"), u, "user_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("orders").alias("orders"))


def _complete(s, d):
    return joins.completeness(table(s, d, "preference_pairs").select("sample_id"), table(s, d, "pair_audits").select("sample_id"), "sample_id")


def queries():
    return {
        "log_best": _best, "log_dedup": _dedup, "log_latest": _latest, "log_weighted_mean": _weighted, "log_run_state": _state, "log_sessions": _gaps, "stream_best": _stream_best, "stream_append_once": _stream_append, "stream_windows": _stream_windows, "salted_join": _salted, "join_completeness": _complete,
    }


def oracle_sql():
    e = f"with {_EV} "
    return {
        "log_best": e + ", w as (select *, max(value) over (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding) as prev from e) select event_type, event_id, value from w where value is not null and (prev is null or value > prev)",
        "log_dedup": e + "select step, event_type, event_id from (select *, row_number() over (partition by step, event_type order by ts, event_id) as i from e) where i = 1",
        "log_latest": e + ", v as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as i from e where value is not null) select event_type, max(event_id) filter (i = 1) as latest, min(value) as best from v group by 1",
        "log_weighted_mean": e + "select event_type, round(sum(value * step) / sum(step), 9) as weighted from e where step is not null and value is not null group by 1",
        "log_run_state": e + ", u as (select user_id, count(*) < 60 as dry, coalesce(bool_or(value > 290), false) as failed, coalesce(max(value) > 150, false) as fin from e group by 1) select case when dry then 'dryrun' when failed then 'failed' when fin then 'completed' else 'partial' end as state, count(*) as n from u group by 1",
        "log_sessions": e + ", g as (select user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts, event_id) as gap from e) select user_id, count(*) filter (gap is null or gap > 3600) as sessions, count(*) as events from g group by 1",
        "stream_best": "select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) as i from events where value is not null) where i = 1",
        "stream_append_once": "select event_type, count(distinct event_id) as n from events group by 1",
        "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
        "salted_join": "with u as (select o_custkey % 150 as user_id, count(*) as orders from orders group by 1) select event_type, count(*) as n, sum(orders)::bigint as orders from events join u using (user_id) group by 1",
        "join_completeness": "with p as (select distinct sample_id from preference_pairs), a as (select sample_id, count(*) as n from pair_audits group by 1) select coalesce(p.sample_id, a.sample_id) as sample_id, case when a.n is null then 'missing' when p.sample_id is null then 'unexpected' else 'repeated' end as state from p full join a on p.sample_id = a.sample_id where a.n is null or p.sample_id is null or a.n > 1",
    }
