"""Metric logs as streams: keyed de-duplication, best-so-far, exactly-once appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.records import remaining
from dialoom.session import durable, shared_dir


def read_log(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int = 1) -> DataFrame:
    """An append-only log folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def drain(stream: DataFrame, step) -> None:
    """Runs ``step(batch, number)`` over all that is there, then stops; the checkpoint is in the shared folder."""
    place = f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(step).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; state is kept as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append_new(spark: SparkSession, path: str, key: str):
    """A batch step that appends the rows whose key the table does not hold yet: rerunning a batch adds nothing."""

    def step(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key])
        if _exists(spark, path):
            new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
        durable(new).write.mode("append").parquet(path)

    return step


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The batches whose table is complete, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and _exists(spark, f"{path}/{n}/_SUCCESS"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete table that :func:`best_so_far` has written."""
    return spark.read.parquet(f"{path}/batch={_versions(spark, path)[-1]}")


def best_so_far(path: str, by: str, value: str, order: str, best: str = "min"):
    """A batch step that keeps the best row of each group; every batch writes a table of its own beside the last one.

    A batch that is run again after a crash starts from the table before it, so
    nothing is lost between two tables and nothing counts twice.
    """
    pick = F.min_by if best == "min" else F.max_by

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(value).isNotNull())
        before = [v for v in _versions(spark, path) if v < number]
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{path}/batch={before[-1]}").select(*rows.columns))
        top = rows.groupBy(by).agg(pick(F.struct(*rows.columns), F.struct(value, order) if best == "min" else F.struct(F.col(value), -F.col(order))).alias("r")).select("r.*")
        top.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in before[:-1]:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    return step


def first_per_step(rows: DataFrame, logs: str = "logs") -> DataFrame:
    """One row per step and set of logged names, the earliest."""
    names = F.array_join(F.array_sort(F.map_keys(logs)), ",")
    return rows.withColumn("_names", names).groupBy("step", "_names").agg(F.min_by(F.struct(*rows.columns), "timestamp").alias("r")).select("r.*")


def latest(rows: DataFrame, name: str, logs: str = "logs") -> DataFrame:
    """The last row that logs ``name``."""
    return rows.where(F.map_contains_key(logs, name)).agg(F.max_by(F.struct("step", F.col(logs)[name].alias("value")), F.struct("step", "timestamp")).alias("r")).select("r.*")


def run_state(flags: DataFrame) -> DataFrame:
    """State of a run by precedence: dry run, failed, completed, partial."""
    return flags.withColumn("state", F.when(F.col("dry_run"), "dryrun").when(F.col("failed"), "failed").when(F.col("finished"), "completed").otherwise("partial"))


def progress(done: int, total: int, seconds: float) -> dict:
    """How far a run is: share, rows a second and the time that is left at that pace."""
    pace = done / seconds if seconds > 0 else 0.0
    return {"done": done, "total": total, "share": done / total if total else 1.0, "per_second": pace, "left": remaining((total - done) / pace if pace else 0)}
