"""Problem 4: a score cutoff per source that keeps a target fraction.

Within a source the records stand in order of score and identifier; the cutoff
is the score at the position of the wanted count, and all records at or above it
are kept, so equal scores stay together and the identifier never decides who
stays. The position is exact; :func:`dialoom.operators.cutoffs.group_cutoffs`
finds it from counts, bin by bin, so that a source with a third of all rows or a
score shared by a third of all rows never meets one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.text import name_key
from dialoom.operators.cutoffs import group_cutoffs
from dialoom.session import rows_within

#: Targets up to this many rows are broadcast; with more, both sides are shuffled.
MAX_TARGETS = 100_000


def _targets(targets: DataFrame) -> DataFrame:
    """One row a source; of repeated targets of a source the largest counts."""
    t = targets.select(name_key(F.col("curation_source")).alias("_source"), F.col("keep_per_mille").cast("long").alias("_per_mille"))
    return t.where("_source is not null and _per_mille is not null").groupBy("_source").agg(F.max("_per_mille").alias("_per_mille"))


def _counted(records: DataFrame, targets: DataFrame, small: bool, *more: str) -> DataFrame:
    rows = records.where((F.col("quality_score") >= 0) & (F.col("quality_score") <= 1)).select(
        "record_id", name_key(F.col("curation_source")).alias("_source"), (F.col("quality_score") + F.lit(0.0)).alias("_score"), *more
    )
    return rows.join(F.broadcast(targets) if small else targets, "_source")


def cutoffs(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``curation_source, n_counted, n_target, cutoff, n_kept`` of each source with a target and counted records.

    Null or blank-padded source names compare after trimming and lower-casing;
    null sources, and scores that are null, NaN or outside 0..1, do not count. A
    target of 0 keeps nothing and has a null cutoff. An empty table gives no row.
    """
    small = rows_within(targets, MAX_TARGETS)
    t = _targets(targets)
    rows = _counted(records, t, small)
    k = F.ceil(F.col("n") * F.least(F.greatest(F.col("_per_mille"), F.lit(0)), F.lit(1000)) / F.lit(1000.0))
    # n * per mille stays below 2^53 for up to 9e12 records, so the division by 1000 rounds to the exact ceiling
    found = group_cutoffs(rows, ["_source", "_per_mille"], "_score", k, small_groups=small)
    n = rows.where("_per_mille <= 0").groupBy("_source").agg(F.count(F.lit(1)).alias("n_counted"))
    none = n.select(F.col("_source").alias("curation_source"), "n_counted", F.lit(0).cast("long").alias("n_target"), F.lit(None).cast("double").alias("cutoff"), F.lit(0).cast("long").alias("n_kept"))
    return found.select(F.col("_source").alias("curation_source"), F.col("n").alias("n_counted"), F.col("k").alias("n_target"), "cutoff", "n_kept").unionByName(none)


def _kept(records: DataFrame, targets: DataFrame) -> DataFrame:
    small = rows_within(targets, MAX_TARGETS)
    c = cutoffs(records, targets).where("cutoff is not null").select(F.col("curation_source").alias("_source"), "cutoff")
    rows = _counted(records, _targets(targets).select("_source"), small, name_key(F.col("quality_bucket")).alias("quality_bucket"))
    rows = rows.join(F.broadcast(c) if small else c, "_source").where(F.col("_score") >= F.col("cutoff"))
    return rows.select("record_id", F.col("_source").alias("curation_source"), F.col("_score").alias("quality_score"), "quality_bucket", "cutoff")


def kept(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The kept rows: ``record_id, curation_source, quality_score, quality_bucket`` (source and bucket trimmed and lower-cased)."""
    return _kept(records, targets).drop("cutoff")


def kept_sizes(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Kept records per source and bucket beside the source's cutoff: ``curation_source, quality_bucket, n_kept, cutoff``."""
    return _kept(records, targets).groupBy("curation_source", "quality_bucket").agg(F.count(F.lit(1)).alias("n_kept"), F.min("cutoff").alias("cutoff"))
