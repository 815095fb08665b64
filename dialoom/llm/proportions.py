"""Problem 1: a sample that matches target proportions of categories.

A cell is a (slice tag, source dataset). Every row of the pool gets a weighted
reservoir key: a waiting time ``-log(u) / priority`` with ``u`` drawn from a hash
of its identifier, and the rows with the shortest times of a cell form a weighted
reservoir of any size; reservoirs of parts merge by their keys. One pass builds the
pool with the cells of each row; the counts of that pass give the feasible
quotas, and each reservoir is then trimmed to its quota by a key cutoff that is
found in parallel (see :mod:`dialoom.operators.cutoffs`), so that no task ever
holds a cell. Keys are logarithms of the times, so no priority is too small or
too large for them; priorities of 0 or less come after all others, in uniform order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.text import name_key
from dialoom.operators.cutoffs import group_cutoffs
from dialoom.session import broadcast_within, durable, rows_within

#: Up to so many cells are broadcast; with more, both sides of their joins are shuffled.
MAX_CELLS = 10_000


def _cells(targets: DataFrame) -> DataFrame:
    """Targets with cells made unique (the larger target and the larger minimum count); null tags or datasets are no cell."""
    rows = targets.select(name_key(F.col("slice_tag")).alias("_tag"), "source_dataset", "slice_tag", "target_per_mille", "min_rows").where("_tag is not null and source_dataset is not null")
    largest = lambda c: F.max(F.coalesce(c, F.lit(0))).cast("int").alias(c)
    rows = rows.groupBy("_tag", "source_dataset").agg(F.min("slice_tag").alias("slice_tag"), largest("target_per_mille"), largest("min_rows"))
    return rows.withColumn("cell", F.concat_ws("\n", "_tag", "source_dataset"))


def pool(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per distinct ``prompt_id`` with a non-null priority: its best row and the target cells it is in.

    Redelivered rows are merged: a prompt is in a cell if any of its rows is. Null
    prompts are left out; null tag arrays, null, blank or unknown tags are no cell.
    """
    tags = F.array_distinct(F.transform(F.coalesce("slice_tags", F.array().cast("array<string>")), name_key))
    rows = candidates.where(F.col("prompt_id").isNotNull()).select("prompt_id", "cand_id", F.col("priority_score").alias("_p"), "source_dataset", F.explode_outer(tags).alias("_tag"))
    rows = rows.join(broadcast_within(_cells(targets).select("_tag", "source_dataset", "cell"), MAX_CELLS), ["_tag", "source_dataset"], "left")
    best = F.struct(F.when(~F.isnan("_p"), F.col("_p")).alias("p"), (-F.col("cand_id")).alias("i"))
    # a prompt gathers cells that targets name, so the set stays small however often it was delivered
    merged = rows.groupBy("prompt_id").agg(F.max("_p").alias("_any"), F.max(F.when(F.col("_p").isNotNull(), best)).alias("_best"), F.collect_set("cell").alias("cells"))
    return merged.where("_any is not null").select("prompt_id", (-F.col("_best.i")).alias("cand_id"), F.col("_best.p").alias("priority_score"), "cells")


def _key(seed: int) -> Column:
    """The reservoir key, larger keys first: over 0.5 for positive priorities, below for others."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("prompt_id"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.least(F.col("priority_score"), F.lit(1e300))
    time = F.log(-F.log(u)) - F.log(weight)  # from -729 to 712 for weights of 1e-308 to 1e300
    return F.when(weight > 0, 0.75 - time / 3000.0).otherwise(u / 2.0)


def quotas(rows: DataFrame, targets: DataFrame, fraction: tuple[int, int] = (1, 5)) -> DataFrame:
    """Per cell: available rows, required rows and the quota that can be met.

    ``slice_tag, source_dataset, target_per_mille, min_rows, pool, sample_size,
    available, required, quota, missing`` and ``cell``. Required is the greater of
    the minimum and the floor of the cell's share of the sample, which is
    ``fraction`` of the pool (floored).
    """
    counts = durable(rows.select(F.explode(F.concat(F.array(F.lit("")), F.col("cells"))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("available")))
    total = (counts.where("cell = ''").first() or {"available": 0})["available"]
    size = total * fraction[0] // fraction[1]
    plan = _cells(targets).join(counts, "cell", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    required = F.greatest(F.col("min_rows").cast("long"), F.expr(f"{size} * target_per_mille div 1000"))
    plan = plan.select("slice_tag", "source_dataset", "target_per_mille", "min_rows", F.lit(total).cast("long").alias("pool"), F.lit(size).cast("long").alias("sample_size"), "available", required.alias("required"), "cell")
    return plan.withColumns({"quota": F.least("required", "available"), "missing": F.greatest(F.lit(0).cast("long"), F.col("required") - F.col("available"))})


def report(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """The feasible quotas of all target cells, see :func:`quotas`; ``missing`` > 0 marks the exhausted ones. An empty pool requires the minimums."""
    return quotas(pool(candidates, targets), targets).drop("cell")


def exhausted(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """The cells whose target cannot be met: ``slice_tag, source_dataset``."""
    return report(candidates, targets).where("available < required").select("slice_tag", "source_dataset")


def sample(candidates: DataFrame, targets: DataFrame, *, seed: int = 42) -> DataFrame:
    """The sample: one row per (cell, prompt) drawn, ``slice_tag, source_dataset, prompt_id, cand_id, priority_score, reservoir_key``.

    Each cell has exactly its quota of distinct prompts (all it has, where it is
    exhausted). Higher priorities are drawn with proportionally higher weight;
    null or NaN priorities of a prompt's other rows are ignored. A prompt in
    several cells may be drawn for each of them. Equal keys are cut by identifier.
    """
    rows = durable(pool(candidates, targets).withColumn("reservoir_key", _key(seed)))
    plan = durable(quotas(rows, targets).select("cell", "quota", "slice_tag", "source_dataset"))
    small = rows_within(plan, MAX_CELLS)
    members = rows.select("prompt_id", "cand_id", "priority_score", "reservoir_key", F.explode("cells").alias("cell")).join(F.broadcast(plan) if small else plan, "cell")
    cut = group_cutoffs(members, ["cell", "quota"], "reservoir_key", F.col("quota"), small_groups=small).select("cell", "cutoff", "n_above")
    near = members.join(F.broadcast(cut) if small else cut, "cell").where(F.col("reservoir_key") >= F.col("cutoff"))
    ties = near.where(F.col("reservoir_key") == F.col("cutoff"))
    # prompts of one priority share a key only if their 53-bit hashes do
    ties = ties.withColumn("_i", F.row_number().over(Window.partitionBy("cell").orderBy("prompt_id"))).where(F.col("_i") <= F.col("quota") - F.col("n_above")).drop("_i")
    out = near.where(F.col("reservoir_key") > F.col("cutoff")).unionByName(ties)
    return out.select("slice_tag", "source_dataset", "prompt_id", "cand_id", "priority_score", "reservoir_key")
