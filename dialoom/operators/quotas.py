"""Quotas: proportional, scaled, split; and the greedy choice across overlapping slices.

Quotas are computed on the driver from one count per group (their number is a
few, and checked); rows never leave the cluster, but for the few that are left
to fill a selection up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators.prefix import ordered_offsets
from dialoom.session import durable

MAX_GROUPS = 10_000


def counts(df: DataFrame, by: str) -> dict:
    found = df.where(F.col(by).isNotNull()).groupBy(by).count().limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return {r[0]: r[1] for r in found}


def share_out(sizes: dict, total: int) -> dict:
    """Each group's floor of its share of ``total``, capped by its size; the rest goes round one by one in name order where there is room."""
    n = sum(sizes.values())
    total = min(total, n)
    quota = {g: min(k, total * k // n) for g, k in sizes.items()} if n else {}
    left = total - sum(quota.values())
    while left > 0:
        for g in sorted(sizes):
            if left and quota[g] < sizes[g]:
                quota[g] += 1
                left -= 1
    return quota


def scaled(targets: dict, total: int) -> dict:
    """Targets scaled to a total: rounded half to even, at least 1 each; then the largest gives up and the smallest gets single units until the total is met.

    Ties go to the larger target. Nothing is wanted of a total of 0.
    """
    if total <= 0:
        return dict.fromkeys(targets, 0)
    whole = max(sum(targets.values()), 1)
    out = {k: max(1, round(v * total / whole)) for k, v in targets.items()}
    turn = sorted(targets, key=lambda k: -targets[k])
    while out and (gap := total - sum(out.values())):
        k = min(turn, key=out.get) if gap > 0 else max(turn, key=out.get)
        if gap < 0 and out[k] <= 1:
            break
        out[k] += 1 if gap > 0 else -1
    return out


def split(target: int, ratios: dict) -> dict:
    """A quota split by ratios: rounded half to even, then mended in units at the largest or the smallest part, by name on ties."""
    out = {k: round(target * ratios[k]) for k in sorted(ratios)}
    while out and (gap := target - sum(out.values())):
        k = min(out, key=out.get) if gap > 0 else max(out, key=out.get)
        out[k] += 1 if gap > 0 else -1
    return out


def by_quota(df: DataFrame, by: str, quota: dict, order: list[Column]) -> DataFrame:
    """The first rows of each group in ``order`` (total), as many as its quota; one small table is broadcast (at most MAX_GROUPS rows)."""
    small = df.sparkSession.createDataFrame(sorted(quota.items()), f"`{by}` string, _quota long")
    rows = df.join(F.broadcast(small), by).withColumn("_one", F.lit(1))
    return ordered_offsets(rows, [by], order, "_one").where("offset < _quota").drop("offset", "_quota", "_one")


def proportional(df: DataFrame, by: str, total: int, order: list[Column]) -> DataFrame:
    """A sample of ``total`` rows in proportion to the groups' sizes."""
    return by_quota(df, by, share_out(counts(df, by), total), order)


def greedy_slices(df: DataFrame, key: str, slices: str, quota: dict, order, *, source: str | None = None, ratios: dict | None = None, scores: str | None = None, rest: list[Column] | None = None, taken: DataFrame | None = None) -> DataFrame:
    """Fills overlapping slices without using a key twice, the scarcest slice first: ``key, slice``.

    ``df`` has one row per key, ``slices`` is an array column. Scarcity is the
    number of free keys of a slice per row it wants, then its name. A slice takes
    its best rows of each ``source`` first, as many as its ``ratios`` say, then its
    best rows of any. ``order`` gives the total order for a slice. If rows are
    still missing in the end, the best others by ``rest`` are assigned one by one
    to the slice of theirs that lacks most (then to that of the best score in the
    map ``scores``); these are at most as many as were wanted. Keys of ``taken``
    are never used, so a second selection can be kept apart from a first.
    """
    free = df if taken is None else df.join(taken.select(key).distinct(), key, "left_anti")
    free = durable(free.where(F.size(slices) > 0))
    have = counts(free.select(key, F.explode(F.array_distinct(slices)).alias("s")).distinct(), "s")
    chosen: DataFrame | None = None
    left = lambda: free if chosen is None else free.join(chosen.select(key), key, "left_anti")
    filled = dict.fromkeys(quota, 0)
    for k in sorted(quota, key=lambda k: (have.get(k, 0) / max(quota[k], 1), k)):
        own = order(k) if callable(order) else order
        steps = [lambda rows: by_quota(rows, source, split(quota[k], ratios[k]), own)] if source and ratios and k in ratios else []
        for step in [*steps, lambda rows: rows.orderBy(*own).limit(quota[k] - filled[k])]:
            if filled[k] < quota[k]:
                picked = step(left().where(F.array_contains(slices, k))).select(key, F.lit(k).alias("slice"))
                chosen = durable(picked if chosen is None else chosen.unionByName(picked))
                filled[k] = chosen.where(F.col("slice") == k).count()
    missing = sum(quota.values()) - sum(filled.values())
    if rest and missing > 0:
        score = F.col(scores) if scores else F.create_map().cast("map<string,double>")
        others = left().orderBy(*rest).limit(missing).select(key, F.array_distinct(slices).alias("s"), score.alias("m")).collect()  # at most the quotas
        found = []
        for r in others:
            value = lambda s, r=r: (r["m"] or {}).get(s) or 0.0
            under = [s for s in r["s"] if filled.get(s, 0) < quota.get(s, 0)]
            best = max(under, key=lambda s: (quota[s] - filled[s], value(s))) if under else max(r["s"], key=value)
            filled[best] = filled.get(best, 0) + 1
            found.append((r[key], best))
        if found:
            more = df.sparkSession.createDataFrame(found, df.select(key, F.lit("").alias("slice")).schema)
            chosen = more if chosen is None else chosen.unionByName(more)
    return chosen if chosen is not None else df.select(key, F.lit("").alias("slice")).limit(0)
